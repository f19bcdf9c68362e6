"""Quality rules against brute force; the weak-label classifier and the toxicity scorer on labelled rows."""

import itertools
import random
import re

import numpy as np
import pytest

from framewake.llm import rules, toxicity, weaklabel
from framewake.llm.queries import queries

from .helpers import documents, empty

SF = "/root/testdata/sf0.01"


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {k for v in places.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_rules_equal_brute_force(spark):
    docs = documents(spark, ["a b c d e f g h " * 3 + "tail", "# $ % & | < >\n# $ % & | < >", "one two three four five six seven eight"])
    got = {r.doc_id: tuple(r)[1:7] for r in rules.quality_rules(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id][:5] + got[r.doc_id][5:6] == brute_counts(r.text), r.doc_id


def test_rules_run_without_python(spark):
    plan = rules.quality_rules(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_keep_good_hands_all_columns_through(spark):
    clean = "The and of to was here with that for it. " * 1 + " ".join(f"plain{chr(97 + i % 26)}{chr(97 + i // 26)} the" for i in range(60)) + "."
    junk = " ".join(f"WORD{i}%%%" for i in range(60))
    docs = documents(spark, [clean, junk])
    for keep in (rules.keep_good, weaklabel.keep_good):
        got = keep(docs)
        assert got.columns == docs.columns
        assert clean in [r.text for r in got.collect()]
    assert junk not in [r.text for r in rules.keep_good(docs).collect()]
    assert rules.keep_good(empty(spark)).count() == 0 and rules.quality_rules(empty(spark)).count() == 0


def test_label_model_finds_the_accuracies():
    rng = np.random.default_rng(5)
    k, n = len(weaklabel.LABELLERS), 40_000
    good = rng.random(n) < 0.85
    on_bad = rng.uniform(0.2, 0.6, k)
    codes = np.zeros(n, np.int64)
    for j in range(k):
        bad_vote = ~good & (rng.random(n) < on_bad[j]) if j < k - 2 else ~good & (rng.random(n) < 0.7)
        good_vote = good & (rng.random(n) < 0.9) if j >= k - 2 else np.zeros(n, bool)
        codes = codes * 3 + np.where(bad_vote, weaklabel.BAD, np.where(good_vote, weaklabel.GOOD, weaklabel.NONE))
    patterns, counts = np.unique(codes, return_counts=True)
    model = weaklabel.fit_labels(patterns, counts)
    assert abs(model.prior - 0.85) < 0.03
    assert np.abs(model.on_bad[: k - 2, weaklabel.BAD] - on_bad[: k - 2]).max() < 0.08
    assert model.accuracies().min() > 0.8


def test_posteriors_equal_bayes_written_out():
    rng = np.random.default_rng(9)
    patterns = np.unique(rng.integers(0, 3 ** len(weaklabel.LABELLERS), 400))
    counts = rng.integers(1, 50, len(patterns))
    model = weaklabel.fit_labels(patterns, counts)
    for code, got in zip(patterns.tolist(), model.posterior(patterns).tolist(), strict=True):
        good, bad = model.prior, 1 - model.prior
        for k in reversed(range(len(weaklabel.LABELLERS))):
            code, vote = divmod(code, 3)
            good, bad = good * model.on_good[k][vote], bad * model.on_bad[k][vote]
        assert got == pytest.approx(good / (good + bad), abs=1e-9)
    # one more round from its own posteriors leaves the model as it is
    p = model.posterior(patterns)
    assert model.prior == pytest.approx((counts @ p + 1) / (counts.sum() + 2), abs=1e-4)
    assert model.posterior(np.array([-1]))[0] == 0


def test_facts_equal_counts_of_each_text():
    random.seed(3)
    bits = ["the", "THE", "und", "é", "x" * 40, "#|%", "!", "\n", "\n", " ", "  ", "\t", "\x0b", "1 ", "wort wort ", "\u00a0", "日本 "]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 60))) for _ in range(300)] + ["", " ", "\n\n", "a", "a\n", "\na"]
    import pyarrow as pa

    facts = weaklabel.Facts(pa.array([None, *texts], pa.string()).slice(1))
    for k, t in enumerate(texts):
        raw = t.encode()
        words = [w for w in re.split(rb"[\x20\x09-\x0d]+", raw) if w]
        lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        want = (len(raw), len(words), len(set(words)), sum(a == b for a, b in zip(words, words[1:], strict=False)), len(lines), len(set(lines)), sum(w.decode().lower() in weaklabel._STOPS for w in words))
        assert (facts.bytes[k], facts.words[k], facts.distinct[k], facts.repeats[k], facts.lines[k], facts.distinct_lines[k], facts.stops[k]) == want, t
        assert (facts.bangs[k], facts.bars[k], facts.upper[k]) == (raw.count(b"!"), raw.count(b"|"), sum(65 <= b < 91 for b in raw)) and facts.symbols[k] == sum(raw.count(c) for c in b"#*$%&|<>^~@=\\{}[]_")


def test_loops_of_few_words_are_bad_at_any_length():
    import pyarrow as pa

    natural = " ".join(f"w{i * i % 9973} the" for i in range(30_000))
    votes = weaklabel.few_words_over_and_over(weaklabel.Facts(pa.array([" ".join("one two three four".split() * k) for k in (5, 10, 499, 500, 5000)] + [natural])))
    assert votes.tolist() == [weaklabel.NONE, *[weaklabel.BAD] * 4, weaklabel.NONE]


def test_scores_are_means_of_word_scores():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    labels = weaklabel.fit_labels(np.array([1, 2, 3]), np.array([5, 5, 5]))
    own = weaklabel.word_buckets("ba")[-1]
    model = weaklabel.QualityModel(labels, rng.normal(size=weaklabel.BUCKETS), {own: 0.7}, 0.1, 0.3)
    texts = ["ba ba du\nWort", "", "x", "ba " * 500]
    for t, got in zip(texts, weaklabel.Scorer(model).scores(weaklabel.Facts(pa.array(texts))).tolist(), strict=True):
        words = t.split()
        z = 0.1 + (10 * 0.3 + sum(model.weights[weaklabel.word_buckets(w)[:4]].sum() + (0.7 if w == "ba" else 0) for w in words) + model.weights[weaklabel._STUTTER] * sum(a == b for a, b in zip(words, words[1:], strict=False))) / (10 + len(words))
        assert got == pytest.approx(1 / (1 + np.exp(-z)) if words else 0.0)


def test_the_sample_is_bounded_where_rows_repeat(spark):
    from pyspark.sql import functions as F

    docs = spark.range(4000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 2900, "same").otherwise(F.col("id").cast("string")).alias("text"))
    got = weaklabel._sample(docs, 4000, 200)
    assert 0 < got.count() <= 400 and sorted(got.collect()) == sorted(weaklabel._sample(docs.repartition(5), 4000, 200).collect())


def test_classifier_agrees_with_held_back_labels(spark):
    got = queries()["op2_quality_classifier"](spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert got.kept[got.quality == 1].mean() > 0.98
    assert (~got.kept[got.quality == 0]).mean() > 0.75


def test_classifier_takes_odd_rows(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in weaklabel.classify(docs).collect()}
    assert len(got) == docs.select("doc_id").distinct().count()
    assert all(0 <= r.score <= 1 for r in got.values()) and not got[0].kept and not got[2].kept and got[1].score == 0
    assert weaklabel.classify(empty(spark)).count() == 0


def test_table_of_weights_scores_as_the_kernel():
    words = ["idiot", "i-d-i-o-t", "idxiot", "loweischaft", "thedre"]
    dense = [toxicity.table_of([(1.0, *toxicity.features(w))]) for w in words]
    for t, w in zip(dense, words, strict=True):
        damped = float((t * t).sum()) / toxicity.DAMPING[len(w)]
        assert abs(toxicity.word_scores([w], t)[0] - damped) < 1e-4 * damped
    pair = toxicity.word_scores(["idiot", "idiot"], dense[0])
    assert pair[0] == pytest.approx(pair[1])  # neighbours do not mix


def brute_kernel(a, b):
    """All sequences of four letters that stand in order within seven places, written out for both words."""
    def weights(word):
        out = {}
        for places in itertools.combinations(range(len(word)), 4):
            if (span := places[-1] - places[0] + 1) <= 7:
                key = "".join(word[i] for i in places)
                out[key] = out.get(key, 0.0) + 0.75**span
        return out

    x, y = weights(a), weights(b)
    return sum(v * y.get(k, 0.0) for k, v in x.items())


def test_the_kernel_equals_all_subsequences():
    words = ["idiot", "idxiot", "worthless", "wooorthless", "abcdefgh", "hgfedcba", "aaaaaaaa", "lost"]
    for a in words:
        table = toxicity.table_of([(1.0, *toxicity.features(a))])
        for b, got in zip(words, toxicity.word_scores(words, table).tolist(), strict=True):
            own = sum(max(0, len(b) - o[-1]) * 0.75 ** (2 * (o[-1] + 1)) for o in toxicity.OFFSETS)
            assert got == pytest.approx(brute_kernel(a, b) / max(own, 0.75**8) ** 0.25, rel=1e-4, abs=1e-6)


def test_rows_of_one_id_lend_one_text(spark):
    docs = spark.createDataFrame([(1, f"text number {i}", "s") for i in range(500)] + [(2, "calm words here", "s"), (3, "other words there", "s")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 0)], "doc_id long, toxic int")
    seen = []

    def noted(found, marks):
        seen.append(len(found))
        return toxicity.ToxicModel(None, 0.0)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(toxicity, "train", noted)
        toxicity.fit(docs, labels)
    assert seen and seen[0] <= 3


def test_gapped_words_are_caught():
    calm = ["the quick brown foxes jumped over seven lazy dogs today", "people walking along rivers under bright morning skies", "gardens and houses stand quietly beside narrow roads"]
    bad = [f"{c.split()[k % 5]} {w} {c}" for k, c in enumerate(calm * 20) for w in ("idiot", "worthless")]
    good = [" ".join(np.random.default_rng(k).permutation(c.split())) for k, c in enumerate(calm * 60)]
    model = toxicity.train([toxicity.tokens(t) for t in bad + good], [1] * len(bad) + [0] * len(good))
    score = lambda t: model.probability(toxicity.Scorer(model).worst([t]))[0]
    assert score("you idiot there") >= 0.7 and score("such a w o r t h l e s s thing") >= 0.7 and score("an id.iot") >= 0.7
    assert score("gardens beside rivers") < 0.5 and score("") < 0.5
    assert score("an idxiot") > score("gardens beside rivers")


def test_toxicity_holds_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries()["op8_toxicity"](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert held.predicted[held.toxic == 0].mean() < 0.02
    assert held.predicted[held.toxic == 1].mean() > 0.45  # rows of rare languages have too few examples here


def test_toxicity_takes_odd_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 0), (5, 1), (6, 0), (7, 1), (None, 1), (8, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score_toxicity(docs, none).collect()} == {0}
    assert toxicity.score_toxicity(empty(spark), labels).count() == 0
