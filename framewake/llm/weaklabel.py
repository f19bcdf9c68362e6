"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. A vote pattern is one number, so the corpus reduces
to at most 3 ** len(LABELLERS) pattern counts; expectation-maximisation over these counts estimates each labeller's
accuracy on good and on bad documents and the share of good ones (no true label is used). The posteriors of a bounded
sample of documents (TRAIN_DOCS, chosen by a hash of doc_id and text) train a logistic scorer on hashed features of words:
each word's form (shape, ends, length), and the word itself where enough training documents have it. It scores
every document over its whole text: a linear score is a mean of word scores, so each distinct word is hashed once.

What labellers read is counted over the bytes of a whole block of texts at once. A word is a run without white space.

Null and empty texts, or such of white space, score 0 and are not kept. Repeated rows get equal results. An empty table
gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import BLOCK_BYTES, ChunkTable, binary_of, tidy
from .common import blocks
from .rules import STOP_WORDS

#: Documents in the training sample, about; the sample is never larger than twice this.
TRAIN_DOCS = 6000
#: Buckets of the hashed forms of words, and of words themselves.
BUCKETS, WORD_BUCKETS = 2048, 1 << 20
#: A word bucket has a weight if so many training documents fill it, and is among so many that most of them fill.
LEAST_DOCS, MOST_WORDS = 60, 1024
#: Documents that score less are not kept.
KEEP_FROM = 0.5
#: Words of usual score that a text counts as having besides its own, so a few words alone condemn none.
PRIOR_WORDS = 10
#: Distinct words whose scores a worker remembers, and their bytes.
REMEMBERED, REMEMBERED_BYTES = 1_000_000, 48 << 20
_STOPS = frozenset().union(*STOP_WORDS.values())
GOOD, BAD, NONE = 1, 2, 0
_WHITE, _UPPER, _SYMBOL, _BANG, _BAR = 1, 2, 4, 8, 16
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] |= _WHITE
_KIND[65:91] |= _UPPER
_KIND[list(b"#*$%&|<>^~@=\\{}[]_")] |= _SYMBOL
_KIND[ord("!")] |= _BANG
_KIND[ord("|")] |= _BAR


def _between(places: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the ascending places lie between each two bounds."""
    return np.diff(np.searchsorted(places, bounds))


def _distinct(of: np.ndarray, what: np.ndarray, n: int) -> np.ndarray:
    """How many different numbers each of n owners has."""
    if not len(of):
        return np.zeros(n, np.int64)
    width = int(what.max()) + 1
    both = np.sort(of * width + what)  # of ascends, so this sorts within owners
    return np.bincount(both[np.append(True, both[1:] != both[:-1])] // width, minlength=n)


def _cut(data: np.ndarray, gone: np.ndarray, at: np.ndarray) -> pa.Array:
    """The pieces of data that begin at each place (and end before the next), without the bytes that are gone."""
    kept = data[~gone]
    before = np.cumsum(gone, dtype=np.int32)
    offsets = np.append(at - before[at] + gone[at], len(kept)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])


class Facts:
    """Counts of each text of a block that labellers and scorer read, and its words."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        n = len(texts)
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        low = bounds[0]
        bounds = bounds - low
        data = np.frombuffer(texts.buffers()[2], np.uint8)[low : low + bounds[-1]] if n and bounds[-1] else np.zeros(0, np.uint8)
        kind = _KIND[data]
        white = kind == _WHITE
        self.bytes = np.diff(bounds)
        self.upper, self.symbols, self.bangs, self.bars = (_between(np.flatnonzero(kind & k), bounds) for k in (_UPPER, _SYMBOL, _BANG, _BAR))
        begins = ~white
        begins[1:] &= white[:-1]
        starts = bounds[:-1][bounds[:-1] < len(data)]
        begins[starts] = ~white[starts]
        word_at = np.flatnonzero(begins)
        #: Where the words of each text begin in the order of all words.
        self.at = np.searchsorted(word_at, bounds)
        self.words = np.diff(self.at)
        coded = _cut(data, white, word_at).dictionary_encode()
        self.dictionary, self.numbers = coded.dictionary, coded.indices.to_numpy()
        of = np.repeat(np.arange(n), self.words)
        again = np.flatnonzero((self.numbers[1:] == self.numbers[:-1]) & (of[1:] == of[:-1]))
        self.repeats = np.bincount(of[again], minlength=n)
        self.distinct = _distinct(of, self.numbers, n)
        stop = pc.is_in(pc.utf8_lower(self.dictionary.cast(pa.string())), value_set=pa.array(sorted(_STOPS))).to_numpy(zero_copy_only=False)
        self.stops = np.bincount(of[stop[self.numbers]], minlength=n) if len(of) else np.zeros(n, np.int64)
        ended = data == 10
        line = np.zeros(len(data), bool)
        line[1:] = ended[:-1]
        line[starts] = True
        line_at = np.flatnonzero(line)
        full = np.diff(np.searchsorted(word_at, np.append(line_at, len(data)))) > 0
        line_of = np.searchsorted(bounds, line_at, "right") - 1
        number = _cut(data, ended, line_at).dictionary_encode().indices.to_numpy()
        self.lines = np.bincount(line_of[full], minlength=n)
        self.distinct_lines = _distinct(line_of[full], number[full], n)

    def share(self, count: np.ndarray) -> np.ndarray:
        """Of the bytes without white space, about."""
        return count / np.maximum(1, self.bytes - self.words)


def _bad(yes: np.ndarray) -> np.ndarray:
    """A labeller of one fault: it says nothing of texts without it."""
    return np.where(yes, BAD, NONE)


def symbols(f: Facts) -> np.ndarray:
    return _bad(f.share(f.symbols) > 0.06)


def capitals(f: Facts) -> np.ndarray:
    return _bad(f.share(f.upper) > 0.4)


def shouts(f: Facts) -> np.ndarray:
    return _bad(f.bangs > 0.25 * f.words)


def stutter(f: Facts) -> np.ndarray:
    return _bad((f.words > 5) & (f.repeats > 0.25 * (f.words - 1)))


def table(f: Facts) -> np.ndarray:
    return _bad(f.bars > 0.2 * f.words)


def repeated_lines(f: Facts) -> np.ndarray:
    return _bad((f.lines > 3) & (f.distinct_lines < 0.5 * f.lines))


def few_words_over_and_over(f: Facts) -> np.ndarray:
    """Fewer than a quarter of the words differ; in texts of over 2000 words, fewer than 500 * sqrt(words / 2000), as vocabularies grow."""
    usual = np.where(f.words <= 2000, 0.25 * f.words, 500 * np.sqrt(f.words / 2000))
    return _bad((f.words > 30) & (f.distinct < usual))


def odd_words(f: Facts) -> np.ndarray:
    mean = (f.bytes - f.words) / np.maximum(1, f.words)
    return _bad((f.words > 10) & ((mean < 2) | (mean > 15)))


def prose(f: Facts) -> np.ndarray:
    """Common words at the rate of running text, or next to none of them."""
    share = f.stops / np.maximum(1, f.words)
    return np.where(f.words < 20, NONE, np.where(share > 0.08, GOOD, np.where(share < 0.01, BAD, NONE)))


def clean_characters(f: Facts) -> np.ndarray:
    return np.where((f.share(f.symbols) < 0.02) & (f.share(f.upper) < 0.15) & (f.bangs < 0.1 * f.words), GOOD, NONE)


LABELLERS = (symbols, capitals, shouts, stutter, table, repeated_lines, few_words_over_and_over, odd_words, prose, clean_characters)


def patterns_of(facts: Facts) -> np.ndarray:
    """All votes on each text as one number, base 3; -1 for a text without words."""
    code = np.zeros(len(facts.words), np.int64)
    for labeller in LABELLERS:
        code = code * 3 + labeller(facts)
    return np.where(facts.words > 0, code, -1)


def votes_of(patterns: np.ndarray) -> np.ndarray:
    """Patterns to votes, a column for each labeller."""
    return np.stack([patterns // 3 ** (len(LABELLERS) - 1 - k) % 3 for k in range(len(LABELLERS))], 1)


@dataclass
class LabelModel:
    prior: float
    #: P(vote | good) and P(vote | bad) of each labeller, in the order NONE, GOOD, BAD.
    on_good: np.ndarray
    on_bad: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        votes, k = votes_of(patterns), np.arange(len(LABELLERS))
        z = np.log(1 - self.prior) - np.log(self.prior) + (np.log(self.on_bad[k, votes]) - np.log(self.on_good[k, votes])).sum(1)
        return np.where(patterns < 0, 0.0, 1 / (1 + np.exp(np.clip(z, -500, 500))))

    def accuracies(self) -> np.ndarray:
        """P(a labeller is right | it votes) in the mix of documents."""
        right = self.prior * self.on_good[:, GOOD] + (1 - self.prior) * self.on_bad[:, BAD]
        return right / (right + self.prior * self.on_good[:, BAD] + (1 - self.prior) * self.on_bad[:, GOOD])


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over pattern counts, from the votes' balance on.

    A fault is taken to be rare in good documents: so says the prior of pseudo-votes, a hundredth of all documents.
    """
    keep = patterns >= 0
    patterns, counts = patterns[keep], counts[keep].astype(float)
    votes = votes_of(patterns)
    balance = (votes == GOOD).sum(1) - 3 * (votes == BAD).sum(1)
    p = 1 / (1 + np.exp(-2.0 * balance))
    extra = max(2.0, counts.sum() / 100)
    onto_good, onto_bad = extra * np.array([0.495, 0.495, 0.01]), extra * np.array([0.6, 0.1, 0.3])
    last = None
    while True:
        g, b = counts * p, counts * (1 - p)
        tables = [np.stack([(x[:, None] * (votes == v)).sum(0) for v in (NONE, GOOD, BAD)], 1) + prior for x, prior in ((g, onto_good), (b, onto_bad))]
        good, bad = (t / t.sum(1, keepdims=True) for t in tables)
        model = LabelModel(float(np.clip((g.sum() + 1) / (counts.sum() + 2), 0.01, 0.99)), good, bad)
        now = np.concatenate([[model.prior], good.ravel(), bad.ravel()])
        rounds -= 1
        if rounds <= 0 or last is not None and np.abs(now - last).max() < 1e-7:
            return model
        last, p = now, model.posterior(patterns)


def _bucket(feature: str, buckets: int = BUCKETS) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % buckets


def _shape(word: str) -> str:
    if word.isalpha():  # most words
        if word.islower():
            return "a"
        if word[0].isupper() and word[1:].islower():
            return "Aa"
    out = []
    for c in word:
        k = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "x" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def word_buckets(word: str) -> list[int]:
    """Hashed features of a word: shape, ends and length below BUCKETS, then the word itself."""
    low = word.lower()
    return [_bucket("s" + _shape(word)), _bucket("<" + low[:2]), _bucket(low[-2:] + ">"), _bucket(f"n{min(len(word), 24) // 2}"), BUCKETS + _bucket("w" + low, WORD_BUCKETS)]


_STUTTER = _bucket("==")


def features_of(facts: Facts) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and values of each text: means of its words' features; the share of words that repeat the one before is one more."""
    buckets = np.array([word_buckets(w) for w in facts.dictionary.cast(pa.string()).to_pylist()], np.int64).reshape(-1, 5)
    out = []
    for k, (a, b) in enumerate(zip(facts.at[:-1], facts.at[1:], strict=True)):
        at, n = np.unique(buckets[facts.numbers[a:b]].ravel(), return_counts=True)
        value = n / max(1, b - a)
        if b > a and facts.repeats[k]:
            at, value = np.append(at, _STUTTER), np.append(value, facts.repeats[k] / (b - a))
        out.append((at, value))
    return out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 200, decay: float = 1e-3) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and scale of a logistic regression against soft labels, with both classes weighted alike; Adam on all rows.

    x is multiplied by the scale of its columns in place, and the weights are for it.
    """
    scale = (1 / (x.std(0) + 1e-2)).astype(np.float32)
    x *= scale
    y = y.astype(np.float32)
    mass = np.array([max(1e-6, (1 - y).sum()), max(1e-6, y.sum())])
    weight = ((1 - y) / mass[0] + y / mass[1]) / 2
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    m = v = np.zeros(x.shape[1] + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        e = (weight * (p - y)).astype(np.float32)
        grad = np.append(x.T @ e + decay * w / 10, e.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1].astype(np.float32), b - float(step[-1])
    return w.astype(np.float64), b, scale.astype(np.float64)


@dataclass
class QualityModel:
    labels: LabelModel
    #: Weights of the forms' buckets, and of the word buckets that have one.
    weights: np.ndarray
    words: dict[int, float]
    bias: float
    #: Mean word score of good training documents: a text counts as PRIOR_WORDS such words more than it has.
    usual: float = 0.0


class _Parts(dict):
    """Features of words' forms to their weights, hashed once each."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, feature: str) -> float:
        if len(self) > 100_000:
            self.clear()
        self[feature] = weight = float(self.weights[_bucket(feature)])
        return weight


def _sample(docs: DataFrame, n: int, train_docs: int) -> DataFrame:
    """About train_docs of n rows by a hash of id and text, twice as many at most, the same in every run; equal rows count once if they were more."""
    rows, part = docs.select("doc_id", "text"), train_docs / n
    if part >= 1:
        return rows
    place, distinct = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000_000)), False
    while True:
        chosen = rows.where(place < int(part * 1_000_000_000))
        chosen = chosen.dropDuplicates(["doc_id", "text"]) if distinct else chosen
        if chosen.count() <= 2 * train_docs:
            return chosen
        part, distinct = (part / 2 if distinct else part), True


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> QualityModel:
    """Label model over all documents, scorer from the bounded sample."""

    def code(batches):
        for block in blocks(batches, max_bytes=BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(patterns_of(Facts(block.column("text"))))], ["pattern"])

    found = docs.select("text").mapInArrow(code, "pattern long").groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()  # 3 ** 10 + 1 rows at most
    patterns, counts = np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], np.int64)
    labels = fit_labels(patterns, counts)
    n = int(counts.sum())
    if not n:
        return QualityModel(labels, np.zeros(BUCKETS), {}, 0.0)

    def rows(batches):
        for block in blocks(batches):
            facts = Facts(block.column("text"))
            made = features_of(facts)
            yield pa.RecordBatch.from_arrays([pa.array(patterns_of(facts)), pa.array([a.astype("<u4").tobytes() for a, _ in made]), pa.array([v.astype("<f4").tobytes() for _, v in made])], ["pattern", "at", "value"])

    seen = _sample(docs, n, train_docs).select("text").mapInArrow(rows, "pattern long, at binary, value binary").toArrow()
    places = [np.frombuffer(a, "<u4") for a in seen.column("at").to_pylist()]
    filled = np.bincount(np.concatenate([a[a >= BUCKETS] for a in places]) - BUCKETS, minlength=WORD_BUCKETS) if places else np.zeros(WORD_BUCKETS, int)
    often = np.argsort(-filled, kind="stable")[:MOST_WORDS]
    often = np.sort(often[filled[often] >= LEAST_DOCS])
    column = np.full(BUCKETS + WORD_BUCKETS, -1, np.int32)
    column[:BUCKETS], column[BUCKETS + often] = np.arange(BUCKETS), BUCKETS + np.arange(len(often))
    x = np.zeros((seen.num_rows, BUCKETS + len(often)), np.float32)
    for k, (at, value) in enumerate(zip(places, seen.column("value").to_pylist(), strict=True)):
        to = column[at]
        np.add.at(x[k], to[to >= 0], np.frombuffer(value, "<f4")[to >= 0])
    y = labels.posterior(seen.column("pattern").to_numpy())
    weights, bias, scale = train(x, y)
    usual = float((x @ weights) @ y / max(1e-9, y.sum()))
    weights = weights * scale  # of features as they are
    return QualityModel(labels, weights[:BUCKETS], dict(zip((BUCKETS + often).tolist(), weights[BUCKETS:].tolist(), strict=True)), bias, usual)


class Scorer:
    def __init__(self, model: QualityModel):
        self.model, self.parts = model, _Parts(model.weights)
        self.table = ChunkTable(self._learn, 1, REMEMBERED, REMEMBERED_BYTES)

    def _learn(self, new: pa.Array) -> list[pa.Array]:
        part, own, out = self.parts, self.model.words, []
        for word in new.cast(pa.string()).to_pylist():  # as word_buckets has it
            low = word.lower()
            form = part["s" + _shape(word)] + part["<" + low[:2]] + part[low[-2:] + ">"] + part[f"n{min(len(word), 24) // 2}"]
            out.append(form + own.get(BUCKETS + _bucket("w" + low, WORD_BUCKETS), 0.0))
        return [binary_of(np.array(out, np.float64), np.ones(len(new), np.int64))]

    def scores(self, facts: Facts) -> np.ndarray:
        """The score of each text; 0 for those without words."""
        m, n = self.model, facts.words
        if not len(facts.numbers):
            return np.zeros(len(n))
        word = np.frombuffer(pa.concat_arrays(self.table.values_of(facts.dictionary)).buffers()[2], np.float64)[facts.numbers]
        some = n > 0
        total = np.zeros(len(n))
        total[some] = np.add.reduceat(word, facts.at[:-1][some])
        z = m.bias + (PRIOR_WORDS * m.usual + total + m.weights[_STUTTER] * facts.repeats) / (PRIOR_WORDS + n)
        return np.where(some, 1 / (1 + np.exp(-np.clip(z, -500, 500))), 0.0)


def _emit(docs: DataFrame, model: QualityModel):
    return docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS + MOST_WORDS numbers


def classify(docs: DataFrame, model: QualityModel | None = None, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, posterior of the label model, score of the trained scorer, and kept."""
    shared = _emit(docs, model or fit(docs))

    def run(batches):
        scorer = Scorer(shared.value)
        for block in blocks(batches, max_bytes=BLOCK_BYTES):
            facts = Facts(block.column("text"))
            score = scorer.scores(facts)
            yield pa.RecordBatch.from_arrays([block.column("doc_id").cast(pa.int64()), pa.array(shared.value.labels.posterior(patterns_of(facts))), pa.array(score), pa.array((score >= keep_from) & (score > 0))], ["doc_id", "posterior", "score", "kept"])
        del scorer
        tidy()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, posterior double, score double, kept boolean")


def keep_good(docs: DataFrame, model: QualityModel | None = None, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of docs, all their columns as they were, that the scorer keeps."""
    shared = _emit(docs, model or fit(docs))

    def run(batches):
        scorer = Scorer(shared.value)
        for block in blocks(batches, max_bytes=BLOCK_BYTES):
            score = scorer.scores(Facts(block.column("text")))
            yield block.filter(pa.array((score >= keep_from) & (score > 0)))
        del scorer
        tidy()

    return docs.mapInArrow(run, docs.schema)
