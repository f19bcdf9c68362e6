"""Line dedup and SimHash against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from framewake.llm import components, linededup, simhash

from .helpers import documents, empty

WHITE = " \t\n\x0b\x0c\r"
SHARED = [f"Shared footer {k % 3}  \nown line {k}\n{'' if k % 2 else '  shared FOOTER 9 '}" for k in range(33)]


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute_lines(texts, least=10):
    seen = defaultdict(set)
    for k, t in enumerate(texts):
        for line in (t or "").split("\n"):
            seen[lower(line.strip(WHITE))].add(k)
    often = {k for k, v in seen.items() if k and len(v) >= least}
    return ["\n".join(x for x in (t or "").split("\n") if lower(x.strip(WHITE)) not in often) for t in texts]


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, -1])
def test_frequent_lines_go_in_both_ways(spark, broadcast_bytes):
    docs = documents(spark, SHARED).repartition(5)
    rows = docs.collect()
    want = brute_lines([r.text for r in rows])
    got = linededup.line_digests(docs, broadcast_bytes=broadcast_bytes).collect()
    assert sorted((r.doc_id or -1, r.n_lines, r.kept_sha256) for r in got) == sorted((r.doc_id or -1, (r.text or "").count("\n") + 1, hashlib.sha256(w.encode()).hexdigest()) for r, w in zip(rows, want, strict=True))
    assert sum(r.n_dropped for r in got) == 33 + 17
    kept = linededup.dedupe_lines(docs, broadcast_bytes=broadcast_bytes)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == sorted((r.doc_id or -1, w) for r, w in zip(rows, want, strict=True))


def brute_first(rows, least=10):
    """What stays if each frequent line stays at its first occurrence: the smallest doc_id, then the order of the rows."""
    often = defaultdict(set)
    for k, r in enumerate(rows):
        for line in (r.text or "").split("\n"):
            often[lower(line.strip(WHITE))].add(k)
    due = {k for k, v in often.items() if k and len(v) >= least}
    often, out = set(due), [None] * len(rows)
    for k in sorted(range(len(rows)), key=lambda k: (rows[k].doc_id is None, rows[k].doc_id or 0, k)):
        kept = []
        for line in (rows[k].text or "").split("\n"):
            key = lower(line.strip(WHITE))
            if key not in often or key in due:
                kept.append(line)
                due.discard(key)
        out[k] = "\n".join(kept)
    return out


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, -1])
def test_the_first_occurrence_stays_in_both_ways(spark, tmp_path, broadcast_bytes):
    clean = "A clean text of its own.\nIt has three lines.\nNobody else has them."
    documents(spark, [clean] * 12 + SHARED + ["twice\nin one\ntwice"] * 11).repartition(5).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    rows = docs.collect()
    got = linededup.dedupe_lines(docs, broadcast_bytes=broadcast_bytes, first=True)
    assert got.columns == docs.columns
    found = [(r.doc_id, r.text) for r in got.collect()]
    key = lambda t: (t[0] is None, t[0] or 0, t[1])
    assert sorted(found, key=key) == sorted(((r.doc_id, w) for r, w in zip(rows, brute_first(rows), strict=True)), key=key)
    assert [t for _, t in found].count(clean) == 1 and [t for _, t in found].count("twice\nin one") == 1


def test_the_pipeline_keeps_one_of_many_copies(spark, tmp_path):
    clean = "\n".join(f"Sentence number {i} of a text that many rows hold in full." for i in range(8))
    documents(spark, [clean] * 15).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    corpus_pipeline.line_dedup(spark, docs, "").write.parquet(str(tmp_path / "lines"))
    left = corpus_pipeline.near_dedup(spark, spark.read.parquet(str(tmp_path / "lines")), "")
    assert [r.text for r in left.collect()].count(clean) == 1


def test_saturated_filters_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(linededup, "LEAST_BITS", linededup.PAGE)
    monkeypatch.setattr(linededup, "MOST_BITS", linededup.PAGE)
    docs = documents(spark, SHARED + [f"line {i}\n" * 3 + f"x{i}" for i in range(300)])
    rows = docs.collect()
    want = brute_lines([r.text for r in rows])
    got = linededup.line_digests(docs).collect()
    assert sorted(r.kept_sha256 for r in got) == sorted(hashlib.sha256(w.encode()).hexdigest() for w in want)


def test_empty_tables(spark):
    assert linededup.line_digests(empty(spark)).count() == 0
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.keep_first(empty(spark)).count() == 0


def brute_fingerprint(text):
    words = [w for w in lower(text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps, ids, radius=4):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= radius and label[i] != label[j]:
                    a, b = sorted((label[i], label[j]))
                    label = [a if x == b else x for x in label]
                    changed = True
    least = {}
    for k, i in zip(label, ids, strict=True):
        if i is not None:
            least[k] = min(i, least.get(k, i))
    return [least.get(k) for k in label]


def near_texts():
    base = [f"token{i} alpha beta gamma{i % 7}" for i in range(60)]
    return [" ".join(base[:k] + [f"changed{k}"] + base[k + 1 :]) for k in range(0, 60, 5)] + [" ".join(base[::-1])]


def test_simhash_equals_brute_force(spark):
    docs = documents(spark, near_texts())
    rows = docs.collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    want = brute_components(fps, [r.doc_id for r in rows])
    got = simhash.near_duplicates(docs.repartition(3)).collect()
    key = lambda t: (t[0] is None, t[0] or 0, t[1], t[2] or -1)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=key) == sorted(((r.doc_id, f"{f:016x}", c) for r, f, c in zip(rows, fps, want, strict=True)), key=key)


def test_keep_first_leaves_one_row_of_each_component(spark):
    docs = documents(spark, near_texts())
    rows = docs.collect()
    want = {c for c in brute_components([brute_fingerprint(r.text) for r in rows], [r.doc_id for r in rows]) if c is not None}
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want)


@pytest.mark.parametrize("block", [8, 64, 4096])
def test_links_of_large_blocks_connect_the_same(spark, block):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = np.unique(np.concatenate([centre, *[centre ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for b, c in rng.integers(0, 64, (40, 2))]]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {r.node: r.root for r in components.components(simhash.links(df, 4, block)).collect()}
    want = brute_components([int(x) for x in fps], list(range(len(fps))))
    groups = defaultdict(set)
    for x, w in zip(fps.view(np.int64), want, strict=True):
        groups[w].add(found.get(int(x), int(x)))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_a_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (9, 9)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}


def test_more_parts_for_more_rows():
    assert simhash.parts_for(1000, 4) == 5 and simhash.parts_for(10**9, 4) == 6 and simhash.parts_for(10**11, 4) > 6
    for parts in (5, 6, 7):
        masks = simhash._masks(parts, 4)
        rng = np.random.default_rng(parts)
        for _ in range(50):
            flip = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(flip & m == 0 for m in masks)
