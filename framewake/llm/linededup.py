"""Lines that many documents share, found with two Bloom filters and an exact count of the suspects.

1. Tasks put the hash of each key of each document into a once-seen filter; a hash that is there already goes into a
   twice-seen filter. Two tasks' pairs of filters merge as twice = twice | twice' | (once & once'), once = once | once',
   page by page, so no key seen in two documents is missed. Filters have a bounded, documented size; a fuller filter
   suspects more keys and costs time, never rows.
2. Only keys that the twice-seen filter holds are counted exactly: per task first, then by one shuffle of key and count.
3. Where the first occurrence is to stay, the same shuffle finds the least place of each key: that of the smallest doc_id
   (of repeated ids, the first row of the scan; null ids last). The key's first line there is kept, all others go.
4. Frequent keys are broadcast if their measured size allows it; otherwise suspects meet them in a shuffled join and
   each text is told its own keys. The result is the same.

A document is a row: repeated rows count each. Null and empty texts are one empty line. Lines of white space have an
empty key, which never counts. An empty table gives an empty result. Extra columns are not read by the digests and are
handed through by `dedupe_lines`.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, fresh, placed, stored, text_digest, texts_of

#: Bits of a page of a filter, the unit of merging.
PAGE = 1 << 16
#: Least and most bits of a filter; hashes set so many bits each.
LEAST_BITS, MOST_BITS, PROBES = 1 << 22, 1 << 28, 4
#: Lines expected in a document, for the size of the filters.
LINES_EACH = 16
#: Frequent keys are broadcast up to this many bytes in all.
BROADCAST_BYTES = 16 << 20
#: Keys and bytes that a task counts before it hands its counts on.
HELD_KEYS, HELD_BYTES = 100_000, 32 << 20
WHITE = b" \t\n\x0b\x0c\r"


def keys_of(text: str) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text and their keys."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    return lines, [x.strip(WHITE).lower() for x in lines]  # lower() of bytes changes A-Z alone


def _hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bit numbers of each hash, one row each."""
    a, b = hashes >> np.uint64(32), (hashes & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


class Bloom:
    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits, self.data = bits, np.zeros(bits // 8, np.uint8) if data is None else data

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = _probes(hashes, self.bits)
        return ((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)

    def add(self, hashes: np.ndarray) -> None:
        at = _probes(hashes, self.bits).ravel()
        np.bitwise_or.at(self.data, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def _pack(page: np.ndarray) -> bytes:
    """A page as its bit numbers if these are shorter."""
    n = int(np.bitwise_count(page).sum())
    if 2 * n < len(page):
        return b"p" + np.flatnonzero(np.unpackbits(page, bitorder="little")).astype("<u2").tobytes()
    return b"b" + page.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if data[:1] == b"b":
        return np.frombuffer(data, np.uint8, offset=1).copy()
    bits = np.zeros(PAGE, np.uint8)
    bits[np.frombuffer(data, "<u2", offset=1)] = 1
    return np.packbits(bits, bitorder="little")


def filter_bits(n_documents: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (n_documents * LINES_EACH * 8 - 1).bit_length()))


def twice_seen(docs: DataFrame, bits: int, min_chars: int = 1) -> Bloom:
    """The twice-seen filter of all documents."""
    spark = docs.sparkSession

    def build(batches):
        once, twice = Bloom(bits), Bloom(bits)
        for block in blocks(batches):
            keys = [k for text in texts_of(block) for k in {x for x in keys_of(text)[1] if _long(x, min_chars)}]
            if keys:
                hashes, n = np.unique(_hashes(keys), return_counts=True)
                again = (n > 1) | once.has(hashes)
                twice.add(hashes[again])
                once.add(hashes)
        a, b = once.data.reshape(-1, PAGE // 8), twice.data.reshape(-1, PAGE // 8)
        there = np.flatnonzero(a.any(1))
        for i in range(0, len(there), 512):
            part = there[i : i + 512].tolist()
            yield pa.RecordBatch.from_pydict({"page": pa.array(part, pa.int32()), "once": [_pack(a[k]) for k in part], "twice": [_pack(b[k]) for k in part]})

    def merge(key, table):
        once, twice = np.zeros(PAGE // 8, np.uint8), np.zeros(PAGE // 8, np.uint8)
        for x, y in zip(table.column("once").to_pylist(), table.column("twice").to_pylist(), strict=True):
            x = _unpack(x)
            twice |= _unpack(y) | (once & x)
            once |= x
        return pa.Table.from_pydict({"page": pa.array([key[0].as_py()], pa.int32()), "twice": [_pack(twice)]})

    # as many builders as keep the cores busy: each holds two filters, however many input splits it reads
    builders = docs.select("text").coalesce(4 * spark.sparkContext.defaultParallelism)
    pages = builders.mapInArrow(build, "page int, once binary, twice binary").groupBy("page").applyInArrow(merge, "page int, twice binary")
    out = Bloom(bits)
    for page, twice in pages.toLocalIterator():  # the filter in all: at most MOST_BITS
        out.data[page * (PAGE // 8) : (page + 1) * (PAGE // 8)] = _unpack(bytes(twice))
    return out


def _long(key: bytes, min_chars: int) -> bool:
    return len(key) > 0 if min_chars == 1 else len(key.decode("utf-8", "replace")) >= min_chars


def frequent_lines(docs: DataFrame, suspects: Bloom, min_docs: int = 10, min_chars: int = 1, place: list[str] | None = None) -> DataFrame:
    """key, n_docs of the keys in at least min_docs documents, counted exactly among the suspects.

    With the names of two columns that tell the rows apart, also file and place: those of the row that holds the key first.
    """
    shared = docs.sparkSession.sparkContext.broadcast((suspects.bits, suspects.data.tobytes()))

    def count(batches):
        bits, data = shared.value
        bloom, held, first, size = Bloom(bits, np.frombuffer(data, np.uint8)), Counter(), {}, 0
        for block in blocks(batches):
            each = [[k for k in {x for x in keys_of(text)[1] if _long(x, min_chars)}] for text in texts_of(block)]
            keys = [k for ks in each for k in ks]
            if keys:
                hits = bloom.has(_hashes(keys))
                new = [k for k, hit in zip(keys, hits, strict=True) if hit]
                size += sum(map(len, new))
                held.update(new)
                if place is not None:
                    at = [(i is None, i or 0, f, p) for i, f, p in zip(*(block.column(c).to_pylist() for c in ("doc_id", *place)), strict=True)]
                    rows = np.repeat(np.arange(len(each)), [len(ks) for ks in each])[hits].tolist()
                    for k, row in zip(new, rows, strict=True):
                        if k not in first or at[row] < first[k]:
                            first[k] = at[row]
            if len(held) > HELD_KEYS or size > HELD_BYTES:
                yield _counted(held, first)
                held, first, size = Counter(), {}, 0
        if held:
            yield _counted(held, first)

    if place is None:
        found = docs.select("text").mapInArrow(count, "key binary, n long")
        return found.groupBy("key").agg(F.sum("n").alias("n_docs")).where(F.col("n_docs") >= min_docs)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *place, "text").mapInArrow(count, "key binary, n long, no_id boolean, id long, file long, place long")
    each = found.groupBy("key").agg(F.sum("n").alias("n_docs"), F.min(F.struct("no_id", "id", "file", "place")).alias("first"))
    return each.where(F.col("n_docs") >= min_docs).select("key", "n_docs", "first.file", "first.place")


def _counted(held: Counter, first: dict) -> pa.RecordBatch:
    arrays = {"key": pa.array(held.keys(), pa.binary()), "n": pa.array(held.values(), pa.int64())}
    if first:
        for name, kind, column in zip(("no_id", "id", "file", "place"), (pa.bool_(), pa.int64(), pa.int64(), pa.int64()), zip(*(first[k] for k in held), strict=True), strict=True):
            arrays[name] = pa.array(column, kind)
    return pa.RecordBatch.from_pydict(arrays)


def _drop(text: str, frequent, own=()) -> tuple[str, int, int]:
    """The text without its frequent lines, but with the first line of each key of its own; lines before, lines dropped."""
    lines, keys = keys_of(text)
    if own:
        kept, due = [], set(own)
        for x, k in zip(lines, keys, strict=True):
            if k not in frequent or k in due:
                kept.append(x)
                due.discard(k)
    else:
        kept = [x for x, k in zip(lines, keys, strict=True) if k not in frequent]
    return b"\n".join(kept).decode("utf-8", "surrogatepass"), len(lines), len(lines) - len(kept)


def _applied(docs: DataFrame, min_docs: int, min_chars: int, columns: list[str], schema: str, make, broadcast_bytes: int, first: bool = False) -> DataFrame:
    """make(block, [(kept text, n_lines, n_dropped), ...]) over docs[columns], which include text."""
    spark = docs.sparkSession
    docs, place = placed(docs) if first else (docs, None)
    suspects = twice_seen(docs, filter_bits(docs.count()), min_chars)
    frequent = stored(frequent_lines(docs, suspects, min_docs, min_chars, place), "lines")
    size = frequent.agg(F.coalesce(F.sum(F.length("key") + (192 if first else 64)), F.lit(0))).first()[0]
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], *(place or []))
    if size <= broadcast_bytes:
        known, owned = set(), {}
        for r in frequent.toLocalIterator():
            known.add(key := bytes(r["key"]))
            if first:
                owned.setdefault((r["file"], r["place"]), []).append(key)
        shared = spark.sparkContext.broadcast((known, owned))

        def run(batches):
            known, owned = shared.value
            for block in blocks(batches):
                own = [owned.get(p, ()) for p in zip(*(block.column(c).to_pylist() for c in place), strict=True)] if first else [()] * block.num_rows
                yield make(block.select(columns), [_drop(t, known, o) for t, o in zip(texts_of(block), own, strict=True)])

        return rows.mapInArrow(run, schema)
    bits, data = suspects.bits, spark.sparkContext.broadcast(suspects.data.tobytes())

    def occurrences(batches):
        bloom = Bloom(bits, np.frombuffer(data.value, np.uint8))
        for block in blocks(batches):
            out = []
            for text in set(texts_of(block)):
                keys = list({x for x in keys_of(text)[1] if x})
                if keys:
                    digest = hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()
                    out += [(digest, k) for k, hit in zip(keys, bloom.has(_hashes(keys)), strict=True) if hit]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], ["digest", "key"])

    per_text = docs.select("text").mapInArrow(occurrences, "digest binary, key binary").join(frequent.select("key"), "key", "left_semi").groupBy("digest").agg(F.collect_set("key").alias("keys"))
    digest, keys, own = fresh(rows, "digest", "keys", "own")
    told = rows.withColumn(digest, text_digest()).join(per_text.withColumnsRenamed({"digest": digest, "keys": keys}), digest, "left").drop(digest)
    if first:
        told = told.join(frequent.groupBy(F.col("file").alias(place[0]), F.col("place").alias(place[1])).agg(F.collect_list("key").alias(own)), place, "left")

    def run_told(batches):
        for block in blocks(batches):
            each = [frozenset(x or ()) for x in block.column(keys).to_pylist()]
            mine = [x or () for x in block.column(own).to_pylist()] if first else [()] * block.num_rows
            yield make(block.select(columns), [_drop(t, k, o) for t, k, o in zip(texts_of(block), each, mine, strict=True)])

    return told.mapInArrow(run_told, schema)


def line_digests(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what stays, for every row."""

    def make(block, results):
        return pa.RecordBatch.from_arrays(
            [block.column("doc_id").cast(pa.int64()), pa.array([r[1] for r in results], pa.int64()), pa.array([r[2] for r in results], pa.int64()), pa.array([hashlib.sha256(r[0].encode("utf-8", "surrogatepass")).hexdigest() for r in results])],
            ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )

    return _applied(docs, min_docs, min_chars, ["doc_id", "text"], "doc_id long, n_lines long, n_dropped long, kept_sha256 string", make, broadcast_bytes)


def dedupe_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, broadcast_bytes: int = BROADCAST_BYTES, first: bool = False) -> DataFrame:
    """docs without the frequent lines: text holds what stays (n_chars, if there, its length), all else is handed through.

    With first, the first occurrence of each frequent line stays. Rows are told apart by their file and place in it then.
    """
    columns = docs.columns

    def make(block, results):
        arrays = []
        for field in block.schema:
            if field.name == "text":
                arrays.append(pa.array([r[0] for r in results], field.type))
            elif field.name == "n_chars":
                arrays.append(pa.array([len(r[0]) for r in results], field.type))
            else:
                arrays.append(block.column(field.name))
        return pa.RecordBatch.from_arrays(arrays, names=block.schema.names)

    return _applied(docs, min_docs, min_chars, columns, docs.schema, make, broadcast_bytes, first)
