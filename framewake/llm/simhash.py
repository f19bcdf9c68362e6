"""SimHash near-duplicates by exact tiled comparison.

Distinct fingerprints are dealt to blocks so that any two within the radius meet in one block at least: 64 bits cut
into b parts, and one block key for each choice of b - radius parts, which two fingerprints within the radius must
share somewhere. In a block, fingerprints are ordered by population count and cut into tiles; tile pairs whose counts
differ beyond the radius are skipped, the others are compared in full with exclusive-or and bit counts. A block above
the tile bound is dealt to several tasks as (population count, salt) tiles and pairs of these, under the same rule.
A task hands on a spanning forest of its links, not the links, and components() joins the forests.

Copies share a fingerprint and enter once. Null and empty texts have fingerprint zero and link like any other. A null
doc_id takes part; a class of only such rows has a null component. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_documents, placed, stored, texts_of
from .components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Fingerprints that one task compares within a block; larger blocks are dealt as pairs of tiles.
BLOCK = 4096
#: Places of dropped rows (8 bytes each) that are broadcast; more of them meet the rows in a shuffled join.
LISTED_PLACES = 500_000
#: Rows of a tile inside a task.
TILE = 512


def fingerprint(text: str, shingle: int = 4) -> int:
    words = WORD.findall(text.encode("utf-8", "surrogatepass").lower())
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]  # noqa: B905
    hashes = np.array(list(map(xxhash.xxh64_intdigest, grams, repeat(42))), "<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and fp, a fingerprint's bits as a signed long, for every row."""

    def run(batches):
        for block in batches:
            fp = np.array([fingerprint(t, shingle) for t in texts_of(block)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in keep), pa.array(fp)], [*keep, "fp"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return map_documents(docs, run, f"{types}, fp long", keep=keep)


def _masks(parts: int, radius: int) -> list[int]:
    edge = [round(64 * i / parts) for i in range(parts + 1)]
    bits = [((1 << edge[i + 1]) - (1 << edge[i])) for i in range(parts)]
    return [sum(bits[i] for i in chosen) for chosen in combinations(range(parts), parts - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def parts_for(n: int, radius: int, block: int = BLOCK) -> int:
    """So many parts that n even fingerprints fill blocks of half the bound at most."""
    parts = radius + 1
    while parts < radius + 6 and n > (block // 2) * 2 ** (64 * (parts - radius) / parts):
        parts += 1
    return parts


def _forest(fps: np.ndarray, side: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (fp, a smaller linked fp) that connect what links in a block; with side, only across the two sides."""
    order = np.lexsort((fps, np.bitwise_count(fps)))
    fps, ones = fps[order], np.bitwise_count(fps[order]).astype(np.int16)
    side = None if side is None else side[order]
    root = np.arange(len(fps))
    for i in range(0, len(fps), TILE):
        a, most = fps[i : i + TILE], ones[min(i + TILE, len(fps)) - 1]
        for j in range(i, len(fps), TILE):
            if ones[j] - most > radius:
                break
            near = np.bitwise_count(a[:, None] ^ fps[None, j : j + TILE]) <= radius
            if i == j:
                near &= np.tri(len(a), dtype=bool).T
            if side is not None:
                near &= side[i : i + TILE, None] != side[None, j : j + TILE]
            x, y = np.nonzero(near)
            x, y = x + i, y + j
            x, y = x[x != y], y[x != y]
            while len(x):  # least root of both ends until none changes
                rx, ry = root[x], root[y]
                differ = rx != ry
                if not differ.any():
                    break
                x, y, rx, ry = x[differ], y[differ], rx[differ], ry[differ]
                np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
                while (root[root] != root).any():
                    root = root[root]
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return fps[moved], fps[root[moved]]


def links(classes: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """Edges a, b between distinct fingerprints (column fp) that connect all those within the radius of each other."""
    n = classes.count()
    masks = _masks(parts_for(n, radius, block), radius)
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    dealt = classes.select("fp", F.explode(keys).alias("k")).select("fp", "k.band", "k.key")
    big = dealt.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    marked = dealt.join(big, ["band", "key"], "left")
    plain = marked.where("n is null").select("band", "key", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side"), "fp")
    # tile of a big block: population count and salt; it meets itself and the tiles up to radius counts above
    ones, salts = F.bit_count("fp"), F.ceil(F.col("n") * 4 / F.lit(block)).cast("int")
    tiled = marked.where("n is not null").select("band", "key", "fp", "n", ones.alias("ones"), salts.alias("salts"), F.pmod(F.xxhash64("fp"), salts).cast("int").alias("salt"))
    mine = F.col("ones") * F.col("salts") + F.col("salt")
    others = F.transform(F.sequence(F.greatest(F.lit(0), F.col("ones") - radius) * F.col("salts"), (F.least(F.lit(64), F.col("ones") + radius) + 1) * F.col("salts") - 1), lambda t: F.struct(F.least(t, mine).alias("x"), F.greatest(t, mine).alias("y"), (t < mine).cast("int").alias("side")))
    split = tiled.select("band", "key", "fp", F.explode(others).alias("o")).select("band", "key", F.col("o.x").alias("x"), F.col("o.y").alias("y"), F.col("o.side").alias("side"), "fp")
    units = plain.union(split).repartition("band", "key", "x", "y").sortWithinPartitions("band", "key", "x", "y")

    def run(batches):
        held: list[np.ndarray] = []

        def done(rows: np.ndarray):
            two = rows["x"][0] != rows["y"][0]
            a, b = _forest(rows["fp"].view(np.uint64), rows["side"] if two else None, radius)
            return a.view(np.int64), b.view(np.int64)

        def edges(found):
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.empty(batch.num_rows, [("band", "i4"), ("key", "i8"), ("x", "i4"), ("y", "i4"), ("side", "i4"), ("fp", "i8")])
            for c in rows.dtype.names:
                rows[c] = batch.column(c).to_numpy()
            names = ("band", "key", "x", "y")
            new = np.ones(len(rows), bool)
            new[1:] = np.logical_or.reduce([rows[c][1:] != rows[c][:-1] for c in names])
            new[0] = last is None or any(rows[c][0] != last[c] for c in names)
            at, found = np.flatnonzero(new), []
            if not len(at) or at[0]:
                held.append(rows[: at[0]] if len(at) else rows)
            if len(at):
                if held:
                    group = np.concatenate(held)
                    if len(group) > 1:
                        found.append(done(group.copy()))
                for s, e in zip(at[:-1], at[1:], strict=True):
                    if e - s > 1:
                        found.append(done(rows[s:e].copy()))
                held = [rows[at[-1] :].copy()]
            last = rows[-1].copy()
            if found:
                yield edges(found)
        if held and len(group := np.concatenate(held)) > 1:
            yield edges([done(group)])

    return units.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, fingerprint and component_id (the smallest doc_id reachable over links) of every row."""
    rows = stored(fingerprints(docs, shingle, keep), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("fp"), radius))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(least, "root").select("fp", "component_id")
    return rows.join(of, "fp").select(*keep, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (of repeated ids, one row; null ids last).

    Rows are told apart by their file and their place in it, which do not depend on how the files are split.
    """
    rows, place = placed(docs)
    gone = stored(places_to_drop(rows, place, shingle, radius), "dropped")
    # texts stay where they are while the list of places may be broadcast, by its measured size
    return rows.join(F.broadcast(gone) if gone.count() <= LISTED_PLACES else gone, place, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def places_to_drop(docs: DataFrame, place: list[str], shingle: int, radius: int) -> DataFrame:
    """The places of the rows that are not the first of their component."""
    rows = stored(fingerprints(docs, shingle, ("doc_id", *place)), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), *place))
    classes = stored(rows.groupBy("fp").agg(first.alias("first")), "classes")
    roots = components(links(classes.select("fp"), radius))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    stays = named.groupBy("root").agg(F.min("first").alias("first"))
    of = named.select("fp", "root").join(stays, "root").select("fp", F.struct(*[F.col("first")[p] for p in place]).alias("_stays"))
    return rows.join(of, "fp").where(F.struct(*place) != F.col("_stays")).select(*place)
