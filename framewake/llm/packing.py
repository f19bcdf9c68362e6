"""Vector bin packing of examples into fixed-length sequences under limits on tokens, segments and loss tokens.

Pieces wait in classes of equal demand (tokens, loss tokens). A sequence is filled one piece at a time: among the
classes that fit in what is left in every dimension, the one with the largest dot product of demand and remaining
room is taken, each dimension weighted by the mean demand. When no whole piece fits, one is cut to the remaining
room. Full-length cuts of long examples are sequences of their own. Each task packs its own partition in bounded
pools and carries the pieces of the last open sequence on, so no shuffle takes place and one sequence at most
for each partition stays short.

Null and empty texts are the end id alone. Repeated rows and ids are packed as separate examples. An empty table
gives an empty result. A null doc_id stays null.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .chunks import BLOCK_BYTES, encoder_for, tidy, vocabulary, with_end
from .common import blocks

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
#: Tokens of waiting pieces at which a task packs its pool.
POOL_TOKENS = 1 << 20
#: Sequences that one task can number.
SEQUENCES = 1 << 36


class VectorPacker:
    """Pieces in, filled sequences out. A piece is (tag, start, tokens, loss, ids).

    cut(piece, tokens, loss) gives the largest head of a piece that fits in so many tokens and loss tokens, and the
    rest; or None if none does.
    """

    def __init__(self, tokens: int, segments: int, loss: int, cut: Callable | None = None):
        self.limits = np.array([tokens, segments, loss], float)
        self.tokens, self.segments, self.loss, self.cut, self.waiting = tokens, segments, loss, cut, 0
        self.slot: dict[tuple[int, int], int] = {}
        self.pieces: list[deque] = []
        self.demand, self.count, self.sizes = np.zeros((0, 3)), np.zeros(0, np.int64), np.zeros((0, 3), np.int64)

    def add(self, piece: tuple) -> None:
        key = piece[2], piece[3]
        k = self.slot.setdefault(key, len(self.pieces))
        if k == len(self.pieces):
            self.pieces.append(deque())
            self.sizes = np.vstack([self.sizes, [[key[0], 1, key[1]]]])
            self.demand = self.sizes / self.limits
            self.count = np.append(self.count, 0)
        self.pieces[k].append(piece)
        self.count[k] += 1
        self.waiting += piece[2]

    def _take(self, k: int) -> tuple:
        piece = self.pieces[k].popleft()
        self.count[k] -= 1
        self.waiting -= piece[2]
        return piece

    def pack(self, last: bool = False) -> Iterator[list[tuple]]:
        """Sequences while the waiting pieces can fill one; with last, until none waits."""
        while self.waiting >= self.tokens or (last and self.count.any()):
            classes = len(self.count)
            weighted = self.demand * (self.demand * self.count[:, None]).sum(0)
            left, chosen = np.array([self.tokens, self.segments, self.loss]), []
            while left[0] and left[1]:
                fits = (self.count[:classes] > 0) & (self.sizes[:classes] <= left).all(1)
                if fits.any():
                    piece = self._take(int(np.argmax(np.where(fits, weighted @ (left / self.limits), -1.0))))
                else:
                    there = self.count > 0
                    if self.cut is None or not there.any():
                        break
                    piece = self._take(int(np.argmax(np.where(there, self.sizes[:, 0], -1))))
                    parts = self.cut(piece, int(left[0]), int(left[2]))
                    if parts is None:
                        self.add(piece)
                        break
                    piece, rest = parts
                    self.add(rest)
                chosen.append(piece)
                left = left - (piece[2], 1, piece[3])
            if not chosen:
                raise ValueError("an example exceeds the limits and may not be cut")
            yield chosen


def _cut(piece: tuple, tokens: int, loss: int) -> tuple[tuple, tuple] | None:
    """The head that fits and the rest; the first id of a piece has no context there and bears no loss."""
    tag, start, size, _, ids = piece
    n = min(tokens, loss + 1)
    return ((tag, start, n, n - 1, ids[:n]), (tag, start + n, size - n, size - n - 1, ids[n:])) if 0 < n < size else None


def pack_documents(docs: DataFrame, vocab: str = "byte_bpe_50k.json", end_id: int = 0, tokens: int = 1024, segments: int = 256, loss: int = 1023) -> DataFrame:
    """Pieces of all documents with the sequence and offset that hold them; a document's ids end with end_id.

    A piece bears loss on all its ids but the first. Documents may be cut anywhere; each id is in exactly one piece.
    """

    def run(batches):
        encoder = encoder_for(vocabulary(vocab))
        packer = VectorPacker(tokens, segments, loss, _cut)
        at = TaskContext.get().partitionId() * SEQUENCES

        def rows(sequences):
            nonlocal at
            out = []
            for sequence in sequences:
                offset = 0
                for (doc, n), start, length, bears, ids in sequence:
                    out.append((doc, start, length, zlib.crc32(ids), n, at, offset, bears))
                    offset += length
                at += 1
                if len(out) >= 20_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

        def full(docs, each, begins, flat):
            """Runs of full length, a sequence each; the rest of each document waits in the packer."""
            for doc, n, a in zip(docs, each, begins, strict=True):
                whole = n - n % tokens if loss >= tokens - 1 else 0
                for i in range(0, whole, tokens):
                    yield [((doc, n), i, tokens, tokens - 1, flat[a + i : a + i + tokens])]
                if n > whole:
                    packer.add(((doc, n), whole, n - whole, n - whole - 1, flat[a + whole : a + n].copy()))

        for block in blocks(batches, max_bytes=BLOCK_BYTES):
            flat, each = encoder.encode(block.column("text"))
            flat, each = with_end(flat, each, end_id)
            yield from rows(full(block.column("doc_id").to_pylist(), each.tolist(), (np.cumsum(each) - each).tolist(), flat))
            if packer.waiting >= POOL_TOKENS:
                yield from rows(packer.pack())
        yield from rows(packer.pack(last=True))
        tidy()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)


def pack_examples(examples: DataFrame, key: str, n_tokens: str, n_loss: str, tokens: int = 1024, segments: int = 64, loss: int = 1024) -> DataFrame:
    """Whole, uncut examples (instruction data) into sequences under the three limits.

    Returns key, sequence_id, offset, length and loss_tokens. Null counts are 0. An example that alone exceeds a
    limit is an error, never dropped. An example of no tokens still takes one of the segments.
    """
    from pyspark.sql import functions as F

    rows = examples.select(F.col(key).alias("key"), F.coalesce(F.col(n_tokens), F.lit(0)).cast("long").alias("n"), F.coalesce(F.col(n_loss), F.lit(0)).cast("long").alias("bears"))
    kind = rows.schema["key"].dataType

    def run(batches):
        packer, at, empty = VectorPacker(tokens, segments, loss), TaskContext.get().partitionId() * SEQUENCES, []

        def out(sequences):
            nonlocal at
            got = []
            for sequence in sequences:
                offset = 0
                for tag, _, n, bears, _ in sequence:
                    got.append((tag, at, offset, n, bears))
                    offset += n
                at += 1
            if got:
                cols = list(zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], arrow_kind), *(pa.array(c, pa.int64()) for c in cols[1:])], ["key", "sequence_id", "offset", "length", "loss_tokens"])

        for batch in batches:
            arrow_kind = batch.schema.field("key").type
            for tag, n, bears in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n:
                    packer.add((tag, 0, n, bears, None))
                else:
                    empty.append((tag, 0, 0, bears, None))
                if len(empty) == segments:
                    yield from out([empty])
                    empty = []
            if packer.waiting >= POOL_TOKENS:
                yield from out(packer.pack())
        if empty:
            yield from out([empty])
        yield from out(packer.pack(last=True))

    return rows.mapInArrow(run, f"key {kind.simpleString()}, sequence_id long, offset long, length long, loss_tokens long").withColumnRenamed("key", key)
