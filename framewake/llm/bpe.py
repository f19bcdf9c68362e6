"""Byte-pair encoding by a pair occurrence index, and decoding.

The distinct pre-tokens of a partition's block form one symbol array with links to neighbours. An index maps each
mergeable pair to all places where it occurs. Ranks that are active (their pair occurs) are applied in ascending
order, each to all its places at once; a merge changes the pairs to its left and right, whose new places are appended
to their lists. A place whose pair has changed since is skipped. As a merge can only make pairs of later ranks, each
pre-token sees the merges in the order in which encoding it alone would make them.

A pre-token's ids do not depend on its text, so each distinct chunk (white space and what follows it) is encoded and
decoded once and texts are put together from chunks. Added tokens of the vocabulary split a text first, as the library does it.
Null and empty texts have no ids. Equal rows give equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .chunks import ChunkTable, binary_of, byte_letters, chunks_of, laid_out, tidy, vocabulary
from .common import blocks, gather

#: The pattern of byte-level pre-tokens (a fixed value).
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Chunks that are one pre-token.
PLAIN = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Distinct chunks and their bytes (ids, decimals and decoded) that a worker remembers; beyond it those of the last block stay.
REMEMBERED, REMEMBERED_BYTES = 1_500_000, 128 << 20
#: Text bytes whose new chunks are encoded together: ranks are gone through once for so much text.
BLOCK_BYTES = 16 << 20
NO = np.int64(-1)


class Vocabulary:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, letters = spec["model"]["vocab"], {c: b for b, c in byte_letters().items()}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = max([*ids.values(), *self.added.values()]) + 1
        self.bytes = [b""] * self.size
        for token, i in ids.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_ids[b] = ids[c]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        left, right = (np.array([ids[m[k]] for m in merges], np.int64) for k in (0, 1))
        self.merged = np.array([ids["".join(m)] for m in merges], np.int64)
        self.left, self.right = left, right
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; -1 where there is no merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO)


class PairIndex:
    """Rank of a pair -> the places (of its left symbol) where it was seen, and a heap of the ranks that are active."""

    def __init__(self):
        self.places: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []

    def add(self, ranks: np.ndarray, places: np.ndarray) -> None:
        keep = ranks >= 0
        ranks, places = ranks[keep], places[keep]
        if not len(ranks):
            return
        if len(ranks) > 1:
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            begins = [0, *cuts.tolist(), len(ranks)]
        else:
            begins = [0, 1]
        for rank, a, b in zip(ranks[begins[:-1]].tolist(), begins[:-1], begins[1:], strict=True):
            lists = self.places.get(rank)
            if lists is None:
                self.places[rank] = [places[a:b]]
                heapq.heappush(self.heap, rank)
            else:
                lists.append(places[a:b])

    def pop(self) -> tuple[int, np.ndarray]:
        """The least active rank and its places in ascending order."""
        rank = heapq.heappop(self.heap)
        lists = self.places.pop(rank)
        return rank, np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])


def merge_all(vocab: Vocabulary, symbols: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Applies all merges to the symbols, whose words (ascending numbers) bound them. Returns symbols and words of what is left."""
    n = len(symbols)
    if n < 2:
        return symbols, words
    sym = symbols.copy()
    right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
    edge = np.flatnonzero(words[1:] != words[:-1])
    right[edge], left[edge + 1] = -1, -1
    right[-1] = -1
    index = PairIndex()
    first = np.flatnonzero(right >= 0)
    index.add(vocab.rank_of(sym[first], sym[first + 1]), first)
    while index.heap:
        rank, at = index.pop()
        a, b, new = vocab.left[rank], vocab.right[rank], vocab.merged[rank]
        to = right[at]
        good = (sym[at] == a) & (to >= 0)
        good &= sym[to] == b
        at, to = at[good], to[good]
        if a == b and len(at) > 1:  # runs of one symbol: every other place, from the left
            linked = np.flatnonzero(to[:-1] == at[1:]) + 1
            if len(linked):
                run = np.ones(len(at), bool)
                run[linked] = False
                start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                take = (np.arange(len(at)) - start) % 2 == 0
                at, to = at[take], to[take]
        if not len(at):
            continue
        after = right[to]
        sym[at], sym[to] = new, -1
        right[at] = after
        has = after >= 0
        left[after[has]] = at[has]
        before = left[at]
        prior = before >= 0
        x, y = before[prior], at[prior]
        index.add(vocab.rank_of(sym[x], sym[y]), x)
        x, y = at[has], after[has]
        index.add(vocab.rank_of(sym[x], sym[y]), x)
    kept = sym >= 0
    return sym[kept], words[kept]


class IndexEncoder:
    """Texts to ids, their decimal text and their decoded bytes, by a table of distinct chunks."""

    def __init__(self, path: str, remembered: int = REMEMBERED, remembered_bytes: int = REMEMBERED_BYTES):
        self.vocab = Vocabulary(path)
        added = sorted(self.vocab.added, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.decimals = pa.array([b"%d," % i for i in range(self.vocab.size)], pa.binary())
        self.table = ChunkTable(self._learn, 3, remembered, remembered_bytes)

    def _columns(self, symbols: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
        """For chunks of counts ids each: the ids, their decimals, each with a comma after it, and the bytes they decode to."""
        ends = np.append(0, np.cumsum(counts))
        decimal, at = laid_out(self.decimals, pa.array(symbols), np.uint8)
        sizes = self.vocab.lengths[symbols]
        decoded = gather(self.vocab.flat, self.vocab.starts[symbols], sizes)
        total = np.append(0, np.cumsum(sizes))
        return [binary_of(symbols.astype(np.uint32), counts), binary_of(decimal, np.diff(at[ends])), binary_of(decoded, np.diff(total[ends]))]

    def _learn(self, new: pa.Array) -> list[pa.Array]:
        pieces, of = [], []
        for k, chunk in enumerate(new.cast(pa.string()).to_pylist()):
            if PLAIN.fullmatch(chunk):
                pieces.append(chunk.encode())
                of.append(k)
                continue
            for p in PRE_TOKEN.findall(chunk):
                pieces.append(p.encode())
                of.append(k)
        symbols = self.vocab.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        symbols, word = merge_all(self.vocab, symbols, np.repeat(np.arange(len(pieces)), [len(p) for p in pieces]))
        return self._columns(symbols, np.bincount(np.array(of, np.int64)[word], minlength=len(new)))

    def columns(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids, decimals with commas and decoded bytes of all texts in one array each, and where each text's begin (and the end)."""
        texts = pc.fill_null(texts, "")
        parts, of = texts, np.arange(len(texts))
        added: dict[int, str] = {}
        if self.split is not None:
            holds = np.any([pc.match_substring(texts, x).to_numpy(zero_copy_only=False) for x in self.vocab.added], axis=0)
            if holds.any():  # an added token is a part of its own
                cut, of = [], []
                for i, (text, held) in enumerate(zip(texts.to_pylist(), holds.tolist(), strict=True)):
                    for k, part in enumerate(self.split.split(text) if held else [text]):
                        if k % 2:
                            added[len(cut)] = part
                        cut.append("" if k % 2 else part)
                        of.append(i)
                parts, of = pa.array(cut, pa.string()), np.array(of)
        chunks, first = chunks_of(parts)
        numbers, values = self.table.look_up(chunks)
        own = self._columns(np.array([self.vocab.added[x] for x in added.values()], np.int64), np.ones(len(added), np.int64)) if added else []
        begin = np.searchsorted(of, np.arange(len(texts) + 1))
        out = []
        for k, (column, kind) in enumerate(zip(values, (np.uint32, np.uint8, np.uint8), strict=True)):
            flat, bounds = laid_out(column, numbers, kind)
            ends = bounds[first]
            if added:
                pieces, at, sizes = [], 0, np.diff(ends)
                for i, value in zip(added, own[k].to_pylist(), strict=True):
                    value = np.frombuffer(value, kind)
                    pieces += [flat[at : ends[i]], value]
                    at, sizes[i] = ends[i], len(value)
                flat, ends = np.concatenate([*pieces, flat[at:]]), np.append(0, np.cumsum(sizes))
            out.append((flat, ends[begin]))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        flat, at = self.columns(pa.array(texts, pa.string()))[0]
        return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.vocab.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


_ENCODERS: dict[str, IndexEncoder] = {}


def encoder_for(path: str) -> IndexEncoder:
    """This process's encoder of a vocabulary: a worker keeps it, and the chunks it knows, from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = IndexEncoder(path)
    return _ENCODERS[path]


def encode_decode(docs: DataFrame, vocab: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, number of ids, SHA-256 of the decimal ids joined by commas and of the decoded text, for every row."""

    def run(batches):
        encoder = encoder_for(vocabulary(vocab))
        for block in blocks(batches, max_bytes=BLOCK_BYTES):
            (_, tokens), (decimal, d), (decoded, t) = encoder.columns(block.column("text"))
            ids, texts = [], []
            for a, b, c, e in zip(d[:-1].tolist(), d[1:].tolist(), t[:-1].tolist(), t[1:].tolist(), strict=True):
                ids.append(hashlib.sha256(decimal[a : max(a, b - 1)]).hexdigest())
                texts.append(hashlib.sha256(decoded[c:e].tobytes().decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([block.column("doc_id").cast(pa.int64()), pa.array(np.diff(tokens)), pa.array(ids), pa.array(texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        tidy()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
