"""Whole texts to token ids with the tokenizers library, each distinct chunk encoded once for many texts.

A chunk is a run of white space and what follows it up to the next; an ASCII letter also ends one if ASCII punctuation
follows. None of the two vocabularies lets a pre-token or a normalisation reach over the end of a chunk (white
space belongs to what follows it, letters and punctuation never share a pre-token), so the ids of a text are the ids of
its chunks one after another; tests hold this against whole-text encoding. Texts with an added token are encoded whole.

Texts stay Arrow columns: bounds of chunks are found over their bytes at once, chunks are slices of the same buffer,
Arrow numbers the distinct ones and puts their ids together, and Python sees only the chunks that are new. A new chunk
that is a plain word is one pre-token, which the library's model takes as it is; others go through the whole library.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct chunks and their bytes that one worker remembers; beyond it those of the last block stay, which costs time only.
REMEMBERED, REMEMBERED_BYTES = 1_500_000, 96 << 20
#: Text bytes that are cut and numbered together.
BLOCK_BYTES = 8 << 20
#: New chunks that the library encodes as one text, parted by an added token.
JOINED = 4096
_WHITE, _PUNCTUATION, _LETTER = 1, 2, 4
_WORD = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
#: Chunks by which an encoder finds out how its vocabulary takes plain words.
_TRIED = ["Word", " word", " WORD", " über", "Éreoué", " ñllrrll", " ßen", " a", " isanrending"]
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _WHITE
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum()]] = _PUNCTUATION
_CLASS[[b for b in range(128) if chr(b).isalpha()]] = _LETTER


def tidy() -> None:
    """Gives memory that a finished task of this worker no longer uses back to the machine."""
    pa.default_memory_pool().release_unused()


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _after_wide_white(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place is white space beyond ASCII (Unicode's White_Space, fixed values)."""
    a, b, c = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    return (
        ((b == 0xC2) & ((a == 0x85) | (a == 0xA0)))
        | ((c == 0xE1) & (b == 0x9A) & (a == 0x80))
        | ((c == 0xE2) & (b == 0x80) & ((a <= 0x8A) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF)))
        | ((c == 0xE2) & (b == 0x81) & (a == 0x9F))
        | ((c == 0xE3) & (b == 0x80) & (a == 0x80))
    )


def chunks_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts as a binary array over the texts' own bytes, and the number of the first chunk of each text (and the end)."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    buffers = texts.buffers()
    ends = np.frombuffer(buffers[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    low, high = int(ends[0]), int(ends[-1])
    if low == high:
        return pa.array([], pa.binary()), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[low:high]
    kind = _CLASS[data]
    white = kind == _WHITE
    begins = np.zeros(len(data) + 1, bool)
    begins[1:-1] = white[1:] & ~white[:-1]
    odd = np.flatnonzero(begins[1:-1] & (data[:-1] >= 0x80)) + 1
    begins[odd[_after_wide_white(data, odd)]] = False
    begins[1:-1] |= (kind[1:] == _PUNCTUATION) & (kind[:-1] == _LETTER)
    begins[ends - low] = True
    at = np.flatnonzero(begins)
    first = np.searchsorted(at, ends - low)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at + low).astype(np.int32)), buffers[2]]), first


class ChunkTable:
    """Distinct chunks seen so far and columns of bytes that learn(new chunks) makes of each."""

    def __init__(self, learn: Callable[[pa.Array], list[pa.Array]], columns: int, remembered: int = REMEMBERED, remembered_bytes: int = REMEMBERED_BYTES):
        self.learn, self.remembered, self.remembered_bytes = learn, remembered, remembered_bytes
        self.keys = pa.array([], pa.binary())
        self.columns = [pa.array([], pa.binary()) for _ in range(columns)]

    def look_up(self, chunks: pa.Array) -> tuple[pa.Array, list[pa.Array]]:
        """Numbers of distinct chunks, and each column's values for these."""
        coded = chunks.dictionary_encode()
        return coded.indices, self.values_of(coded.dictionary)

    def values_of(self, distinct: pa.Array) -> list[pa.Array]:
        """Each column's values for distinct chunks; what is new is learnt."""
        at = pc.index_in(distinct, value_set=self.keys)
        unknown = pc.is_null(at)
        new = distinct.filter(unknown)
        if len(new):
            gained = self.learn(new)
            place = at.to_numpy(zero_copy_only=False)
            missing = unknown.to_numpy(zero_copy_only=False)
            place[missing] = len(self.keys) + np.arange(len(new))
            at = pa.array(place.astype(np.int64))
            self.keys = pa.concat_arrays([self.keys, new])
            self.columns = [pa.concat_arrays([a, b]) for a, b in zip(self.columns, gained, strict=True)]
        values = [c.take(at) for c in self.columns]
        if len(self.keys) > self.remembered or sum(c.nbytes for c in (self.keys, *self.columns)) > self.remembered_bytes:
            self.keys, self.columns = distinct.take(pa.array(np.arange(len(distinct)))), values
            if sum(c.nbytes for c in (self.keys, *self.columns)) > self.remembered_bytes:
                self.keys, self.columns = self.keys[:0], [c[:0] for c in values]
        return values


def binary_of(flat: np.ndarray, lens: np.ndarray) -> pa.Array:
    """Slices of lens numbers of flat, one after another, as a binary array."""
    ends = np.append(0, np.cumsum(lens, dtype=np.int64)) * flat.itemsize
    if ends[-1] > np.iinfo(np.int32).max:
        raise ValueError("a block of over 2 GB of values")
    return pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def laid_out(values: pa.Array, numbers: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of all numbers, one after another, and where each begins (and the last ends), counted in kind."""
    got = values.take(numbers)
    size = np.dtype(kind).itemsize
    bounds = np.frombuffer(got.buffers()[1], np.int32)[got.offset : got.offset + len(got) + 1].astype(np.int64) // size if len(got) else np.zeros(1, np.int64)
    flat = np.frombuffer(got.buffers()[2], kind) if len(got) and got.buffers()[2] else np.zeros(0, kind)
    return flat[bounds[0] : bounds[-1]], bounds - bounds[0]


def with_end(ids: np.ndarray, each: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts with end_id after each text's, and the numbers of ids with it."""
    return np.insert(ids, np.cumsum(each), np.uint32(end_id)).astype("<u4", copy=False), each + 1


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = byte_letters()


def _lettered(text: str) -> str:
    return text.encode().decode("latin-1").translate(_LETTERS)


def _lettered_lower(text: str) -> str:
    return _lettered(text.strip().lower())


#: Forms of plain words and what makes one pre-token of them: white space and case kept, or dropped.
_PLAIN = [(re.compile(f" ?{_WORD}"), _lettered), (re.compile(f"[ \\t-\\r]*{_WORD}"), _lettered_lower)]


class ChunkEncoder:
    def __init__(self, path: str, remembered: int = REMEMBERED, remembered_bytes: int = REMEMBERED_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = [x.content.lower() for x in added.values()]
        self.begin = {x[:2] for x in self.added}
        #: An added token that stands for itself alone parts the chunks of one text.
        self.mark = next(((i, x.content) for i, x in added.items() if not (x.lstrip or x.rstrip or x.single_word or x.normalized)), None)
        self.model = self.tokenizer.model
        self.plain = self._plain_words()
        self.table = ChunkTable(self._learn, 1, remembered, remembered_bytes)

    def _plain_words(self) -> tuple[re.Pattern, Callable[[str], str]] | None:
        """The form of chunks that the model takes as one pre-token, if the library agrees on all that are tried."""
        right = [x.ids for x in self.tokenizer.encode_batch_fast(_TRIED, add_special_tokens=False)]
        for form, prepare in _PLAIN:
            if [[t.id for t in self.model.tokenize(prepare(x))] for x in _TRIED] == right:
                return form, prepare
        return None

    def _through_library(self, texts: list[str]) -> list[list[int]]:
        if self.mark is None:
            return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        mark, content = self.mark
        out = []
        for i in range(0, len(texts), JOINED):
            part = texts[i : i + JOINED]
            ids = self.tokenizer.encode_batch_fast([content.join(part)], add_special_tokens=False)[0].ids
            ends = [*np.flatnonzero(np.array(ids) == mark).tolist(), len(ids)]
            if len(ends) != len(part):
                raise ValueError("a chunk holds an added token")
            at = 0
            for end in ends:
                out.append(ids[at:end])
                at = end + 1
        return out

    def _learn(self, new: pa.Array) -> list[pa.Array]:
        texts = new.cast(pa.string()).to_pylist()
        got: list = [None] * len(texts)
        rest = range(len(texts))
        if self.plain:
            form, prepare = self.plain
            plain, tokenize = form.fullmatch, self.model.tokenize
            rest = []
            for i, text in enumerate(texts):
                if plain(text):
                    got[i] = [t.id for t in tokenize(prepare(text))]
                else:
                    rest.append(i)
        for i, ids in zip(rest, self._through_library([texts[i] for i in rest]), strict=True):
            got[i] = ids
        lens = np.fromiter(map(len, got), np.int64, len(got))
        return [binary_of(np.fromiter(chain.from_iterable(got), np.uint32, int(lens.sum())), lens)]

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each text. A null text is an empty one."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        whole = self._with_added(texts)
        if len(whole):
            mask = np.zeros(len(texts), bool)
            mask[whole] = True
            held = texts.take(pa.array(whole)).to_pylist()
            texts = pc.if_else(pa.array(mask), "", texts)
        chunks, first = chunks_of(texts)
        numbers, values = self.table.look_up(chunks)
        flat, bounds = laid_out(values[0], numbers, np.uint32)
        ends = bounds[first]
        if not len(whole):
            return flat, np.diff(ends)
        each, parts, at = np.diff(ends), [], 0
        for i, text in zip(whole.tolist(), held, strict=True):
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            parts += [flat[at : ends[i]], ids]
            at, each[i] = ends[i], len(ids)
        return np.concatenate([*parts, flat[at:]]), each

    def _with_added(self, texts: pa.Array) -> np.ndarray:
        """The places of texts that hold an added token, in whatever case."""
        found = [pc.match_substring(texts, x, ignore_case=x.lower() != x.upper()).fill_null(False).to_numpy(zero_copy_only=False) for x in self.begin]
        if not found or not np.any(found):
            return np.zeros(0, np.int64)
        maybe = np.flatnonzero(np.any(found, axis=0))
        lowered = [x.lower() for x in texts.take(pa.array(maybe)).to_pylist()]
        return maybe[[any(a in x for a in self.added) for x in lowered]] if len(maybe) else maybe


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder_for(path: str) -> ChunkEncoder:
    """This process's encoder of a vocabulary: a worker keeps it, and the chunks it knows, from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
