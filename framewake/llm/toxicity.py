"""Toxicity by a support vector machine with a gap-weighted subsequence kernel and Nyström landmarks.

The kernel of two words sums, over all sequences of LENGTH characters that occur in order in both within SPAN
places, the product of DECAY ** (places spanned): inserted characters weaken a match and do not break it. Landmarks are
words of the training documents; the kernel against them, whitened (Nyström), gives the features of a linear machine
with squared hinge loss. A document is as toxic as its worst word: labels belong to documents, so training alternates
between choosing each toxic document's word of highest score and fitting (all words of other documents are negative).
As the machine is linear in the kernel, its weights and landmarks fold into one table of subsequence weights, which
gives the same score for a word without the landmarks. Runs of single characters count as a word, too.

Training rows are at most TRAIN_TOXIC and TRAIN_OTHER labelled documents, chosen by a hash of doc_id among rows that
are not held out; of rows with one doc_id the text of least hash is taken. Training looks at a bounded number of each
document's words (LENT_*), scoring at all of them. Null and empty texts score as a text without any word of four letters. Repeated rows get equal
results; a doc_id with several labels is toxic if one says so; an empty table gives an empty result; without labels of
both kinds every score is 0. Extra columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_documents, texts_of

LENGTH, SPAN, DECAY = 4, 7, 0.75
TRAIN_TOXIC, TRAIN_OTHER = 1500, 3000
#: Words that a toxic and another training document lend to training: those that speak most for toxicity at first, and of all
#: others, in order, about so many more.
LENT_TOXIC, LENT_OTHER, LENT_MORE = 16, 8, 4
TOXIC_LANDMARKS, OTHER_LANDMARKS = 64, 32
#: A run of characters speaks for toxicity from this root of the likelihood ratio and these log odds on.
SURE, LEAN = 4.5, 2.5
#: Weight of all other documents against all toxic ones when scores become probabilities.
CAUTION = 3.0
#: Words that a toxic document lends as examples in each round.
PICKED = 4
#: Longer words are scored by overlapping pieces of this many characters.
PIECE = 24
REMEMBERED = 400_000
SYMBOLS = 29  # 0 between words, 26 letters, other letters, all else
OFFSETS = [(0, *c) for c in combinations(range(1, SPAN), LENGTH - 1)]
RUN = re.compile(r"(?<!\S)\S(?:\s+\S){3,}(?!\S)")


class _Letters(dict):
    """Characters to codes; accents are dropped."""

    def __missing__(self, c: int) -> str:
        base = unicodedata.normalize("NFKD", chr(c))[0].lower()
        code = ord(base) - 96 if "a" <= base <= "z" else 27 if base.isalpha() else 28
        self[c] = chr(code)
        return self[c]


_LETTERS = _Letters({0: "\0"})
_GAP = "\0" * (SPAN - 1)


def pieces_of(word: str) -> list[str]:
    """What of a token is scored: without punctuation at its ends, and without any inside."""
    bare = word.strip(".,;:!?\"'()[]{}<>«»“”„¿¡|*#$%&-_/\\")
    out = [bare]
    if not bare.isalpha():
        out.append("".join(c for c in bare if c.isalpha()))
    out = [w for w in out if len(w) >= LENGTH]
    return [w[i : i + PIECE] for w in out for i in range(0, max(1, len(w) - PIECE // 2), PIECE // 2)]


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words with gaps between, and where each word begins."""
    flat = np.frombuffer((_GAP.join(words) + _GAP).translate(_LETTERS).encode("latin-1"), np.uint8).astype(np.int32)
    sizes = np.array([len(w) + len(_GAP) for w in words], np.int64)
    return flat, np.cumsum(sizes) - sizes


def _index(flat: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    n = len(flat) - SPAN + 1
    out = flat[:n] * SYMBOLS
    for k, o in enumerate(offsets[1:]):
        out = out + flat[o : o + n]
        if k < LENGTH - 2:
            out *= SYMBOLS
    return out


def features(word: str) -> tuple[np.ndarray, np.ndarray]:
    """The word's subsequences and their weights, sparse."""
    flat, _ = codes([word])
    table: dict[int, float] = {}
    for offsets in OFFSETS:
        index = _index(flat, offsets)
        cs = [flat[o : o + len(index)] for o in offsets]
        for i in index[np.logical_and.reduce([c > 0 for c in cs])].tolist():
            table[i] = table.get(i, 0.0) + DECAY ** (offsets[-1] + 1)
    return np.array(list(table), np.int64), np.array(list(table.values()))


def table_of(parts) -> np.ndarray:
    """The dense table of a weighted sum of words' features: (weight, index, value)."""
    out = np.zeros(SYMBOLS**LENGTH, np.float32)
    for weight, index, value in parts:
        out[index] += weight * value
    return out


def _damping() -> np.ndarray:
    """For each word length, the fourth root of the kernel of a word with itself (all its sequences distinct)."""
    n = np.arange(PIECE + LENGTH * 20)
    own = sum(np.maximum(0, n - o[-1]) * DECAY ** (2 * (o[-1] + 1)) for o in OFFSETS)
    return np.maximum(own, DECAY ** (2 * LENGTH)) ** 0.25


DAMPING = _damping()


def word_scores(words: list[str], table: np.ndarray, block: int = 200_000) -> np.ndarray:
    """Inner products of each word's features with the table, damped by the word's length."""
    out = np.zeros(len(words))
    at = 0
    while at < len(words):
        part = words[at : at + max(1, block // 16)]
        flat, begins = codes(part)
        total = np.zeros(len(flat) - SPAN + 1, np.float32)
        for offsets in OFFSETS:
            total += table[_index(flat, offsets)] * np.float32(DECAY ** (offsets[-1] + 1))
        out[at : at + len(part)] = np.add.reduceat(np.append(total, np.zeros(SPAN, np.float32)), begins) / DAMPING[[min(len(w), len(DAMPING) - 1) for w in part]]
        at += len(part)
    return out


def tokens(text: str) -> set[str]:
    low = text.lower()
    found = set(low.split())
    if len(text) > 6:
        found.update("".join(m[0].split()) for m in RUN.finditer(low))
    return found


@dataclass
class ToxicModel:
    table: np.ndarray | None
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.offset, -50, 50)))


def _grams(words: list[str]) -> list[np.ndarray]:
    """The runs of LENGTH characters in each word."""
    flat, begins = codes(words)
    plain = tuple(range(LENGTH))
    index = _index(flat, plain)
    whole = np.logical_and.reduce([flat[o : o + len(index)] > 0 for o in plain])
    ends = np.append(begins[1:], len(index))
    return [index[a:b][whole[a:b]] for a, b in zip(begins.tolist(), np.minimum(ends, len(index)).tolist(), strict=True)]


def _landmarks(words: list[str], grams: list[np.ndarray], docs: list[np.ndarray], toxic: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Word numbers of the landmarks, and how far each run of characters speaks for toxic documents."""
    seen = np.zeros((2, SYMBOLS**LENGTH), np.int32)
    of_doc = []
    for at, t in zip(docs, toxic, strict=True):
        g = np.unique(np.concatenate([grams[k] for k in at])) if len(at) else np.zeros(0, np.int32)
        of_doc.append(g)
        seen[int(t), g] += 1
    n = np.array([(~toxic).sum(), toxic.sum()])
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    # signed root of the likelihood ratio: how sure it is that the run leans to toxic documents
    total, share = seen.sum(0), n[1] / n.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(seen[1] > 0, seen[1] * np.log(seen[1] / (total * share)), 0) + np.where(seen[0] > 0, seen[0] * np.log(seen[0] / (total * (1 - share))), 0)
    z = np.sqrt(np.maximum(0, 2 * ratio))
    z[(total == 0) | (z < SURE) | (odds < LEAN)] = 0
    containing = np.zeros(len(words), np.int32)
    for at, t in zip(docs, toxic, strict=True):
        if t:
            containing[at] += 1
    best_gram = np.array([z[g].max() if len(g) else 0.0 for g in grams])
    chosen: list[int] = []
    left = [g for g, t in zip(of_doc, toxic, strict=True) if t]
    taken: set[int] = set()
    by_gram: dict[int, list[int]] = {}
    for k in np.flatnonzero(best_gram > 0).tolist():
        for g in grams[k].tolist():
            if z[g] > 0:
                by_gram.setdefault(g, []).append(k)
    # greedily: the run of most weight in documents not yet covered three times, and the word that carries it most often
    cover = np.zeros(len(left), np.int32)
    flat = np.concatenate(left) if left else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(left)), [len(g) for g in left])
    use = z[flat] > 0
    flat, of = flat[use], of[use]
    while len(chosen) < TOXIC_LANDMARKS and len(flat):
        open_ = cover[of] < 3
        gain = np.bincount(flat[open_], minlength=1)
        if not len(gain) or not gain.any():
            break
        at = np.flatnonzero(gain)
        ok = np.array([int(g) not in taken and int(g) in by_gram for g in at])
        if not ok.any():
            break
        at = at[ok]
        g = int(at[np.argmax(gain[at] * np.sqrt(z[at]))])
        taken.add(g)
        options = [k for k in by_gram[g] if k not in chosen]
        if options:
            chosen.append(max(options, key=lambda k: (containing[k], -len(words[k]), words[k])))
        cover[np.unique(of[flat == g])] += 1
    calm = sorted((k for k in range(len(words)) if best_gram[k] == 0), key=lambda k: zlib.crc32(words[k].encode("utf-8", "replace")))[:OTHER_LANDMARKS]
    return chosen + calm, z


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1.0) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps; both classes weigh alike."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    c = np.where(y > 0, weight / weight[y > 0].sum(), weight / weight[y < 0].sum()) * len(y) / 2
    w = np.zeros(x1.shape[1])
    ridge = np.eye(x1.shape[1]) * decay
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        active = y * (x1 @ w) < 1
        a = x1[active] * c[active, None]
        new = np.linalg.solve(ridge + a.T @ x1[active], a.T @ y[active])
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w[:-1], float(w[-1])


def train(documents: list[set[str]], labels: list[int], rounds: int = 5) -> ToxicModel:
    """The machine from documents' tokens and labels."""
    toxic = np.array(labels, bool)
    if not toxic.any() or toxic.all():
        return ToxicModel(None, 0.0)
    number: dict[str, int] = {}
    docs = [np.unique(np.array([number.setdefault(p, len(number)) for t in sorted(found) for p in pieces_of(t)], np.int64)) for found in documents]
    words = list(number)
    if not words:
        return ToxicModel(None, 0.0)
    grams = _grams(words)
    marks, z = _landmarks(words, grams, docs, toxic)
    first = np.array([z[g].max() if len(g) else 0.0 for g in grams])
    # candidates: of each document the words that speak most for toxicity at first, and some others
    candidates = [np.unique(np.concatenate([at[np.argsort(-first[at], kind="stable")[: LENT_TOXIC if t else LENT_OTHER]], at[:: max(1, len(at) // LENT_MORE)]])) if len(at) else at for at, t in zip(docs, toxic, strict=True)]
    used = np.unique(np.concatenate(candidates))
    place = {int(k): i for i, k in enumerate(used)}
    some = [words[k] for k in used]
    mark_features = [features(words[k]) for k in marks]
    norm = np.array([np.sqrt((v * v).sum()) or 1.0 for _, v in mark_features])
    kernel = np.stack([word_scores(some, table_of([(1 / n, i, v)])) for n, (i, v) in zip(norm, mark_features, strict=True)], 1)
    inner = np.stack([word_scores([words[k] for k in marks], table_of([(1 / n, i, v)])) for n, (i, v) in zip(norm, mark_features, strict=True)], 1) / norm[:, None]
    size, axes = np.linalg.eigh((inner + inner.T) / 2)
    keep = size > 1e-4 * size.max()
    white = axes[:, keep] / np.sqrt(size[keep])
    x = kernel @ white
    local = [np.array([place[int(k)] for k in c], np.int64) for c in candidates]
    score, sign = first[used], first[used] > 0
    calm = np.unique(np.concatenate([c for c, t in zip(local, toxic, strict=True) if not t] or [np.zeros(0, np.int64)]))
    for _ in range(rounds):
        # of each toxic document, the words of highest score among those with a sign; as heavy as the documents that chose them
        signs = [c[sign[c]] for c, t in zip(local, toxic, strict=True) if t and len(c)]
        picked = np.concatenate([c[np.argsort(-score[c], kind="stable")[:PICKED]] for c in signs] or [np.zeros(0, np.int64)])
        worst, times = np.unique(picked, return_counts=True)
        fair = ~np.isin(worst, calm)  # a word of other documents is no sign of toxicity
        worst, times = worst[fair], times[fair]
        if not len(worst) or not len(calm):
            return ToxicModel(None, 0.0)
        at = np.concatenate([worst, calm])
        w, bias = _machine(x[at], np.repeat([1.0, -1.0], [len(worst), len(calm)]), np.concatenate([times, np.ones(len(calm))]))
        score = x @ w + bias
    alpha = (white @ w) / norm
    table = table_of([(a, i, v) for a, (i, v) in zip(alpha, mark_features, strict=True)])
    model = ToxicModel(table, bias)
    everything = word_scores(words, table) + bias
    top = np.array([everything[at].max() if len(at) else bias for at in docs])
    # Platt's scaling; a document wrongly called toxic weighs more, and few documents leave the slope near 2
    a, b = 2.0, 0.0
    weight = np.where(toxic, 1 / toxic.sum(), CAUTION / (~toxic).sum())
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * top + b, -30, 30)))
        e, h = weight * (p - toxic), weight * p * (1 - p)
        grad = np.array([(e * top).sum() + 0.01 * (a - 2), e.sum()])
        hess = np.array([[(h * top * top).sum() + 0.01, (h * top).sum()], [(h * top).sum(), h.sum() + 0.01]])
        step = np.clip(np.linalg.solve(hess, grad), -0.5, 0.5)
        a, b = max(0.1, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    model.slope, model.offset = float(a), float(b)
    return model


class Scorer:
    def __init__(self, model: ToxicModel):
        self.model, self.known = model, {}

    def worst(self, texts: list[str]) -> np.ndarray:
        """The highest word score of each text."""
        found = [tokens(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = list(set().union(*found).difference(known)) if found else []
        parts = [(k, p) for k, t in enumerate(new) for p in pieces_of(t)]
        best = np.full(len(new), self.model.bias)
        if parts:
            np.maximum.at(best, np.array([k for k, _ in parts]), word_scores([p for _, p in parts], self.model.table) + self.model.bias)
        known.update(zip(new, best.tolist(), strict=True))
        return np.array([max(map(known.__getitem__, f), default=self.model.bias) for f in found])


def _held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """The model of labelled documents that are not held out, from a bounded number of them."""
    marks = labels.where(~_held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for value, most in ((1, TRAIN_TOXIC), (0, TRAIN_OTHER)):
        part = marks.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id")
    # one text of each doc_id, however many rows have it: TRAIN_TOXIC + TRAIN_OTHER rows; each task hands on one
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def words(batches):
        for block in batches:
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("toxic").cast(pa.int64()), pa.array([sorted(tokens(t)) for t in texts_of(block)], pa.list_(pa.string()))], ["doc_id", "toxic", "words"])

    got = map_documents(rows, words, "doc_id long, toxic long, words array<string>", keep=("doc_id", "toxic")).toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable").tolist()
    found, toxic = got.column("words").to_pylist(), got.column("toxic").to_pylist()
    return train([set(found[k]) for k in order], [toxic[k] for k in order])


def score_toxicity(docs: DataFrame, labels: DataFrame, model: ToxicModel | None = None, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels))  # one table of SYMBOLS ** LENGTH numbers

    def run(batches):
        scorer = Scorer(shared.value)
        for block in batches:
            ids = block.column("doc_id").to_pylist()
            if scorer.model.table is None:
                score = np.zeros(len(ids))
            else:
                score = scorer.model.probability(scorer.worst(texts_of(block)))
            held = [zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1 for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_documents(docs, run, "doc_id long, held_out boolean, score double, predicted int")
