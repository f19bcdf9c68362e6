"""Frame descriptors: an encoder registry, the built-in colour and gradient histogram, and the mean of several views.

An encoder is a function of an array of frames (n, height, width, 3; bytes) that gives unit vectors (n, dim).
Encoding is a map over Arrow batches; frames of one size are encoded together.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import l2_normalize

GRID, COLOURS, ANGLES = 4, 8, 8
#: Frames that a task encodes at once.
HELD_FRAMES = 1024


def _area_weights(to: int, of: int) -> np.ndarray:
    """How much each of `of` pixels weighs in each of `to` pixels that cover the same length."""
    edge, pixel = np.arange(to + 1) * of / to, np.arange(of)
    shared = np.minimum(edge[1:, None], pixel + 1) - np.maximum(edge[:-1, None], pixel)
    return np.maximum(shared, 0) * to / of


def centre_crop(frames: np.ndarray, ratio: float) -> np.ndarray:
    """The middle part of each frame (at least 8 pixels, a tenth of a side), brought back to full size by the mean of the area."""
    ratio = min(1.0, max(0.1, ratio))
    h, w = frames.shape[1:3]
    ch, cw = max(8, int(h * ratio)), max(8, int(w * ratio))
    top, left = (h - ch) // 2, (w - cw) // 2
    middle = frames[:, top : top + ch, left : left + cw].astype(float)
    return np.rint(np.einsum("yi,xj,nijc->nyxc", _area_weights(h, ch), _area_weights(w, cw), middle, optimize=True)).astype(np.uint8)


def _cells(size: int) -> np.ndarray:
    """The grid row (or column) of each pixel row (or column)."""
    edges = (np.arange(1, GRID) * size / GRID).astype(int)
    return np.searchsorted(edges, np.arange(size), "right")


def colour_histogram(frames: np.ndarray) -> np.ndarray:
    """For each cell of a 4 x 4 grid three colour histograms and the gradient directions weighted by magnitude; unit length.

    Each pixel adds to four numbered bins, and one count over all numbers makes all histograms of all frames.
    """
    n, h, w, _ = frames.shape
    per_cell = 3 * COLOURS + ANGLES
    cell = (_cells(h)[:, None] * GRID + _cells(w)[None, :]) * per_cell
    base = np.arange(n)[:, None, None] * (GRID * GRID * per_cell) + cell[None]
    size = n * GRID * GRID * per_cell
    colour = frames.astype(np.int64) * COLOURS // 256 + np.arange(3) * COLOURS
    out = np.bincount((base[..., None] + colour).ravel(), minlength=size).astype(float)
    gray = frames.mean(3)
    dy, dx = np.gradient(gray, axis=1), np.gradient(gray, axis=2)
    turn = (np.arctan2(dy, dx) + np.pi) / (2 * np.pi)
    angle = np.minimum((turn * ANGLES).astype(np.int64), ANGLES - 1) + 3 * COLOURS
    out += np.bincount((base + angle).ravel(), np.hypot(dx, dy).ravel(), size)
    out = out.reshape(n, -1)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-8)


ENCODERS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"colorhist": colour_histogram}


def encode(frames: DataFrame, encoder: str = "colorhist", keys: tuple[str, ...] = ("media_id", "frame_idx"), crop: float = 1.0) -> DataFrame:
    """Descriptors of frame rows (keys, height, width, pixels as RGB bytes). Wrong sizes and null pixels give an error, not a failure."""
    if encoder not in ENCODERS:
        raise ValueError(f"unknown encoder {encoder!r}")
    fn = ENCODERS[encoder]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.select(*keys).schema)

    def run(batches):
        for batch in (whole.slice(i, HELD_FRAMES) for whole in batches for i in range(0, whole.num_rows, HELD_FRAMES)):
            h, w, raw = (batch.column(c).to_pylist() for c in ("height", "width", "pixels"))
            error, size, done = [None] * batch.num_rows, np.zeros(batch.num_rows + 1, np.int32), []
            groups: dict[tuple[int, int], list[int]] = {}
            for k in range(batch.num_rows):
                if raw[k] is None or not h[k] or not w[k] or len(raw[k]) != h[k] * w[k] * 3 or min(h[k], w[k]) < 8:
                    error[k] = "pixels do not fill the frame"
                else:
                    groups.setdefault((h[k], w[k]), []).append(k)
            for (a, b), at in groups.items():
                pixels = np.stack([np.frombuffer(raw[k], np.uint8).reshape(a, b, 3) for k in at])
                done.append((np.array(at), fn(centre_crop(pixels, crop) if crop < 1 else pixels)))
                size[done[-1][0] + 1] = done[-1][1].shape[1]
            offsets = np.cumsum(size, dtype=np.int32)
            flat = np.empty(int(offsets[-1]))
            for at, v in done:
                flat[offsets[at][:, None] + np.arange(v.shape[1])] = v
            out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([x is not None for x in error], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), out, pa.array(error, pa.string())], [*keys, "descriptor", "error"])

    return frames.select(*keys, "height", "width", "pixels").mapInArrow(run, f"{kinds}, descriptor array<double>, error string")


def byte_frames(rows: DataFrame, key: str, text: str, side: int) -> DataFrame:
    """All bytes of each text as square RGB frames, the last one padded with zeros: key, frame_idx, height, width, pixels.

    A null or an empty text is one frame with these pixels.
    """
    size = 3 * side * side
    starts = F.sequence(F.lit(1), F.greatest(F.length("_b"), F.lit(1)), F.lit(size))
    pieces = F.when(F.length("_b") > 0, F.transform(starts, lambda k: F.substring(F.col("_b"), k, size))).otherwise(F.array("_b"))
    each = rows.select(key, F.col(text).cast("binary").alias("_b")).select(key, F.posexplode(pieces).alias("frame_idx", "_p"))
    padded = F.when(F.length("_p") > 0, F.rpad("_p", size, F.lit(b"\0"))).otherwise(F.col("_p"))
    return each.select(key, "frame_idx", F.lit(side).alias("height"), F.lit(side).alias("width"), padded.alias("pixels"))


def index_or_errors(encoded: DataFrame, source: str = "source_id", error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Frames of the sources that could be encoded whole, and one row (source, error) for each of the others.

    A bad source stays out of the index and takes no other with it. Descriptors with numbers that are not finite are bad, too.
    The same holds for the shots of a query (source: shot_id), whose frames have no error column.
    """
    if error not in encoded.columns:
        encoded = encoded.withColumn(error, F.lit(None).cast("string"))
    broken = F.exists("descriptor", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    marked = encoded.withColumn("_e", F.coalesce(F.col(error), F.when(F.coalesce(broken, F.lit(True)), "descriptor is not finite")))
    errors = marked.where(F.col("_e").isNotNull()).groupBy(source).agg(F.min("_e").alias("error"))
    return encoded.join(errors.select(source), source, "left_anti").drop(error), errors


def cropped_views(frames: DataFrame, ratios: tuple[float, ...], encoder: str = "colorhist", keys: tuple[str, ...] = ("media_id", "frame_idx")) -> DataFrame:
    """Descriptors of the frames' centre crops: keys, descriptor, error and crop, once for each ratio below 1."""
    views = [encode(frames, encoder, keys, r).withColumn("crop", F.lit(r)) for r in ratios if r < 1]
    out = views[0]
    for v in views[1:]:
        out = out.unionByName(v)
    return out


def mean_of_views(views: DataFrame, *keys: str) -> DataFrame:
    """The unit mean of several descriptors of each frame, by place."""
    places = views.select(*keys, F.posexplode("descriptor").alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("x"))
    rows = places.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("descriptor"))
    return rows.withColumn("descriptor", l2_normalize(F.col("descriptor")))
