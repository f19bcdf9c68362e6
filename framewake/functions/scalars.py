"""Scalar expressions: all built-in, so they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ScoreConfig


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays; on unit vectors the cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.element_at(F.transform(F.array(F.struct(v.alias("v"), F.greatest(norm, F.lit(1e-8)).alias("n"))), lambda s: F.transform(s["v"], lambda x: x / s["n"])), 1)


def gem(v: Column, p: float = 4.0, floor: float = 1e-6) -> Column:
    """Generalised mean of an array."""
    return F.pow(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.pow(F.greatest(x.cast("double"), F.lit(floor)), F.lit(p))) / F.size(v), F.lit(1 / p))


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(as_col(low), F.least(as_col(high), x))


def rational(value: Column) -> Column:
    """'num/den' or a plain number as a rate; nothing, 'N/A' and a denominator of 0 give 0."""
    parts = F.split(F.trim(value), "/")
    num, den = F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")
    return F.coalesce(F.when(F.size(parts) > 1, F.try_divide(num, den)).otherwise(num), F.lit(0.0))


def orientation(width: Column, height: Column) -> Column:
    return F.when(height > width, "portrait").when(height < width, "landscape").otherwise("square")


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    both = overlap(a0, a1, b0, b1)
    union = (a1 - a0) + (b1 - b0) - both
    return F.when(union <= 1e-9, 0.0).otherwise(both / union)


def iou_2d(p: dict[str, Column], g: dict[str, Column]) -> Column:
    """Intersection over union of the rectangles query x source; no source, no overlap. Keys: q0, q1, s0, s1."""
    inter = overlap(p["q0"], p["q1"], g["q0"], g["q1"]) * overlap(p["s0"], p["s1"], g["s0"], g["s1"])
    area = lambda r: (r["q1"] - r["q0"]) * (r["s1"] - r["s0"])
    union = area(p) + area(g) - inter
    return F.when(p["s0"].isNull() | (union <= 1e-9), 0.0).otherwise(inter / union)


def composite(visual: Column, coverage: Column) -> Column:
    return visual * (0.5 + 0.5 * coverage)


def confidence(visual: Column, coverage: Column, margin: Column, r2: Column, rmse: Column, length: Column, cfg: ScoreConfig = ScoreConfig()) -> Column:
    """Weighted visual, temporal, margin and alignment scores, damped for short segments."""
    mar = clip(margin / (4 * cfg.margin_unit), 0.0, 1.0)
    ali = clip(0.5 * r2 + 0.5 * F.exp(-rmse / 0.5), 0.0, 1.0)
    total = cfg.visual + cfg.temporal + cfg.margin + cfg.alignment
    raw = (cfg.visual * clip(visual, 0.0, 1.0) + cfg.temporal * clip(coverage, 0.0, 1.0) + cfg.margin * mar + cfg.alignment * ali) / F.lit(total)
    return clip(raw * (0.85 + 0.15 * clip(length / 3.0, 0.4, 1.0)), 0.0, 1.0)


def status(conf: Column, margin: Column, cfg: ScoreConfig = ScoreConfig()) -> Column:
    return F.when((margin < cfg.margin_unit) & (conf < cfg.high), "UNKNOWN").when(conf >= cfg.high, "HIGH").when(conf >= cfg.medium, "MEDIUM").when(conf >= cfg.low, "LOW").otherwise("UNKNOWN")


def time_label(t: Column) -> Column:
    """MM-SS-cc; rounded to hundredths before it is split, so 64.995 s is 01-05-00."""
    c = F.bround(F.greatest(t, F.lit(0.0)) * 100, 0).cast("long")
    return F.format_string("%02d-%02d-%02d", F.floor(c / 6000), F.floor(c / 100) % 60, c % 100)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def clip_name(number: Column, source: Column, start: Column, end: Column) -> Column:
    return F.format_string("%03d_%s_%s_%s.mp4", number, stem(source), time_label(start), time_label(end))


def shown(x: Column, digits: int = 4) -> Column:
    """A metric for a report: '-' where it is missing or the sentinel of an empty set."""
    return F.when(x.isNull() | (x < 0), "-").otherwise(F.format_string(f"%.{digits}f", F.bround(x, digits)))


def params_hash(**params: Column) -> Column:
    """16 hex digits of the parameters as JSON with sorted keys."""
    return F.substring(F.sha2(F.to_json(F.struct(*[params[k].alias(k) for k in sorted(params)])), 256), 1, 16)


def fingerprint(length: Column, content: Column, sample: int = 1 << 20) -> Column:
    """SHA-256 of the size and the content, or for large files its first, middle and last part."""
    part = lambda at: F.substring(content, at, F.lit(sample))
    whole = content.cast("binary")
    sampled = F.concat(part(F.lit(1)), part((F.floor(length / 2) - sample // 2 + 1).cast("int")), part((length - sample + 1).cast("int")))
    return F.sha2(F.concat(length.cast("string").cast("binary"), F.when(length <= 3 * sample, whole).otherwise(sampled)), 256)
