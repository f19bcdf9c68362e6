"""Shot detection from a series of change scores, and the building of shots. All media at once, one row per frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ShotConfig


def gray_histogram(pixels: Column, bins: int = 32) -> Column:
    """Share of the pixels (0-255) in each bin, for an array of pixel values."""
    width = 256 // bins
    counted = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(pixels, lambda p: F.floor(p / width) == b)))
    return F.transform(counted, lambda n: n / F.size(pixels))


def change_scores(frames: DataFrame, media: str, order: str, histogram: str, pixels: str) -> DataFrame:
    """Half the histogram distance to the frame before, half its mean pixel difference (thrice, at most 1)."""
    w = Window.partitionBy(media).orderBy(order)
    both = frames.withColumn("_h", F.lag(histogram).over(w)).withColumn("_p", F.lag(pixels).over(w))
    common = F.aggregate(F.zip_with(histogram, "_h", lambda x, y: F.least(x, y)), F.lit(0.0), lambda a, x: a + x)
    moved = F.aggregate(F.zip_with(pixels, "_p", lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x) / F.size(pixels) / 255
    return both.withColumn("score", F.when(F.col("_h").isNull(), 0.0).otherwise(0.5 * (1 - common) + 0.5 * F.least(3 * moved, F.lit(1.0)))).drop("_h", "_p")


def thresholds(scores: DataFrame, media: str, cfg: ShotConfig = ShotConfig()) -> DataFrame:
    """median, mad and the bounded threshold median + deviations * 1.4826 * mad of each medium."""
    med = scores.groupBy(media).agg(F.median("score").alias("med"))
    mad = scores.join(med, media).groupBy(media, "med").agg(F.median(F.abs(F.col("score") - F.col("med"))).alias("mad"))
    raw = F.col("med") + cfg.deviations * 1.4826 * F.col("mad")
    return mad.select(media, "med", "mad", F.least(F.lit(cfg.most_threshold), F.greatest(F.lit(cfg.least_threshold), raw)).alias("threshold"))


def peaks(scores: DataFrame, media: str, order: str, limits: DataFrame, cfg: ShotConfig = ShotConfig()) -> DataFrame:
    """Frames whose score is a local maximum (plateaus too), at or above the threshold and peak_ratio times the median."""
    w = Window.partitionBy(media).orderBy(order)
    none = F.lit(float("-inf"))
    around = scores.withColumn("_b", F.coalesce(F.lag("score").over(w), none)).withColumn("_a", F.coalesce(F.lead("score").over(w), none))
    high = (F.col("score") >= F.col("threshold")) & (F.col("score") >= cfg.peak_ratio * F.col("med"))
    return around.join(limits.select(media, "med", "threshold"), media).where(high & (F.col("_b") <= F.col("score")) & (F.col("_a") <= F.col("score"))).drop("_a", "_b", "med")


def spaced(times: Column, gap: float, first: Column) -> Column:
    """Greedily the times (an array) that lie at least gap after the one accepted before; first is accepted at the outset."""
    start = F.struct(first.cast("double").alias("last"), F.array().cast("array<double>").alias("kept"))

    def step(acc: Column, t: Column) -> Column:
        ok = t - acc["last"] >= gap
        return F.struct(F.when(ok, t).otherwise(acc["last"]).alias("last"), F.when(ok, F.concat(acc["kept"], F.array(t))).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(F.sort_array(times.cast("array<double>")), start, step, lambda acc: acc["kept"])


def build_shots(cuts: DataFrame, media: str, times: str, duration: str, cfg: ShotConfig = ShotConfig()) -> DataFrame:
    """Shots of each medium from its cuts (an array of times) and duration: a cover without gaps, numbered from 1.

    Stretches above max_shot are cut into equal parts, stretches of next to nothing dropped, a last shot of less than half
    min_shot joined to the one before.
    """
    inner = F.filter(spaced(F.col(times), cfg.min_shot, F.lit(0.0)), lambda t: t < F.col(duration) - 1e-3)
    bounds = F.concat(F.array(F.lit(0.0)), inner, F.array(F.col(duration).cast("double")))
    pairs = F.zip_with(F.slice(bounds, F.lit(1), F.size(bounds) - 1), F.slice(bounds, F.lit(2), F.size(bounds) - 1), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    long = F.filter(pairs, lambda s: s["end"] - s["start"] >= 1e-3)

    def parts(s: Column) -> Column:
        n = F.greatest(F.lit(1), F.ceil((s["end"] - s["start"]) / cfg.max_shot).cast("int"))
        each = (s["end"] - s["start"]) / n
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct((s["start"] + k * each).alias("start"), F.when(k == n - 1, s["end"]).otherwise(s["start"] + (k + 1) * each).alias("end")))

    rows = cuts.select(media, F.flatten(F.transform(long, parts)).alias("s"))
    n = F.size("s")
    last = F.element_at("s", -1)
    short = (n > 1) & (last["end"] - last["start"] < 0.5 * cfg.min_shot)
    before = F.try_element_at("s", F.lit(-2))
    joined = F.when(short, F.concat(F.slice("s", F.lit(1), F.greatest(n - 2, F.lit(0))), F.array(F.struct(before["start"].alias("start"), last["end"].alias("end"))))).otherwise(F.col("s"))
    return rows.where(n > 0).select(media, F.posexplode(joined).alias("i", "x")).select(media, (F.col("i") + 1).alias("shot_id"), "x.start", "x.end")


def fixed_cuts(duration: Column, window: float) -> Column:
    """Cuts at every multiple of the window before the end."""
    n = F.ceil(duration / window - 1e-12).cast("int") - 1
    return F.when(n < 1, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: k * F.lit(window)))


def detect_shots(frames: DataFrame, durations: DataFrame, media: str, ts: str, pixels: str, cfg: ShotConfig = ShotConfig()) -> DataFrame:
    """Shots of each medium from its gray frames, by the method of the settings: auto and histogram by changes, fixed by windows.

    Media of fewer than three frames have no cuts; those without frames are in durations (media, duration) alone.
    """
    if cfg.method not in ("auto", "histogram", "fixed"):
        raise ValueError(f"unknown shot method {cfg.method!r}")
    if cfg.method == "fixed":
        cuts = durations.select(media, "duration", fixed_cuts(F.col("duration"), cfg.fixed_window).alias("cuts"))
        return build_shots(cuts, media, "cuts", "duration", cfg)
    every = Window.partitionBy(media)
    with_hist = frames.withColumn("_g", gray_histogram(F.col(pixels))).withColumn("_n", F.count(F.lit(1)).over(every)).withColumn("_t0", F.min(ts).over(every)).where("_n >= 3")
    changes = change_scores(with_hist, media, ts, "_g", pixels).where(F.col(ts) > F.col("_t0"))  # a change lies between two frames
    found = peaks(changes, media, ts, thresholds(changes, media, cfg), cfg).groupBy(media).agg(F.collect_list(ts).alias("_c"), F.min("_t0").alias("_t0"))
    cuts = durations.join(found.select(media, spaced(F.col("_c"), cfg.min_shot, F.col("_t0")).alias("cuts")), media, "left")
    return build_shots(cuts.withColumn("cuts", F.coalesce("cuts", F.array().cast("array<double>"))), media, "cuts", "duration", cfg)
