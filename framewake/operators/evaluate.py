"""Evaluation of predicted segments against ground truth, and roll-ups of benchmark runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import iou, iou_2d, overlap

HIDDEN = "_Hidden"


def match(truth: DataFrame, predictions: DataFrame, least_overlap: float = 0.3, width: float = 16.0) -> DataFrame:
    """For each true segment the prediction of greatest overlap (the first on a tie), if it covers enough. One prediction may serve several.

    The interval join has an equality on time buckets, so it is a hash join at any size.
    """
    g = truth.withColumn("_b", F.explode(F.sequence(F.floor(F.col("query_start") / width), F.floor(F.col("query_end") / width))))
    p = predictions.withColumn("_b", F.explode(F.sequence(F.floor(F.col("query_start") / width), F.floor(F.col("query_end") / width))))
    p = p.select("_b", *[F.col(c).alias(f"p_{c}") for c in predictions.columns])
    both = overlap(F.col("query_start"), F.col("query_end"), F.col("p_query_start"), F.col("p_query_end"))
    found = g.join(p, "_b").drop("_b").dropDuplicates(["id", "p_id"]).withColumn("overlap", both).where(F.col("overlap") / F.greatest(F.col("query_end") - F.col("query_start"), F.lit(1e-9)) >= least_overlap)
    best = found.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("overlap"), "p_id"))).where("_n = 1").drop("_n")
    return truth.join(best.drop(*[c for c in truth.columns if c != "id"]), "id", "left")


def details(truth: DataFrame, predictions: DataFrame, iou_from: float = 0.5) -> DataFrame:
    """One row for each true segment: how it was found, and by how much times are off."""
    m = match(truth, predictions)
    none = F.col("p_id").isNull()
    # a hidden source that nothing was predicted for is a plain miss
    expected_unknown = (F.coalesce(F.col("source").startswith(HIDDEN), F.lit(False)) | F.col("note").contains("unknown")) & ~none
    named = ~none & F.col("p_source").isNotNull() & (F.col("p_status") != "UNKNOWN")
    right = F.coalesce(named & (F.col("p_source") == F.col("source")), F.lit(False)) & ~expected_unknown
    s = iou(F.col("source_start"), F.col("source_end"), F.col("p_source_start"), F.col("p_source_end"))
    box = iou_2d({"q0": F.col("p_query_start"), "q1": F.col("p_query_end"), "s0": F.col("p_source_start"), "s1": F.col("p_source_end")}, {"q0": F.col("query_start"), "q1": F.col("query_end"), "s0": F.col("source_start"), "s1": F.col("source_end")})
    aligned = F.abs(F.col("p_source_start") + (F.col("query_start") - F.col("p_query_start")) * F.coalesce(F.nullif("p_speed", F.lit(0.0)), F.lit(1.0)) - F.col("source_start"))
    return m.select(
        "id", "source", F.col("p_id").alias("pred_id"), F.col("p_source").alias("pred_source"), expected_unknown.alias("unknown_expected"),
        F.when(none, "MISS").otherwise(F.col("p_status")).alias("status"), right.alias("source_correct"), (right & (s >= iou_from)).alias("segment_correct"), F.when(right, s).alias("iou"), F.when(right, box).alias("iou_2d"),
        F.when(right, F.abs(F.col("p_source_start") - F.col("source_start"))).alias("start_error"), F.when(right, F.abs(F.col("p_source_end") - F.col("source_end"))).alias("end_error"), F.when(right, aligned).alias("aligned_error"),
        (expected_unknown & ~named).alias("unknown_correct"),
    )


def false_positives(predictions: DataFrame, detail: DataFrame) -> DataFrame:
    """Named predictions that are the right one of no true segment."""
    right = detail.where("source_correct").select(F.col("pred_id").alias("id"))
    return predictions.where(F.col("source").isNotNull() & (F.col("status") != "UNKNOWN")).join(right, "id", "left_anti")


def summary(detail: DataFrame, predictions: DataFrame) -> DataFrame:
    """Recalls, errors (mean and median; -1 where nothing was found), counts, rate of false positives, accuracy on unknown sources."""
    wrong = false_positives(predictions, detail).agg(F.count(F.lit(1)).alias("n_false"))
    named = predictions.where(F.col("source").isNotNull() & (F.col("status") != "UNKNOWN")).agg(F.count(F.lit(1)).alias("n_named"))
    every = predictions.agg(F.count(F.lit(1)).alias("n_pred"))
    known = ~F.col("unknown_expected")
    found = lambda f, c: F.coalesce(f(c), F.lit(-1.0))
    g = detail.agg(
        F.count_if(known).alias("n_truth"), F.coalesce(F.avg(F.when(known, F.col("source_correct").cast("double"))), F.lit(0.0)).alias("source_recall"), F.coalesce(F.avg(F.when(known, F.col("segment_correct").cast("double"))), F.lit(0.0)).alias("segment_recall"),
        found(F.avg, "start_error").alias("start_error"), found(F.avg, "end_error").alias("end_error"), found(F.median, "start_error").alias("median_start_error"), found(F.median, "end_error").alias("median_end_error"), found(F.avg, "aligned_error").alias("aligned_error"),
        found(F.avg, "iou").alias("mean_iou"), found(F.median, "iou").alias("median_iou"), found(F.median, "iou_2d").alias("median_iou_2d"), F.coalesce(F.avg(F.when(~known, F.col("unknown_correct").cast("double"))), F.lit(1.0)).alias("unknown_accuracy"),
    )
    return g.crossJoin(wrong).crossJoin(named).crossJoin(every).withColumn("false_positive_rate", F.coalesce(F.try_divide(F.col("n_false"), F.col("n_named")), F.lit(0.0)))  # one row each


def runs_of(runs: DataFrame, config: str | None = None, case: str | None = None) -> DataFrame:
    """Runs that ended well, of one configuration or case if it is named."""
    for column, value in (("config", config), ("case", case)):
        runs = runs if value is None else runs.where(F.col(column) == value)
    return runs.where("ok")


def roll_up(runs: DataFrame) -> DataFrame:
    """Means of each configuration's runs that ended well; sentinels below 0 don't count."""
    mean = lambda c: F.avg(F.when(F.col(c) >= 0, F.col(c))).alias(c)
    return runs_of(runs).groupBy("config").agg(mean("source_recall"), mean("segment_recall"), mean("start_error"), mean("total_s"), F.max("peak_mb").alias("peak_mb"), F.count(F.lit(1)).alias("n_runs"))


def best_config(rolled: DataFrame) -> DataFrame:
    """The best, the fastest and the leanest configuration."""
    rank = F.struct("segment_recall", "source_recall", -F.coalesce("start_error", F.lit(99.0)))
    return rolled.agg(F.max_by("config", rank).alias("best"), F.min_by("config", F.struct("total_s", "config")).alias("fastest"), F.min_by("config", F.struct("peak_mb", "config")).alias("leanest"))


def grid(configs: DataFrame, cases: DataFrame, present: DataFrame) -> DataFrame:
    """Configurations by cases of which there are data."""
    return configs.crossJoin(F.broadcast(cases.join(present, "case", "left_semi")))


def by_note(detail: DataFrame, notes: DataFrame) -> DataFrame:
    """Found and all segments of each kind of editing (the letter that begins a note), and the mean start error of those found."""
    kind = F.regexp_extract("note", "^([A-Z]) ", 1)
    rows = detail.join(notes.select("id", "note"), "id").withColumn("kind", kind).where("kind <> ''")
    return rows.groupBy("kind").agg(F.count_if("source_correct").alias("n_correct"), F.count(F.lit(1)).alias("n"), F.avg("start_error").alias("start_error"))


def failures(detail: DataFrame, most: int = 20) -> DataFrame:
    """The first few segments that were not found, unless their source is unknown."""
    return detail.where(~F.col("source_correct") & ~F.col("unknown_expected")).select("id", "status").distinct().orderBy("id", "status").limit(most)
