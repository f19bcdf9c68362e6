"""Reports: summaries, CSV rows, manifests of clips, JSON and CSV sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip_name


def status_summary(segments: DataFrame, query: str, durations: DataFrame | None = None) -> DataFrame:
    """Segments of each status, and the share of the query's time that has a source.

    durations: the queries and their duration; without it a query ends with its last segment.
    """
    count = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    named = F.coalesce(F.sum(F.when(F.col("status") != "UNKNOWN", F.col("query_end") - F.col("query_start"))), F.lit(0.0))
    g = segments.groupBy(query).agg(F.count(F.lit(1)).alias("n"), *[count(s) for s in ("HIGH", "MEDIUM", "LOW", "UNKNOWN")], named.alias("_t"), F.max("query_end").alias("_d"))
    if durations is not None:
        g = g.drop("_d").join(durations.select(query, F.col("duration").alias("_d")), query, "left")
    return g.withColumn("matched_ratio", F.round(F.col("_t") / F.greatest("_d", F.lit(1e-9)), 4)).drop("_t", "_d")


def top_candidates(candidates: DataFrame, n: int = 5) -> DataFrame:
    """The first n candidates of each shot as one list, with rounded scores, as the report shows them."""
    shown = F.struct("rank", "source_id", F.round("score", 4).alias("score"))
    return candidates.groupBy("shot_id").agg(F.slice(F.sort_array(F.collect_list(shown)), 1, n).alias("candidates"))


def stage_times(events: DataFrame, stage: str, seconds: str) -> DataFrame:
    """Seconds of all spans of each stage."""
    return events.groupBy(stage).agg(F.sum(seconds).alias("seconds"), F.count(F.lit(1)).alias("n"))


def concat_manifest(clips: DataFrame, group: str, order: str, length: str, has_audio: str) -> DataFrame:
    """The clips of each group in order with the time each begins at; sound stays only where all clips of the group have it."""
    every = Window.partitionBy(group)
    return running_cursor(clips, group, order, length).join(clips.select(group, order, length, F.min(F.col(has_audio)).over(every).alias("audio")), [group, order])


def csv_rows(segments: DataFrame, number: str = "query_id") -> DataFrame:
    """Segments as the report prints them: fixed decimals (halves to the even one), nothing as an empty text, the clip's name."""
    show = lambda c, n: F.coalesce(F.format_string(f"%.{n}f", F.bround(c, n)), F.lit("")) if n else F.coalesce(F.col(c), F.lit(""))
    text = lambda c, n: F.when(F.col(c).isNull(), "").otherwise(show(c, n)).alias(c)
    clip = F.when(F.col("source").isNull(), "").otherwise(clip_name(F.col(number), F.col("source"), F.col("source_start"), F.col("source_end"))).alias("clip")
    return segments.select(number, text("query_start", 3), text("query_end", 3), text("source", 0), text("source_start", 3), text("source_end", 3), text("confidence", 4), "status", text("speed", 4), clip)


def best_second(candidates: DataFrame, within: float = 0.12) -> DataFrame:
    """Each shot's best candidate, its margin to the second, and how many of the two to refine."""
    w = Window.partitionBy("shot_id").orderBy(F.desc("score"), "source_id")
    ranked = candidates.select("shot_id", "source_id", "score", F.row_number().over(w).alias("_n"), F.lead("score").over(w).alias("_s"))
    return ranked.where("_n = 1").select("shot_id", "source_id", "score", (F.col("score") - F.greatest(F.coalesce("_s", F.lit(0.0)), F.lit(0.0))).alias("margin"), (1 + F.coalesce((F.col("score") - F.col("_s") < within).cast("int"), F.lit(0))).alias("n_refine"))


def running_cursor(rows: DataFrame, group: str, order: str, length: str) -> DataFrame:
    """Where each piece begins when the pieces of a group are put one after another."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(group, order, F.coalesce(F.sum(length).over(w), F.lit(0.0)).alias("cursor"))


def clip_manifest(segments: DataFrame, number: str = "id", least: float = 1e-3) -> DataFrame:
    """Clips to cut: name, interval, and whether there is anything to cut."""
    return segments.where(F.col("source").isNotNull() & (F.col("status") != "UNKNOWN")).select(number, clip_name(F.col(number), F.col("source"), F.col("source_start"), F.col("source_end")).alias("name"), "source", "source_start", "source_end", (F.col("source_end") - F.col("source_start") > least).alias("ok"))


def sample_times(segments: DataFrame, columns: int = 4, key: str = "id") -> DataFrame:
    """Evenly spaced times of each segment for a contact sheet."""
    n = max(2, columns)
    t = F.col("source_start") + F.col("i") * (F.col("source_end") - 1e-3 - F.col("source_start")) / (n - 1)
    return segments.select(key, "source_start", "source_end", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select(key, "i", t.alias("ts"))


def write_json(segments: DataFrame, path: str) -> None:
    segments.write.mode("overwrite").json(path)


def write_csv(segments: DataFrame, path: str, number: str = "query_id") -> None:
    csv_rows(segments, number).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
