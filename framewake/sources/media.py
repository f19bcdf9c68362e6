"""Sources: media catalogue, frame tables with a feature cache, ground truth and predictions."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import fingerprint, orientation, rational

#: Suffixes of the media files that a scan takes (fixed values).
VIDEO_SUFFIXES = (".mp4", ".mov", ".mkv", ".webm", ".avi", ".m4v", ".flv", ".ts")


def scan(spark: SparkSession, directory: str, suffixes: tuple[str, ...] = VIDEO_SUFFIXES) -> DataFrame:
    """path, length, modificationTime of the media files below a folder. Order by path where order matters."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory).select("path", "length", "modificationTime")
    return found.where(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*suffixes))


def with_fingerprint(spark: SparkSession, directory: str, suffixes: tuple[str, ...] = VIDEO_SUFFIXES) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    return found.where(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*suffixes)).select("path", "length", fingerprint(F.col("length"), F.col("content")).alias("fingerprint"))


def exclude_query(sources: DataFrame, query: DataFrame, on: str = "path") -> DataFrame:
    """The query itself is no source: it would match itself perfectly."""
    return sources.join(query.select(on), on, "left_anti")


def dedupe_content(sources: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each content by its order value, and how many others have it. Aggregated before rows move."""
    return sources.groupBy(key).agg(F.min(order).alias(order), (F.count_distinct(order) - 1).alias("n_duplicates"))


def duplicates(sources: DataFrame, key: str, order: str) -> DataFrame:
    """key, order value of the first and duplicate: a row for each other one of a content, however many have it."""
    first = sources.groupBy(key).agg(F.min(order).alias("_first"))
    both = sources.select(key, order).join(first, key).where(F.col(order) != F.col("_first"))
    return both.select(key, F.col("_first").alias(order), F.col(order).alias("duplicate")).distinct()


PROBE = T.StructType([T.StructField("streams", T.ArrayType(T.MapType(T.StringType(), T.StringType()))), T.StructField("format", T.MapType(T.StringType(), T.StringType()))])


def probe_rows(raw: DataFrame, json_col: str = "probe") -> DataFrame:
    """Catalogue rows from probe JSON: rates, duration and frame count with their fallbacks, sides swapped when rotated.

    Rows without a video stream or a positive duration get an error, the others are not affected.
    """
    p = raw.withColumn("_p", F.from_json(json_col, PROBE))
    video = F.try_element_at(F.filter(F.col("_p.streams"), lambda s: s["codec_type"] == "video"), F.lit(1))
    p = p.withColumn("_v", video)
    num = lambda c: F.col(c).try_cast("double")
    fps, nominal = rational(F.col("_v.avg_frame_rate")), rational(F.col("_v.r_frame_rate"))
    fps = F.when(fps > 0, fps).otherwise(nominal)
    frames = num("_v.nb_frames").cast("long")
    duration = F.coalesce(F.nullif(num("_v.duration"), F.lit(0.0)), F.nullif(num("_p.format.duration"), F.lit(0.0)), F.try_divide(frames, fps))
    turned = F.abs(F.coalesce(num("_v.rotation"), F.lit(0.0))).cast("int") % 180 == 90
    w, h = num("_v.width").cast("int"), num("_v.height").cast("int")
    out = p.select(
        *raw.columns, fps.alias("fps"), nominal.alias("nominal_fps"), duration.alias("duration"), F.coalesce(num("_v.nb_read_frames").cast("long"), frames, F.round(duration * fps).cast("long")).alias("frame_count"),
        F.when(turned, h).otherwise(w).alias("width"), F.when(turned, w).otherwise(h).alias("height"), F.exists("_p.streams", lambda s: s["codec_type"] == "audio").alias("has_audio"),
        F.when(nominal > 0, F.abs(fps - nominal) / nominal > 0.02).otherwise(False).alias("is_vfr"), F.when(F.col("_v").isNull(), "no video stream").when(~(duration > 0) | duration.isNull(), "no duration").alias("error"),
    )
    return out.withColumn("orientation", orientation(F.col("width"), F.col("height")))


def sampled(frames: DataFrame, fps: float, media: str = "source_id", ts: str = "ts") -> DataFrame:
    """The first frame of each 1/fps of a medium's time."""
    w = Window.partitionBy(media, F.floor(F.col(ts) * fps)).orderBy(ts)
    return frames.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def plausible_times(frames: DataFrame, fps: float, start: float = 0.0, media: str = "source_id", order: str = "local_index", ts: str = "pts") -> DataFrame:
    """Stored times where a medium's are ascending and begin near start, else start + i / fps."""
    w = Window.partitionBy(media).orderBy(order)
    every = Window.partitionBy(media)
    rising = F.coalesce(F.lag(ts).over(w) < F.col(ts), F.lit(True)) & F.col(ts).isNotNull()
    checked = frames.withColumn("_up", rising)
    good = F.min("_up").over(every) & F.min(ts).over(every).between(start - 1, start + 2)
    return checked.withColumn("ts", F.when(good, F.col(ts)).otherwise(F.lit(start) + (F.row_number().over(w) - 1) / fps)).withColumn("time_source", F.when(good, "pts").otherwise("estimated")).drop("_up")


def time_slice(frames: DataFrame, start: float, end: float, ts: str = "ts") -> DataFrame:
    """Closed at both ends, within a nanosecond: a frame on a cut belongs to both sides."""
    return frames.where(F.col(ts).between(start - 1e-9, end + 1e-9))


def interval_frames(frames: DataFrame, start: float, end: float, fps: float, media: str = "source_id", ts: str = "ts") -> DataFrame:
    """Frames of an interval at a rate, without the cache."""
    return sampled(time_slice(frames, start, end, ts), fps, media, ts)


def cached(spark: SparkSession, path: str, wanted: DataFrame, key: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Features of the wanted keys: those stored at path, and what build makes of the missing ones, which is stored too.

    What can't be read is a miss, and is built again. A store that can't be written to is a warning: the features are
    returned all the same.
    """
    try:
        have = spark.read.option("ignoreCorruptFiles", True).parquet(path)
        missing = wanted.join(have.select(key).distinct(), key, "left_anti")
        complete = missing.isEmpty()
    except Exception as e:  # no folder yet, no file in it, or none that can be read
        if "PATH_NOT_FOUND" not in str(e):
            warnings.warn(f"the feature cache at {path} can't be read: {e}", stacklevel=2)
        have, missing, complete = None, wanted, False
    if not complete:
        built = build(missing)
        try:
            built.write.mode("append").parquet(path)
            have = spark.read.option("ignoreCorruptFiles", True).parquet(path)
        except Exception as e:
            warnings.warn(f"the feature cache at {path} can't be written: {e}", stacklevel=2)
            have = built if have is None else have.unionByName(built)
    return have.join(wanted.select(key).distinct(), key, "left_semi")


def by_id(sources: DataFrame, source_id: int) -> DataFrame:
    return sources.where(F.col("source_id") == source_id)


def by_name(sources: DataFrame, name: str) -> DataFrame:
    """The first source of a name; no row if there is none."""
    return sources.where(F.col("name") == name).orderBy("source_id").limit(1)


def pts_times(log: DataFrame, text: str) -> DataFrame:
    """The frame times that a decoder's log tells, in order: log's columns, i and pts_time."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"pts_time:\s*(-?[0-9.]+)"), F.lit(1))
    return log.select(*log.columns, F.posexplode(found).alias("i", "pts_time")).withColumn("pts_time", F.col("pts_time").cast("double"))


def require_one_space(frames: DataFrame, *columns: str) -> None:
    """Frames of different descriptor spaces (model, dimension, normalisation, ...) may not be compared."""
    spaces = frames.select(*columns).distinct().limit(2).count()
    if spaces > 1:
        raise ValueError(f"incompatible descriptors: {columns} differ")


GROUND_TRUTH = "struct<segments:array<struct<id:int,query_start:double,query_end:double,source:string,source_start:double,source_end:double,speed:double,note:string>>>"


def truth_rows(raw: DataFrame, text: str) -> DataFrame:
    """Rows of ground-truth JSON texts, after raw's other columns; missing ids count from 1, a missing speed is 1, a missing note empty."""
    kept = [c for c in raw.columns if c != text]
    rows = raw.select(*kept, F.from_json(text, GROUND_TRUTH).alias("d")).select(*kept, F.posexplode("d.segments").alias("i", "s"))
    return rows.select(*kept, F.coalesce("s.id", F.col("i") + 1).alias("id"), "s.query_start", "s.query_end", "s.source", "s.source_start", "s.source_end", F.coalesce("s.speed", F.lit(1.0)).alias("speed"), F.coalesce("s.note", F.lit("")).alias("note"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return truth_rows(spark.read.text(path, wholetext=True), "value")


PREDICTED = "struct<segments:array<struct<id:int,query_start:double,query_end:double,source:string,source_start:double,source_end:double,confidence:double,status:string,speed:double>>>"


def prediction_rows(raw: DataFrame, text: str) -> DataFrame:
    """Rows of result JSON texts; a missing id is 0, a missing confidence 0, a missing status UNKNOWN, a missing speed 1."""
    kept = [c for c in raw.columns if c != text]
    rows = raw.select(*kept, F.from_json(text, PREDICTED).alias("d")).select(*kept, F.explode("d.segments").alias("s"))
    return rows.select(*kept, F.coalesce("s.id", F.lit(0)).alias("id"), "s.query_start", "s.query_end", "s.source", "s.source_start", "s.source_end", F.coalesce("s.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("s.status", F.lit("UNKNOWN")).alias("status"), F.coalesce("s.speed", F.lit(1.0)).alias("speed"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    return prediction_rows(spark.read.text(path, wholetext=True), "value")
