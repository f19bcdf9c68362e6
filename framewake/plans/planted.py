"""A workload with known answers: descriptor series from the embeddings table, and query shots copied from them.

Labels are sources and a label's vectors in vec_id order its frames. Label 9 is withheld; source 103 is a near copy of 3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import l2_normalize

#: shot_id, frames, label, first frame, speed, strength of each frame (cycled).
PLAN = (
    (1, 6, 1, 10, 1.0, (1.0,)),
    (2, 6, 0, 20, 1.0, (0.9,)),
    (3, 6, 7, 5, 1.25, (0.8,)),
    (4, 6, 0, 30, 1.0, (0.65,)),
    (6, 2, 5, 8, 1.0, (1.0,)),
    (7, 6, 9, 10, 1.0, (1.0,)),
    (8, 6, 4, 8, 2.0, (0.9,)),
    (9, 6, 6, 25, 1.0, (0.45,)),
    (10, 6, 3, 10, 1.0, (0.5,)),
    (11, 6, 3, 10, 1.0, (1.0,)),
    (12, 8, 6, 20, 1.0, (0.5, 0.5, 0.0, 0.0, 0.0, 0.5, 0.0, 0.0)),
    (13, 9, 2, 12, 1.0, (0.55, 0.0, 0.0, 0.0, 0.55, 0.0, 0.0, 0.0, 0.55)),
    (14, 4, 2, 12, 1.0, (0.45, 0.0, 0.45, 0.45)),
)
WITHHELD, NEAR_COPY, COPIED, BLENDED = 9, 103, 3, 8


def all_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label's frames, before any is withheld."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    place = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("local_index")
    return e.select(F.col("label").alias("source_id"), place, F.transform("embedding", lambda x: x.cast("double")).alias("descriptor"))


def index_frames(frames: DataFrame) -> DataFrame:
    """The source index: source_id, local_index, ts, descriptor."""
    a = frames.where(f"source_id = {COPIED}").select("local_index", F.col("descriptor").alias("x"))
    b = frames.where(f"source_id = {BLENDED}").select("local_index", F.col("descriptor").alias("y"))
    copy = a.join(b, "local_index").select(F.lit(NEAR_COPY).alias("source_id"), "local_index", l2_normalize(F.zip_with("x", "y", lambda x, y: x * 0.99 + y * 0.141)).alias("descriptor"))
    every = frames.where(f"source_id <> {WITHHELD}").unionByName(copy)
    return every.select("source_id", "local_index", F.col("local_index").cast("double").alias("ts"), "descriptor")


def shots(spark: SparkSession) -> DataFrame:
    """shot_id, start, end on the query's time line (one frame a second, half a second between shots' ends and starts)."""
    rows, at = [], 0.0
    for shot, n, *_ in PLAN:
        rows.append((shot, at, at + n - 0.5))
        at += n
    return spark.createDataFrame(rows, "shot_id int, start double, end double")


def query_frames(spark: SparkSession, frames: DataFrame) -> DataFrame:
    """shot_id, q_idx, q_ts, descriptor: planted frames mixed with a frame of another label."""
    rows, at = [], 0.0
    for shot, n, label, first, speed, strength in PLAN:
        for i in range(n):
            a = strength[i % len(strength)]
            rows.append((shot, i, at + i, a, label, first + int(speed * i + 0.5), (label + 1 + (3 * i + shot) % 9) % 10, (7 * shot + 17 * i) % 40))
        at += n
    plan = F.broadcast(spark.createDataFrame(rows, "shot_id int, q_idx int, q_ts double, a double, l1 int, i1 int, l2 int, i2 int"))
    signal = frames.select(F.col("source_id").alias("l1"), F.col("local_index").alias("i1"), F.col("descriptor").alias("x"))
    noise = frames.select(F.col("source_id").alias("l2"), F.col("local_index").alias("i2"), F.col("descriptor").alias("y"))
    both = plan.join(signal, ["l1", "i1"]).join(noise, ["l2", "i2"])
    mixed = F.transform(F.arrays_zip(F.col("x").alias("x"), F.col("y").alias("y")), lambda p: F.col("a") * p["x"] + F.sqrt(1 - F.col("a") * F.col("a")) * p["y"])
    return both.select("shot_id", "q_idx", "q_ts", l2_normalize(mixed).alias("descriptor"))


def truth(spark: SparkSession) -> DataFrame:
    """Ground truth of the plan: id, query_start, query_end, source, source_start, source_end, speed, note."""
    rows, at = [], 0.0
    for shot, n, label, first, speed, _ in PLAN:
        name = "_Hidden" if label == WITHHELD else str(label)
        rows.append((shot, at, at + n - 0.5, name, float(first), first + speed * (n - 0.5), speed, "unknown" if label == WITHHELD else ""))
        at += n
    return spark.createDataFrame(rows, "id int, query_start double, query_end double, source string, source_start double, source_end double, speed double, note string")
