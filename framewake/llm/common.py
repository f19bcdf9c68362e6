"""Helpers shared by the training-data operators: bounded Arrow blocks, fresh column names, shared storage."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker holds at once; longer single texts form a block of their own.
BLOCK_BYTES = 4 << 20


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, whatever columns its owner added (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        new = f"_fw_{name}"
        while new.lower() in taken:
            new += "_"
        taken.add(new.lower())
        out.append(new)
    return out


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", max_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of each block have max_bytes at most, or are one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at, end = 0, np.cumsum(size)
        while at < batch.num_rows:
            done = end[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(end, done + max_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to


def texts_of(block: pa.RecordBatch, text: str = "text") -> list[str]:
    """The texts of a block; a null text is an empty one."""
    return [x or "" for x in block.column(text).to_pylist()]


def map_documents(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """fn over blocks of df's needed columns only: the scan reads no other column and extra ones can't clash."""

    def run(batches):
        yield from fn(blocks(batches, text))

    return df.select(*keep, text).mapInArrow(run, schema)


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new path under the folder that driver and executors share, as spark.checkpoint.dir names it.

    The setting is the cluster's; only where it is unset on one machine (tests) a folder of the warehouse is taken.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_framewake"
    path = f"{root.rstrip('/')}/framewake-{what}-{uuid.uuid4().hex[:12]}"
    for paths in getattr(_local, "collecting", ()):
        paths.append(path)
    return path


_local = threading.local()


class Tables:
    """Collects the paths that are stored while it is entered (in this thread), to delete them once nothing reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Tables:
        _local.collecting = [*getattr(_local, "collecting", ()), self.paths]
        return self

    def __exit__(self, *_) -> None:
        _local.collecting = [p for p in _local.collecting if p is not self.paths]

    def delete(self, but: tuple[str, ...] = ()) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            if path not in but:
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(conf).delete(at, True)
        self.paths[:] = [p for p in self.paths if p in but]


def placed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with two long columns that tell its rows apart, whatever the number of cores, splits or executors, and their names.

    They are a hash of the row's file and its place in it, which every scan of the files gives alike. The hash is told
    to be free of collisions by a count over the file names alone. docs that no Parquet files are read from, or that
    was joined or aggregated since, is written to the shared folder first.
    """
    try:
        files = docs.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index"))
        whole = "Join" not in (plan := docs._jdf.queryExecution().analyzed().toString()) and "Aggregate" not in plan and "Union" not in plan
    except AnalysisException:
        whole = False
    if not whole:
        docs = stored(docs, "placed")
        files = docs.select(F.col("_metadata.file_path").alias("path"))
    seed = 0
    while True:
        n, m = files.select("path").agg(F.count_distinct("path"), F.count_distinct(F.xxhash64("path", F.lit(seed)))).first()
        if n == m:
            break
        seed += 1
    names = fresh(docs, "file", "place")
    return docs.select("*", F.xxhash64(F.col("_metadata.file_path"), F.lit(seed)).alias(names[0]), F.col("_metadata.row_index").alias(names[1])), names


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The slices flat[starts[i]:starts[i]+lens[i]], one after another."""
    total = int(lens.sum())
    if not total:
        return flat[:0]
    before = np.cumsum(lens) - lens
    return flat[np.repeat(starts - before, lens) + np.arange(total)]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_digest(text: str = "text"):
    """A 128-bit digest of a text (null: empty) as the key of all its copies."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
