"""Candidate retrieval: similarities of query frames and index frames, votes and trimmed source scores.

The query is one medium: its frames are collected behind a check of their size and sent to the tasks, which stream the index.
Each task reduces its frames to the best per query frame and source (and the best few per query frame) before the
shuffle, so what moves grows with the query and the number of sources, not with the index.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import RetrievalConfig
from ..functions.scalars import dot

#: Bytes of query descriptors that may be sent to every task.
QUERY_BYTES = 256 << 20


def shot_frames(frames: DataFrame, shots: DataFrame, ts: str = "q_ts") -> DataFrame:
    """Frames within each shot, both ends inclusive. A bucket of time gives the join an equality, so it is a hash join."""
    width = 16.0
    s = shots.withColumn("_b", F.explode(F.sequence(F.floor((F.col("start") - 1e-9) / width), F.floor((F.col("end") + 1e-9) / width))))
    f = frames.withColumn("_b", F.floor(F.col(ts) / width))
    return f.join(s, "_b").where(F.col(ts).between(F.col("start") - 1e-9, F.col("end") + 1e-9)).drop("_b")


def nearest_for_empty(frames: DataFrame, shots: DataFrame, ts: str = "q_ts") -> DataFrame:
    """For shots without a frame, the frame nearest to the middle (the earlier of two).

    Frames of the middle's time bucket are met by a join on the bucket. Beyond it the last frame of the bucket before and the first
    of the one after count; the one window that is not partitioned runs over a row for each bucket and empty shot, not over frames.
    """
    width = 16.0
    have = shot_frames(frames.select(ts), shots.select("shot_id", "start", "end"), ts).select("shot_id").distinct()
    empty = shots.join(have, "shot_id", "left_anti").withColumn("mid", (F.col("start") + F.col("end")) / 2).select("shot_id", "mid", F.floor(F.col("mid") / width).alias("_b"))
    held = frames.select(F.col(ts).alias("_t"), F.floor(F.col(ts) / width).alias("_b"))
    none = F.lit(None).cast("double")
    buckets = held.groupBy("_b").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    rows = buckets.select("_b", "_lo", "_hi", F.lit(None).cast("int").alias("shot_id"), none.alias("mid")).unionByName(empty.select("_b", none.alias("_lo"), none.alias("_hi"), "shot_id", "mid"))
    w = Window.orderBy("_b")
    around = rows.withColumn("_before", F.last("_hi", True).over(w.rangeBetween(Window.unboundedPreceding, -1))).withColumn("_after", F.first("_lo", True).over(w.rangeBetween(1, Window.unboundedFollowing)))
    around = around.where("shot_id is not null").select("shot_id", "mid", "_before", "_after")
    off = lambda t: F.struct(F.abs(t - F.col("mid")).alias("off"), t.alias("t"))
    inside = empty.join(held, "_b").groupBy("shot_id").agg(F.min(off(F.col("_t"))).alias("_in"))
    choices = F.array(F.col("_in"), *[F.when(F.col(c).isNotNull(), off(F.col(c))) for c in ("_before", "_after")])
    return around.join(inside, "shot_id", "left").select("shot_id", "mid", F.array_min(choices)["t"].alias("nearest_ts"))


def cosine_pairs(query: DataFrame, index: DataFrame) -> DataFrame:
    """Every similarity in long form; for small inputs and checked candidates, as its size is the product of both."""
    _query_size(query)
    f = index.select("source_id", F.col("local_index").alias("s_idx"), F.col("ts").alias("s_ts"), F.col("descriptor").alias("_d"))
    return f.crossJoin(F.broadcast(query)).select("shot_id", "q_idx", "q_ts", "source_id", "s_idx", "s_ts", dot(F.col("descriptor"), F.col("_d")).alias("sim"))


def candidate_pairs(query: DataFrame, index: DataFrame, candidates: DataFrame) -> DataFrame:
    """Similarities of each shot's frames and the frames of its candidate sources."""
    f = index.select("source_id", F.col("local_index").alias("s_idx"), F.col("ts").alias("s_ts"), F.col("descriptor").alias("_d"))
    shot_source = candidates.select("shot_id", "source_id")
    return query.join(shot_source, "shot_id").join(f, "source_id").select("shot_id", "q_idx", "q_ts", "source_id", "s_idx", "s_ts", dot(F.col("descriptor"), F.col("_d")).alias("sim"))


def _query_size(query: DataFrame) -> tuple[int, int]:
    """Frames and numbers of each; more than may be broadcast are an error."""
    rows, width = query.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("descriptor")), F.lit(0))).first()
    if rows * width * 8 > QUERY_BYTES:
        raise ValueError(f"the query has {rows} frames of {width} numbers; split it by shots")
    return rows, width


def _query_matrix(query: DataFrame):
    """The query's frames as a broadcast matrix, made once for a DataFrame."""
    if (made := getattr(query, "_framewake_matrix", None)) is not None:
        return made
    _, width = _query_size(query)
    got = query.select("shot_id", "q_idx", "descriptor").toArrow().to_pylist()
    made = query.sparkSession.sparkContext.broadcast((np.array([r["shot_id"] for r in got], np.int64), np.array([r["q_idx"] for r in got], np.int64), np.array([r["descriptor"] for r in got], np.float64).reshape(len(got), width)))
    query._framewake_matrix = made
    return made


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def frame_maxima(query: DataFrame, index: DataFrame) -> DataFrame:
    """The best similarity of each query frame in each source: shot_id, source_id, q_idx, sim."""
    shared = _query_matrix(query)

    def run(batches):
        shot, q_idx, q = shared.value
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            source, d = batch.column("source_id").to_numpy(), _matrix(batch.column("descriptor"))
            for s in np.unique(source).tolist():
                m = (q @ d[source == s].T).max(1)
                best[s] = np.maximum(best[s], m) if s in best else m
        for s, m in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(shot, pa.int32()), pa.array(np.full(len(m), s), pa.int32()), pa.array(q_idx, pa.int32()), pa.array(m)], ["shot_id", "source_id", "q_idx", "sim"])

    part = index.select("source_id", "descriptor").mapInArrow(run, "shot_id int, source_id int, q_idx int, sim double")
    return part.groupBy("shot_id", "source_id", "q_idx").agg(F.max("sim").alias("sim"))


def top_frames(query: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """The n most similar index frames of each query frame; ties by source and place."""
    shared = _query_matrix(query)

    def run(batches):
        shot, q_idx, q = shared.value
        held = None
        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            sim = q @ _matrix(batch.column("descriptor")).T
            source = np.broadcast_to(batch.column("source_id").to_numpy(), sim.shape)
            place = np.broadcast_to(batch.column("local_index").to_numpy(), sim.shape)
            new = [sim, source, place]
            held = new if held is None else [np.hstack(x) for x in zip(held, new, strict=True)]
            order = np.lexsort((held[2], held[1], -held[0]))[:, :n]
            held = [np.take_along_axis(x, order, 1) for x in held]
        if held is not None:
            k = held[0].shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(shot, k), pa.int32()), pa.array(np.repeat(q_idx, k), pa.int32()), *(pa.array(held[i].ravel(), t) for i, t in ((1, pa.int32()), (2, pa.int32()), (0, pa.float64())))], ["shot_id", "q_idx", "source_id", "s_idx", "sim"])

    part = index.select("source_id", "local_index", "descriptor").mapInArrow(run, "shot_id int, q_idx int, source_id int, s_idx int, sim double")
    w = Window.partitionBy("shot_id", "q_idx").orderBy(F.desc("sim"), "source_id", "s_idx")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def source_scores(maxima: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Trimmed mean, median and hit ratio of each source's best similarities per query frame."""
    w = Window.partitionBy("shot_id", "source_id")
    ranked = maxima.withColumn("_r", F.row_number().over(w.orderBy(F.desc("sim")))).withColumn("_n", F.count(F.lit(1)).over(w))
    kept = F.col("_r") <= F.greatest(F.lit(1.0), F.bround(F.col("_n") * (1 - cfg.trim), 0))
    return ranked.groupBy("shot_id", "source_id").agg(F.avg(F.when(kept, F.col("sim"))).alias("visual"), F.median("sim").alias("median"), F.avg((F.col("sim") > cfg.hit_above).cast("double")).alias("hit_ratio"))


def frame_votes(top: DataFrame) -> DataFrame:
    """Each source's share of the similarity of the best frames; nothing positive at all gives shares of 0."""
    s = top.groupBy("shot_id", "source_id").agg(F.sum(F.greatest(F.col("sim"), F.lit(0.0))).alias("v"))
    total = F.sum("v").over(Window.partitionBy("shot_id"))
    return s.select("shot_id", "source_id", F.coalesce(F.try_divide(F.col("v"), total), F.lit(0.0)).alias("vote"))


def rank_candidates(scores: DataFrame, votes: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """The top sources of each shot by combined score, above the least visual score; the best one if none is."""
    w = Window.partitionBy("shot_id")
    both = scores.join(votes, ["shot_id", "source_id"], "left").withColumn("vote", F.coalesce("vote", F.lit(0.0)))
    both = both.withColumn("score", cfg.score_weight * F.col("visual") + cfg.vote_weight * F.col("vote"))
    ranked = both.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "source_id"))).where(F.col("rank") <= max(1, cfg.top_k))
    some = F.max((F.col("visual") >= cfg.least_visual).cast("int")).over(w)
    return ranked.withColumn("_some", some).where((F.col("visual") >= cfg.least_visual) | ((F.col("_some") == 0) & (F.col("rank") == 1))).drop("_some")


def background(index: DataFrame, candidates: DataFrame, pool: int) -> DataFrame:
    """cand, other, local_index, _d: for each candidate source the first frames of the other sources by a hash of source and place."""
    places = index.select(F.col("source_id").alias("other"), "local_index", F.md5(F.concat_ws(":", "source_id", "local_index").cast("binary")).alias("_h"), F.col("descriptor").alias("_d"))
    by_hash = ["_h", "other", "local_index"]
    # a pool takes no more of one source than its first frames, so twice as many in all hold the pool of every candidate
    firsts = places.withColumn("_r", F.row_number().over(Window.partitionBy("other").orderBy(*by_hash))).where(F.col("_r") <= pool).drop("_r").orderBy(*by_hash).limit(2 * pool)
    both = candidates.crossJoin(F.broadcast(firsts)).where(F.col("cand") != F.col("other"))  # 2 * pool rows
    return both.withColumn("_r", F.row_number().over(Window.partitionBy("cand").orderBy(*by_hash))).where(F.col("_r") <= pool).drop("_r", "_h")


def frame_bias(query: DataFrame, index: DataFrame, candidates: DataFrame, k: int = 10, pool: int = 256) -> DataFrame:
    """shot_id, source_id, q_idx, bias: the mean of each query frame's k best similarities to frames of other sources than the candidate.

    The pool of a source is the first frames of all other sources by a hash of their place, the same in every run.
    """
    sources = candidates.select("shot_id", F.col("source_id").alias("cand")).distinct()
    chosen = sources.join(background(index, sources.select("cand").distinct(), pool), "cand")
    sims = query.select("shot_id", "q_idx", "descriptor").join(chosen, "shot_id").select("shot_id", "q_idx", F.col("cand").alias("source_id"), dot(F.col("descriptor"), F.col("_d")).alias("s"))
    best = sims.withColumn("_r", F.row_number().over(Window.partitionBy("shot_id", "q_idx", "source_id").orderBy(F.desc("s")))).where(F.col("_r") <= k)
    return best.groupBy("shot_id", "q_idx", "source_id").agg(F.avg("s").alias("bias"))


def normalized_scores(pairs: DataFrame, index: DataFrame, query: DataFrame, k: int = 10, beta: float = 0.5, pool: int = 256) -> DataFrame:
    """Similarities less beta times the bias of their query frame and source."""
    bias = frame_bias(query, index, pairs, k, pool)
    return pairs.join(bias, ["shot_id", "q_idx", "source_id"], "left").withColumn("sim", F.col("sim") - beta * F.coalesce("bias", F.lit(0.0))).drop("bias")
