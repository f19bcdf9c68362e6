"""The trace: candidates of each shot, aligned coarse to fine, refined, graded and merged.

Levels, crops and the hard pass are the only loops on the driver (a handful of settings); each works on all shots that are
not yet resolved at once. What a step reads more than once is a row for each candidate, and is checkpointed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import TraceConfig
from ..functions.scalars import composite, confidence, status
from . import align as al
from . import features, merge, retrieval

#: What an alignment of a candidate is: the source's interval, its scores, and the fit.
ITEM = ["source_start", "source_end", "visual", "coverage", "slope", "r2", "rmse", "composite"]


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Without the setting a folder of the warehouse is taken on one machine; on a cluster that is an error.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_framewake").rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark)}/framewake-{what}-{uuid.uuid4().hex[:12]}"


def settled(df: DataFrame) -> DataFrame:
    """A small table that later steps read more than once, cut off from its plan by a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def at_rate(frames: DataFrame, fps: float, media: str, ts: str, place: str) -> DataFrame:
    """The first frame of each 1 / fps of every medium's time (all of them where there are no more), numbered anew from 0.

    Both windows go by the medium alone, so its frames move once.
    """
    w = Window.partitionBy(media).orderBy(ts)
    span = F.floor(F.col(ts) * fps + 1e-9)
    first = frames.withColumn("_first", F.coalesce(F.lag(span).over(w) < span, F.lit(True))).where("_first").drop("_first")
    return first.withColumn(place, F.row_number().over(w) - 1)


def _query_at(query: DataFrame, fps: float) -> DataFrame:
    return at_rate(query, fps, "shot_id", "q_ts", "q_idx")


def _index_at(index: DataFrame, fps: float) -> DataFrame:
    return at_rate(index, fps, "source_id", "ts", "local_index")


def align_candidates(query: DataFrame, index: DataFrame, shots: DataFrame, durations: DataFrame, candidates: DataFrame, cfg: TraceConfig, beta: float = 0.0) -> DataFrame:
    """shot_id, source_id and the item of each candidate that has a path."""
    both = al.map_times(al.align_items(query, index, candidates, cfg.align, beta=beta), shots.select("shot_id", "start", "end"), durations)
    return both.withColumn("composite", composite(F.col("visual"), F.col("coverage"))).select("shot_id", "source_id", *ITEM)


def retrieve(query: DataFrame, index: DataFrame, cfg: TraceConfig) -> DataFrame:
    """shot_id, source_id, rank of the candidates of each shot."""
    maxima, top = retrieval.frame_maxima(query, index), retrieval.top_frames(query, index, cfg.retrieval.top_n)
    return retrieval.rank_candidates(retrieval.source_scores(maxima, cfg.retrieval), retrieval.frame_votes(top), cfg.retrieval).select("shot_id", "source_id", "rank")


def best_per_source(aligned: DataFrame) -> DataFrame:
    """Of a source's items at several levels the best one, the coarser on a tie; place: their order in the shot."""
    first = Window.partitionBy("shot_id", "source_id").orderBy(F.desc("composite"), "level")
    kept = aligned.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("shot_id").orderBy(F.desc("composite"), "rank")))


def trace_levels(query: DataFrame, index: DataFrame, shots: DataFrame, cfg: TraceConfig = TraceConfig(), candidates: DataFrame | None = None) -> DataFrame:
    """The coarse-to-fine ladder: shots whose best composite score is below high are aligned again at the next density.

    Candidates come from the coarse level. Every level's items stay in the running; long sources are not scanned again.
    """
    durations = index.groupBy("source_id").agg(F.max("ts").alias("duration"))
    s = cfg.sampling
    q, ix = _query_at(query, s.coarse), _index_at(index, s.coarse)
    candidates = settled(retrieve(q, ix, cfg)) if candidates is None else candidates
    done = align_candidates(q, ix, shots, durations, candidates, cfg).withColumn("level", F.lit(0))
    rescanned = candidates.join(durations.where(F.col("duration") <= s.longest_rescan), "source_id", "left_semi")
    for level, fps in enumerate(dict.fromkeys(x for x in (s.medium, s.fine) if x > s.coarse), 1):
        if not cfg.refine.enabled:
            break
        done = settled(done)
        sure = done.groupBy("shot_id").agg(F.max("composite").alias("c")).where(F.col("c") >= cfg.score.high)
        again = rescanned.join(sure, "shot_id", "left_anti")
        more = align_candidates(_query_at(query, fps), _index_at(index, fps), shots, durations, again, cfg)
        done = done.unionByName(more.withColumn("level", F.lit(level)))
    return best_per_source(done.join(candidates, ["shot_id", "source_id"]))


def best_and_margin(items: DataFrame) -> DataFrame:
    """The best source of each shot, and how far its composite score is above that of the best other source (of nothing: 0)."""
    w = Window.partitionBy("shot_id").orderBy("place")
    ranked = items.withColumn("_s", F.lead("composite").over(w))
    return ranked.where("place = 1").withColumn("margin", F.col("composite") - F.coalesce("_s", F.lit(0.0))).drop("_s")


def refine(query: DataFrame, index: DataFrame, coarse: DataFrame, cfg: TraceConfig = TraceConfig(), fps: float | None = None) -> DataFrame:
    """Fine alignment of each shot within its coarse source interval, widened by a margin and clipped to the source.

    coarse: shot_id, source_id, start, end (query times), source_start, source_end. Windows of next to nothing and shots
    without a path have no row. With normalise, aligning goes by similarities less the frames' bias; the visual score is
    of the plain ones either way.
    """
    fps = fps or cfg.sampling.fine
    durations = index.groupBy("source_id").agg(F.max("ts").alias("duration"))
    lo = F.greatest(F.lit(0.0), F.least("source_start", "source_end") - cfg.sampling.margin)
    hi = F.least(F.col("duration"), F.greatest("source_start", "source_end") + cfg.sampling.margin)
    windows = coarse.join(durations, "source_id").withColumn("lo", lo).withColumn("hi", hi).where(F.col("hi") - F.col("lo") >= 0.05)
    q = _query_at(query, fps)
    if cfg.refine.normalise:
        bias = retrieval.frame_bias(q, _index_at(index, cfg.sampling.coarse), windows, cfg.refine.norm_k, cfg.refine.background)
        q = q.join(windows.select("shot_id", "source_id"), "shot_id").join(bias, ["shot_id", "source_id", "q_idx"], "left")
    return align_candidates(q, _index_at(index, fps), coarse, durations, windows, cfg, cfg.refine.norm_beta)


def refine_choice(items: DataFrame, cfg: TraceConfig = TraceConfig()) -> DataFrame:
    """The items to refine: the first of each shot, and the second if its composite score is close."""
    w = Window.partitionBy("shot_id")
    first = F.max(F.when(F.col("place") == 1, F.col("composite"))).over(w)
    return items.withColumn("_f", first).where((F.col("place") == 1) | ((F.col("place") == 2) & (F.col("_f") - F.col("composite") < cfg.refine.second_within))).drop("_f")


def refined_best(items: DataFrame, fine: DataFrame) -> DataFrame:
    """The best of each shot's refined items with its margin: to the other refined one and to all other sources as they were.

    fine: refined items; those that are not there stay as they were.
    """
    key = ["shot_id", "source_id"]
    new = fine.select(*key, F.struct(*ITEM).alias("_new"))
    mixed = items.join(new, key, "left").select("shot_id", "source_id", "place", *[F.coalesce(F.col("_new")[c], F.col(c)).alias(c) for c in ITEM])
    best = mixed.withColumn("_n", F.row_number().over(Window.partitionBy("shot_id").orderBy(F.desc("composite"), "place"))).where("_n = 1").drop("_n", "place")
    return best


def _others(best: DataFrame, scores: DataFrame) -> DataFrame:
    """best with margin: its composite score less the greatest of scores (shot_id, source_id, composite) of other sources."""
    mine = best.select("shot_id", F.col("source_id").alias("_of"))
    rest = scores.join(mine, "shot_id").where(F.col("source_id") != F.col("_of")).groupBy("shot_id").agg(F.max("composite").alias("_rest"))
    return best.join(rest, "shot_id", "left").withColumn("margin", F.col("composite") - F.coalesce("_rest", F.lit(0.0))).drop("_rest")


def _confidence(margin: Column, cfg: TraceConfig, of=F.col) -> Column:
    return confidence(of("visual"), of("coverage"), margin, of("r2"), of("rmse"), F.col("end") - F.col("start"), cfg.score)


def _better(now: DataFrame, tried: DataFrame, cfg: TraceConfig) -> DataFrame:
    """now with the items, and margins if there are, of tried where they raise the confidence."""
    with_margin = "margin" in tried.columns
    names = ["source_id", *ITEM, *(["margin"] if with_margin else [])]
    both = now.join(tried.select("shot_id", F.struct(*names).alias("_t")), "shot_id", "left")
    margin = F.col("_t")["margin"] if with_margin else F.col("margin")
    conf = _confidence(margin, cfg, lambda c: F.col("_t")[c])
    both = both.withColumn("_c", conf).withColumn("_up", F.col("_t").isNotNull() & (F.col("_c") > F.col("confidence")))
    taken = both.withColumns({c: F.when(F.col("_up"), F.col("_t")[c]).otherwise(F.col(c)) for c in names})
    return taken.withColumn("confidence", F.when(F.col("_up"), F.col("_c")).otherwise(F.col("confidence"))).drop("_t", "_c", "_up")


def first_candidates(candidates: DataFrame, n: int) -> DataFrame:
    """The first n candidates of each shot in rank order, one at least."""
    place = F.row_number().over(Window.partitionBy("shot_id").orderBy("rank"))
    return candidates.withColumn("_n", place).where(F.col("_n") <= max(1, n)).drop("_n")


def crop_compensation(query: DataFrame, cropped: DataFrame, shots: DataFrame, durations: DataFrame, candidates: DataFrame, cfg: TraceConfig = TraceConfig()) -> DataFrame:
    """The best item of each shot over centre crops of its first candidates' frames, with its margin to other sources.

    cropped: source_id, local_index, ts, descriptor and crop, the ratio that the frame was cut to before encoding. Ratios that
    the settings do not name, and such of 1 and above, are not looked at.
    """
    few = first_candidates(candidates, cfg.refine.crop_candidates).join(durations.where(F.col("duration") <= cfg.sampling.longest_rescan), "source_id", "left_semi")
    q = _query_at(query, cfg.sampling.fine)
    found = None
    for k, ratio in enumerate(r for r in cfg.refine.crop_views if r < 1):
        frames = _index_at(cropped.where(F.abs(F.col("crop") - ratio) < 1e-9), cfg.sampling.fine)
        some = align_candidates(q, frames, shots, durations, few, cfg).withColumn("level", F.lit(k))
        found = some if found is None else found.unionByName(some)
    if found is None:
        return None
    found = settled(found.join(few.select("shot_id", "source_id", "rank"), ["shot_id", "source_id"]))
    order = Window.partitionBy("shot_id").orderBy(F.desc("composite"), "level", "rank")
    best = found.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("shot_id", "source_id", *ITEM)
    return _others(best, found)


def resolve(query: DataFrame, index: DataFrame, shots: DataFrame, cfg: TraceConfig = TraceConfig(), cropped: DataFrame | None = None) -> DataFrame:
    """One segment for each shot, before merging: ladder, refinement, hard pass, crops, grade.

    query: shot_id, q_idx, q_ts, descriptor; index: source_id, local_index, ts, descriptor, both at the highest density there
    is; shots: shot_id, start, end; cropped: see `crop_compensation`. An index without frames is an error. Shots with a broken
    descriptor are unknown and harm no other (`features.index_or_errors` names them).
    """
    if index.isEmpty():
        raise ValueError("no source has any frames")
    query = settled(features.index_or_errors(query, "shot_id")[0])
    durations = index.groupBy("source_id").agg(F.max("ts").alias("duration"))
    coarse = _query_at(query, cfg.sampling.coarse), _index_at(index, cfg.sampling.coarse)
    candidates = settled(retrieve(*coarse, cfg))
    items = settled(trace_levels(query, index, shots, cfg, candidates))
    times = shots.select("shot_id", "start", "end")
    chosen = refine_choice(items, cfg)
    fine = settled(refine(query, index, chosen.join(times, "shot_id"), cfg)) if cfg.refine.enabled else None
    best = refined_best(chosen, fine) if fine is not None else chosen.where("place = 1").drop("place")
    scores = items.select("shot_id", "source_id", "composite")
    if fine is not None:
        scores = scores.unionByName(fine.select("shot_id", "source_id", "composite"))
    now = _others(best.select("shot_id", "source_id", *ITEM), scores).join(times, "shot_id")
    now = settled(now.withColumn("confidence", _confidence(F.col("margin"), cfg)))
    if cfg.refine.enabled:
        unsure = now.where(F.col("confidence") < cfg.refine.enhance_below)
        now = _better(now, refine(query, index, unsure.select("shot_id", "source_id", "start", "end", "source_start", "source_end"), cfg, cfg.sampling.hard), cfg)
        if cropped is not None:
            now = settled(now)
            open_ = now.where(status(F.col("confidence"), F.col("margin"), cfg.score) == "UNKNOWN").select("shot_id")
            tried = crop_compensation(query, cropped, shots, durations, candidates.join(open_, "shot_id", "left_semi"), cfg)
            now = now if tried is None else _better(now, tried, cfg)
    return graded(shots, now, cfg)


def graded(shots: DataFrame, best: DataFrame, cfg: TraceConfig = TraceConfig()) -> DataFrame:
    """Segments of all shots: status, and source, interval and speed unless it is unknown; scores as a map."""
    rows = shots.select("shot_id", "start", "end").join(best.drop("start", "end"), "shot_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    short = F.col("source_end") - F.col("source_start") < 0.5 * cfg.score.min_segment
    rows = rows.withColumn("status", F.when(F.col("source_id").isNull() | short, "UNKNOWN").otherwise(status(F.col("confidence"), F.col("margin"), cfg.score)))
    named = F.col("status") != "UNKNOWN"
    scores = F.create_map(*[x for c in ("visual", "coverage", "margin") for x in (F.lit(c), F.coalesce(F.col(c), F.lit(0.0)))])
    return rows.select(
        "shot_id", F.col("start").alias("query_start"), F.col("end").alias("query_end"), F.when(named, F.col("source_id").cast("string")).alias("source"), F.when(named, F.col("source_start")).alias("source_start"), F.when(named, F.col("source_end")).alias("source_end"),
        "confidence", "status", F.when(named, F.col("slope")).otherwise(1.0).alias("speed"), scores.alias("scores"),
    )


def trace(query: DataFrame, index: DataFrame, shots: DataFrame, cfg: TraceConfig = TraceConfig(), cropped: DataFrame | None = None) -> DataFrame:
    """The segments of a query, resolved and merged: id, query_start, query_end, source, source_start, source_end, confidence, status, speed, scores."""
    return merge.merge_segments(resolve(query, index, shots, cfg, cropped).withColumn("query_id", F.lit(1)), "query_id", cfg.merge).drop("query_id")


def trace_once(query: DataFrame, index: DataFrame, shots: DataFrame, cfg: TraceConfig = TraceConfig()) -> DataFrame:
    """Segments from one alignment of all frames there are, without ladder, refinement and merging."""
    durations = index.groupBy("source_id").agg(F.max("ts").alias("duration"))
    candidates = settled(retrieve(query, index, cfg))
    items = align_candidates(query, index, shots, durations, candidates, cfg).withColumn("level", F.lit(0)).join(candidates, ["shot_id", "source_id"])
    best = best_and_margin(best_per_source(items)).join(shots.select("shot_id", "start", "end"), "shot_id")
    return graded(shots, best.withColumn("confidence", _confidence(F.col("margin"), cfg)), cfg)


def short_sources(index: DataFrame, longest: float) -> DataFrame:
    """Sources that a rescan takes: those no longer than the bound."""
    return index.groupBy("source_id").agg(F.max("ts").alias("duration")).where(F.col("duration") <= longest)
