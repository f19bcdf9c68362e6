"""Queries of the engine's own operators and their SQL. Doubles are rounded to 6 places, as engines differ in the last bits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import AlignConfig, RetrievalConfig, ShotConfig, TraceConfig
from .functions import scalars as fs
from .operators import align, evaluate, features, merge, report, resolve, retrieval, shots
from .plans import planted
from .sources import media

R = 6
#: The SQL below lets ten frames vote for each query frame.
TEN = TraceConfig(retrieval=RetrievalConfig(top_n=10))


def _r(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, R) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _weighed(vector):
    """All numbers of a vector in one, each weighed by its place."""
    return F.aggregate(F.transform(vector, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)


class _Planted:
    def __init__(self, spark: SparkSession, d: str):
        frames = planted.all_frames(spark, d)
        self.index, self.query, self.shots = planted.index_frames(frames), planted.query_frames(spark, frames), planted.shots(spark)

    def stored(self):
        """With both frame tables written, as they would be: the trace reads them at several rates."""
        self.index, self.query = resolve.settled(self.index), resolve.settled(self.query)
        return self


def _pairs(s, d):
    p = _Planted(s, d)
    return retrieval.cosine_pairs(p.query, p.index)


def _maxima(s, d):
    p = _Planted(s, d)
    return retrieval.frame_maxima(p.query, p.index)


def _top(s, d):
    p = _Planted(s, d)
    return retrieval.top_frames(p.query, p.index, 10)


def _candidates(s, d):
    return retrieval.rank_candidates(retrieval.source_scores(_maxima(s, d)), retrieval.frame_votes(_top(s, d)))


def _points(method: str):
    def run(s, d):
        p = _Planted(s, d)
        return align.align(p.query, p.index, resolve.settled(_candidates(s, d)), AlignConfig(), method)

    return run


def _normalised(s, d):
    p = _Planted(s, d)
    c = _candidates(s, d)
    pairs = retrieval.candidate_pairs(p.query, p.index, c)
    return retrieval.normalized_scores(pairs, p.index, p.query).groupBy("shot_id", "source_id", "q_idx").agg(F.max("sim").alias("best"))


def _empty_shots(s, d):
    frames = planted.all_frames(s, d).where("source_id = 0").select(F.col("local_index").cast("double").alias("q_ts"))
    gaps = s.createDataFrame([(1, 3.2, 3.6), (2, 7.4, 7.6), (3, 2.0, 4.0), (4, 9.7, 9.9), (5, 100000.25, 100000.75)], "shot_id int, start double, end double")
    return retrieval.nearest_for_empty(frames, gaps)


def _events(s, d):
    """Event values of each user as a series of change scores between 0 and 1."""
    e = _table(s, d, "events")
    return e.select("user_id", "event_id", (F.col("value") / (F.abs(F.col("value")) + 100.0)).alias("score"))


def _spaced(s, d):
    e = _table(s, d, "events").groupBy("user_id").agg(F.collect_list(F.col("event_id").cast("double")).alias("t"))
    return e.select("user_id", F.explode(shots.spaced(F.col("t"), 400.0, F.lit(0.0))).alias("t"))


def _built(s, d):
    e = _table(s, d, "events")
    cuts = e.groupBy("user_id").agg(F.collect_list(F.col("event_id") / 100.0).alias("t"), (F.max("event_id") / 100.0 + 3.0).alias("duration"))
    return shots.build_shots(cuts, "user_id", "t", "duration", ShotConfig(min_shot=2.0, max_shot=8.0))


def _fixed(s, d):
    p = _table(s, d, "part")
    return p.select("p_partkey", F.explode(shots.fixed_cuts(F.col("p_size").cast("double"), 3.0)).alias("cut"))


def _grades(s, d):
    """Scores of line items as segments: their numbers scaled into the ranges of the formula."""
    l = _table(s, d, "lineitem")  # noqa: E741
    # primes keep the scores off the half-way points of rounding
    v = {"visual": F.col("l_orderkey") * 7919 % 9973 / F.lit(9973.0), "coverage": 1 - F.col("l_tax") * 5, "margin": F.col("l_discount") * 2, "r2": F.col("l_linenumber") / 7.0, "rmse": F.col("l_tax") * 4, "length": F.col("l_linenumber") * 0.7}
    x = l.select("l_orderkey", "l_linenumber", fs.confidence(**v).alias("confidence"), v["margin"].alias("margin"))
    return x.select("l_orderkey", "l_linenumber", F.round("confidence", R).alias("confidence"), fs.status(F.round("confidence", R), F.col("margin")).alias("status"))


SEGMENTS = (
    (1, 0.0, 2.0, "a", 10.0, 12.0, 0.9, "HIGH", 1.0), (1, 2.0, 4.0, "a", 12.0, 14.0, 0.7, "MEDIUM", 1.0), (1, 4.0, 6.0, "a", 14.0, 16.0, 0.6, "LOW", 1.05),
    (2, 0.0, 2.0, "a", 10.0, 12.0, 0.9, "HIGH", 1.0), (2, 2.0, 4.0, "a", 40.0, 42.0, 0.8, "HIGH", 1.0), (3, 0.0, 2.0, "a", 10.0, 12.0, 0.9, "HIGH", 1.0), (3, 2.0, 4.0, "b", 12.0, 14.0, 0.8, "HIGH", 1.0),
    (4, 0.0, 2.0, "a", 10.0, 12.0, 0.9, "HIGH", 1.0), (4, 2.0, 4.0, None, None, None, 0.2, "UNKNOWN", 1.0), (5, 0.0, 2.0, "a", 10.0, 12.0, 0.9, "HIGH", 1.0), (5, 2.3, 4.3, "a", 12.2, 14.2, 0.5, "LOW", 1.0), (5, 4.3, 6.0, "a", 14.2, 16.5, 0.5, "LOW", 1.25),
)
TRUTH = ((1, 0.0, 4.0, "a", 10.0, 14.0, 1.0, ""), (2, 4.0, 8.0, "b", 30.0, 34.0, 1.0, ""), (3, 8.0, 12.0, "a", 50.0, 54.0, 1.0, ""), (4, 12.0, 16.0, "_Hidden", 0.0, 4.0, 1.0, "unknown"), (5, 16.0, 20.0, "c", 5.0, 9.0, 1.0, ""), (6, 22.0, 26.0, "a", 20.0, 24.0, 1.0, ""))
PREDICTIONS = ((1, 0.0, 4.0, "a", 10.0, 14.0, 0.9, "HIGH", 1.0), (2, 4.0, 8.0, "c", 30.0, 34.0, 0.7, "MEDIUM", 1.0), (3, 8.0, 12.0, "a", 52.0, 56.0, 0.8, "HIGH", 1.0), (4, 12.0, 16.0, None, None, None, 0.1, "UNKNOWN", 1.0), (5, 21.5, 26.0, "a", 19.5, 24.0, 0.9, "HIGH", 1.0))
RUNS = (("A", "basic", True, 1.0, 0.6, 6.8, 7.9, 687.8), ("A", "multi", True, 1.0, 0.5, -1.0, 8.9, 690.0), ("B", "basic", True, 0.96, 0.6, 6.6, 3.7, 687.8), ("B", "multi", False, 0.0, 0.0, 0.0, 0.0, 0.0), ("D", "basic", True, 1.0, 1.0, 0.04, 30.1, 688.1), ("D", "multi", True, 1.0, 1.0, 0.06, 45.5, 687.0))


def _literal(s, rows, schema):
    return s.createDataFrame(list(rows), schema)


def _segments(s):
    base = _literal(s, SEGMENTS, "query_id int, query_start double, query_end double, source string, source_start double, source_end double, confidence double, status string, speed double")
    return base.withColumn("scores", F.create_map(F.lit("visual"), F.col("confidence")))


def _truth(s):
    return _literal(s, TRUTH, "id int, query_start double, query_end double, source string, source_start double, source_end double, speed double, note string")


def _predictions(s):
    return _literal(s, PREDICTIONS, "id int, query_start double, query_end double, source string, source_start double, source_end double, confidence double, status string, speed double")


def _runs(s):
    return _literal(s, RUNS, "config string, case string, ok boolean, source_recall double, segment_recall double, start_error double, total_s double, peak_mb double")


def _merged(s, d):
    m = merge.merge_segments(_segments(s))
    return m.drop("scores")


def _histograms(s, d):
    e = _table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int")).alias("pixels"))
    h = e.select("vec_id", F.posexplode(shots.gray_histogram(F.col("pixels"))).alias("bin", "share"))
    return h.where("share > 0")


def _changes(s, d):
    e = _table(s, d, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int")).alias("pixels"))
    e = e.withColumn("hist", shots.gray_histogram(F.col("pixels")))
    return shots.change_scores(e, "label", "vec_id", "hist", "pixels").select("label", "vec_id", "score")


def _scalars(s, d):
    c = _table(s, d, "customer")
    rate = F.concat_ws("/", F.col("c_custkey").cast("string"), (F.col("c_nationkey")).cast("string"))
    t = F.abs(F.col("c_acctbal")) / 10
    return c.select(
        "c_custkey", fs.rational(rate).alias("rate"), fs.orientation(F.col("c_nationkey"), F.lit(12)).alias("orientation"), fs.clip(F.col("c_acctbal"), 0.0, 5000.0).alias("clipped"), fs.time_label(F.floor(t).cast("double")).alias("label"),
        fs.iou(F.lit(0.0), F.col("c_nationkey").cast("double"), F.lit(5.0), F.lit(15.0)).alias("iou"), fs.composite(F.col("c_nationkey") / 25, F.lit(0.5)).alias("composite"), fs.shown(F.col("c_nationkey") / 7 - 1, 3).alias("shown"),
    )


def _gem(s, d):
    e = _table(s, d, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    return e.select("vec_id", fs.gem(v).alias("gem"), fs.dot(v, v).alias("square"), F.element_at(fs.l2_normalize(v), 1).alias("first"), _weighed(fs.l2_normalize(v)).alias("weighed"))


def _contents(s, d):
    return _table(s, d, "documents").withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))


def _space(s, d):
    e = _table(s, d, "embeddings").select(F.size("embedding").alias("dim"), F.lit("l2").alias("normalization"))
    media.require_one_space(e, "dim", "normalization")
    return e.groupBy("dim", "normalization").agg(F.count(F.lit(1)).alias("n")).withColumn("params", fs.params_hash(dim=F.col("dim"), normalization=F.col("normalization")))


def _views(s, d):
    """Two views of each label's vectors: as they are, and reversed."""
    e = _table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("descriptor"))
    both = e.unionByName(e.withColumn("descriptor", F.reverse("descriptor")))
    return features.mean_of_views(both, "vec_id").select("vec_id", F.element_at("descriptor", 1).alias("first"), F.element_at("descriptor", 2).alias("second"), _weighed("descriptor").alias("weighed"))


def _encoded(s, d):
    """Each document's bytes as frames of 8 x 8 pixels, the last one padded; null and empty texts are one frame in error."""
    frames = features.byte_frames(_table(s, d, "documents"), "doc_id", "text", 8)
    e = features.encode(frames, keys=("doc_id", "frame_idx"))
    return e.select("doc_id", "frame_idx", F.size("descriptor").alias("dim"), fs.dot(F.col("descriptor"), F.col("descriptor")).alias("square"), "error")


def _refined(s, d):
    p = _Planted(s, d).stored()
    coarse = resolve.trace_once(p.query, p.index, p.shots, TEN).where("source is not null").select("shot_id", F.col("source").cast("int").alias("source_id"), F.col("query_start").alias("start"), F.col("query_end").alias("end"), "source_start", "source_end")
    return resolve.refine(p.query, p.index, coarse).drop("composite")


NOTES = ((1, "A cut"), (2, "B scale"), (3, "A cut"), (4, "unknown"), (5, "B scale"), (6, "C code"))


def _trace(s, d):
    p = _Planted(s, d).stored()
    return resolve.trace(p.query, p.index, p.shots)


def _resolved(s, d):
    p = _Planted(s, d).stored()
    return resolve.resolve(p.query, p.index, p.shots)


def _trace_once(s, d):
    p = _Planted(s, d).stored()
    return resolve.trace_once(p.query, p.index, p.shots, TEN)


def _trace_eval(s, d):
    pred = _trace_once(s, d).withColumnRenamed("shot_id", "id")
    return evaluate.details(planted.truth(s), pred)


def _ladder(s, d):
    p = _Planted(s, d).stored()
    return resolve.best_and_margin(resolve.trace_levels(p.query, p.index, p.shots, TEN)).select("shot_id", "source_id", "level", "composite", "margin")


# --- rows of the star schema as media, segments and runs --------------------------------------------------------------


def _line_segments(s, d):
    """The lines of each order as the segments of a query: two seconds each, from the source that the flag names."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    l = _table(s, d, "lineitem").withColumn("i", place.cast("double"))  # noqa: E741
    known = F.col("l_tax") > 0.005
    begin = F.when(known, F.col("i") * 2 + F.col("l_suppkey") % 3 * 0.25)
    rows = l.select(
        F.col("l_orderkey").alias("query_id"), (F.col("i") * 2).alias("query_start"), (F.col("i") * 2 + 2).alias("query_end"), F.when(known, F.when(F.col("l_linestatus") == "O", "open").otherwise("shut")).alias("source"), begin.alias("source_start"), (begin + 2).alias("source_end"),
        (F.col("l_quantity") / 64).alias("confidence"), F.when(known, F.when(F.col("l_quantity") > 40, "HIGH").otherwise("LOW")).otherwise("UNKNOWN").alias("status"), (1 + F.col("l_linenumber") % 4 * 0.0625).alias("speed"),
    )
    return rows.withColumn("scores", F.create_map(F.lit("visual"), F.col("confidence")))


def _part_truth(s, d):
    """A segment of four seconds for each part; parts of some sizes come from a hidden source."""
    p = _table(s, d, "part")
    hidden = F.col("p_size") % 10 == 0
    return p.select(
        F.col("p_partkey").cast("int").alias("id"), (F.col("p_partkey") * 4.0).alias("query_start"), (F.col("p_partkey") * 4.0 + 4).alias("query_end"), F.when(hidden, "_Hidden").otherwise(F.concat(F.lit("s"), (F.col("p_partkey") % 7).cast("string"))).alias("source"),
        (F.col("p_size") * 3.0).alias("source_start"), (F.col("p_size") * 3.0 + 4).alias("source_end"), F.lit(1.0).alias("speed"), F.when(hidden, "unknown").otherwise(F.concat(F.element_at(F.split(F.lit("A,B,C,D,E,F,G,H,I"), ","), (F.col("p_partkey") % 9 + 1).cast("int")), F.lit(" edit"))).alias("note"),
    )


def _part_predictions(s, d):
    """What a trace could have said of these: late, short, of another source, unknown, or (for the smallest parts) nothing."""
    p = _table(s, d, "part").where("p_size > 3")
    k, size = F.col("p_partkey"), F.col("p_size")
    unknown = size % 6 == 0
    begin = size * 3 + k % 4 * 0.25
    return p.select(
        k.cast("int").alias("id"), (k * 4.0 + size % 3 * 0.5).alias("query_start"), (k * 4.0 + 4).alias("query_end"), F.when(unknown, None).otherwise(F.concat(F.lit("s"), ((k + F.when(size % 5 == 1, 1).otherwise(0)) % 7).cast("string"))).alias("source"), F.when(~unknown, begin).alias("source_start"), F.when(~unknown, begin + 4 - k % 3 * 0.75).alias("source_end"),
        (size / 64.0).alias("confidence"), F.when(unknown, "UNKNOWN").when(size > 40, "HIGH").otherwise("LOW").alias("status"), F.lit(1.0).alias("speed"),
    )


def _part_details(s, d):
    return evaluate.details(_part_truth(s, d), _part_predictions(s, d))


def _order_runs(s, d):
    """Customers' orders as benchmark runs: configurations are priorities, cases the states of orders."""
    o = _table(s, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.col("o_orderpriority").alias("config"), F.col("o_orderstatus").alias("case"), (k % 13 != 5).alias("ok"), (k % 64 / 64.0).alias("source_recall"), (k % 32 / 32.0).alias("segment_recall"), F.when(k % 5 == 0, -1.0).otherwise(k % 16 / 4.0).alias("start_error"), (k % 128 / 2.0).alias("total_s"), (k % 2048 / 2.0).alias("peak_mb"),
    )


def _probes(s, d):
    """Parts as probe results: JSON with a stream's rates, sides and rotation; some durations stand in the container alone or nowhere."""
    p = _table(s, d, "part")
    size = F.col("p_size")
    video = F.struct(F.lit("video").alias("codec_type"), F.concat(size.cast("string"), F.lit("/2")).alias("avg_frame_rate"), F.lit("25/1").alias("r_frame_rate"), F.lit("1920").alias("width"), F.lit("1080").alias("height"), F.when(size % 3 == 0, F.lit("N/A")).otherwise((size * 0.5).cast("string")).alias("duration"), F.when(size % 4 == 1, "90").otherwise("0").alias("rotation"))
    raw = p.select("p_partkey", F.to_json(F.struct(F.array(video).alias("streams"), F.struct(F.when(size % 5 > 0, (size * 1.5).cast("string")).alias("duration")).alias("format"))).alias("probe"))
    return media.probe_rows(raw).drop("probe")


def _pts(s, d):
    """Quantities as the stored times of an order's lines: few orders' are in ascending order."""
    l = _table(s, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("local_index"), (F.col("l_quantity") / 32).alias("pts"))  # noqa: E741
    l = l.groupBy("source_id", "local_index").agg(F.min("pts").alias("pts"))  # noqa: E741
    return media.plausible_times(l, 4.0)


def _cached(s, d):
    """Labels' vector counts by way of a feature cache that holds half of them already."""
    e = _table(s, d, "embeddings")
    made = lambda keys: e.join(keys, "label", "left_semi").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    path = resolve.shared_path(s, "cache")
    labels = e.select("label").distinct()
    media.cached(s, path, labels.where("label < 5"), "label", made)
    return media.cached(s, path, labels, "label", made)


def _json(s, d, read):
    """Nations of a region as the segments of a JSON text, some without id, speed and status."""
    n = _table(s, d, "nation")
    k = F.col("n_nationkey")
    seg = F.struct(k.alias("_k"), F.when(k % 2 == 0, k).alias("id"), (k * 4.0).alias("query_start"), (k * 4.0 + 4).alias("query_end"), F.col("n_name").alias("source"), (k * 1.0).alias("source_start"), (k + 4.0).alias("source_end"), F.when(k % 3 == 0, 1.25).alias("speed"), F.when(k % 4 == 0, "LOW").alias("status"), F.when(k % 4 == 0, 0.5).alias("confidence"), F.when(k % 5 == 0, "note").alias("note"))
    return read(n.groupBy("n_regionkey").agg(F.to_json(F.struct(F.sort_array(F.collect_list(seg)).alias("segments"))).alias("j")), "j")


def _log(s, d):
    """Lines of an order as a decoder's log."""
    l = _table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("x"))  # noqa: E741
    said = F.transform("x", lambda r: F.format_string("n: %d pts_time:%.2f pos: 7", r["l_linenumber"], r["l_quantity"] / 4))
    return media.pts_times(l.select("l_orderkey", F.array_join(said, " | ").alias("log")), "log").select("l_orderkey", "i", "pts_time")


def _clips(s, d):
    l = _table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("length"), F.max(F.col("l_tax") > 0.005).alias("sound"))  # noqa: E741
    return report.concat_manifest(l, "l_orderkey", "l_linenumber", "length", "sound")


def _detected(s, d):
    """Shots of labels' vectors as gray frames, two a second."""
    e = _table(s, d, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int")).alias("pixels"))
    e = e.withColumn("ts", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1) / 2.0)
    return shots.detect_shots(e, e.groupBy("label").agg((F.max("ts") + 0.5).alias("duration")), "label", "ts", "pixels", ShotConfig(peak_ratio=0.0, deviations=1.0, most_threshold=1.0))


def queries() -> dict:
    p = _Planted
    cols = ["shot_id", "source_id"]
    return {
        "trace": lambda s, d: _r(_trace(s, d).drop("scores")),
        "trace_resolved": lambda s, d: _r(_resolved(s, d).drop("scores")),
        "trace_once": lambda s, d: _r(_trace_once(s, d).drop("scores")),
        "trace_evaluated": lambda s, d: _r(_trace_eval(s, d)),
        "resolve_ladder": lambda s, d: _r(_ladder(s, d)),
        "frames_view": lambda s, d: _r(p(s, d).index.select("source_id", "local_index", "ts", F.size("descriptor").alias("dim"), F.element_at("descriptor", 1).alias("first"), _weighed("descriptor").alias("weighed"))),
        "self_exclusion": lambda s, d: media.exclude_query(_table(s, d, "pages").select("page_id", "url"), _table(s, d, "pages").where("page_id = 0").select("url"), "url").select("page_id", "url"),
        "content_dedupe": lambda s, d: media.dedupe_content(_contents(s, d), "key", "doc_id"),
        "content_duplicates": lambda s, d: media.duplicates(_contents(s, d), "key", "doc_id"),
        "closed_time_slice": lambda s, d: media.time_slice(p(s, d).index, 2.0, 5.0).select("source_id", "local_index", "ts"),
        "sampled_frames": lambda s, d: media.sampled(p(s, d).index.select("source_id", "local_index", "ts"), 0.25).select("source_id", "local_index"),
        "shot_frame_range_join": lambda s, d: retrieval.shot_frames(p(s, d).query.select(F.col("shot_id").alias("of_shot"), "q_idx", "q_ts"), p(s, d).shots).select("shot_id", "of_shot", "q_idx", "q_ts"),
        "nearest_frame_fallback": _empty_shots,
        "cosine_pairs": lambda s, d: _r(_pairs(s, d)),
        "frame_topn_search": lambda s, d: _r(retrieval.top_frames(p(s, d).query, p(s, d).index, 5)),
        "source_scores": lambda s, d: _r(retrieval.source_scores(_maxima(s, d))),
        "frame_votes": lambda s, d: _r(retrieval.frame_votes(_top(s, d))),
        "rank_candidates": lambda s, d: _r(_candidates(s, d).drop("_some")),
        "adaptive_threshold": lambda s, d: _r(align.adaptive_threshold(_pairs(s, d))),
        "candidate_points": lambda s, d: _r(align.candidate_points(_pairs(s, d)).select(*cols, "q_idx", "s_idx", "sim")),
        "align_none": lambda s, d: _r(align.align_nearest(_pairs(s, d)).select(*cols, "q_idx", "s_idx", "sim")),
        "align_tn": lambda s, d: _r(_points("tn")(s, d)),
        "align_dp": lambda s, d: _r(_points("dp")(s, d)),
        "align_dtw": lambda s, d: _r(_points("dtw")(s, d)),
        "align_hv": lambda s, d: _r(_points("hv")(s, d)),
        "path_summary": lambda s, d: _r(align.path_summary(align.align_nearest(_pairs(s, d)))),
        "robust_time_fit": lambda s, d: _r(align.fit_times(_points("tn")(s, d)).drop("path")),
        "time_mapping": lambda s, d: _r(align.map_times(align.fit_times(_points("tn")(s, d)), p(s, d).shots, p(s, d).index.groupBy("source_id").agg(F.max("ts").alias("duration"))).select(*cols, "source_start", "source_end")),
        "score_normalise": lambda s, d: _r(_normalised(s, d)),
        "best_second_margin": lambda s, d: _r(report.best_second(_candidates(s, d))),
        "confidence_status": _grades,
        "shot_score_stats": lambda s, d: _r(shots.thresholds(_events(s, d), "user_id")),
        "shot_local_maxima": lambda s, d: _r(shots.peaks(_events(s, d), "user_id", "event_id", shots.thresholds(_events(s, d), "user_id")).select("user_id", "event_id", "score")),
        "greedy_min_gap": _spaced,
        "build_shots": lambda s, d: _r(_built(s, d)),
        "fixed_shots": _fixed,
        "histogram_features": lambda s, d: _r(_histograms(s, d)),
        "change_scores": lambda s, d: _r(_changes(s, d)),
        "detected_shots": lambda s, d: _r(_detected(s, d)),
        "merge_segments": lambda s, d: _r(merge.merge_segments(_line_segments(s, d)).drop("scores")),
        "merge_fixture": lambda s, d: _r(_merged(s, d)),
        "report_rows": lambda s, d: report.csv_rows(_line_segments(s, d).drop("scores")),
        "status_summary": lambda s, d: _r(report.status_summary(_line_segments(s, d), "query_id", _table(s, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.lit(20.0).alias("duration")))),
        "top_candidates": lambda s, d: report.top_candidates(_candidates(s, d), 5).select("shot_id", F.to_json("candidates").alias("candidates")),
        "clip_manifest": lambda s, d: _r(report.clip_manifest(_line_segments(s, d).withColumnRenamed("query_id", "id"))),
        "sample_times": lambda s, d: _r(report.sample_times(_part_truth(s, d), 5)),
        "concat_manifest": lambda s, d: _r(_clips(s, d)),
        "stage_times": lambda s, d: _r(report.stage_times(_table(s, d, "events"), "event_type", "value")),
        "eval_fixture": lambda s, d: _r(evaluate.details(_truth(s), _predictions(s))),
        "eval_matching": lambda s, d: _r(_part_details(s, d)),
        "eval_summary": lambda s, d: _r(evaluate.summary(_part_details(s, d), _part_predictions(s, d))),
        "false_positives": lambda s, d: evaluate.false_positives(_part_predictions(s, d), _part_details(s, d)).select("id", "source"),
        "view_means": lambda s, d: _r(_views(s, d)),
        "frame_descriptors": lambda s, d: _r(_encoded(s, d)),
        "refined_segments": lambda s, d: _r(_refined(s, d)),
        "rescan_sources": lambda s, d: resolve.short_sources(p(s, d).index, 48.0),
        "edit_support": lambda s, d: _r(evaluate.by_note(_part_details(s, d), _part_truth(s, d).select("id", "note"))),
        "failures": lambda s, d: evaluate.failures(_part_details(s, d)),
        "bench_rollup": lambda s, d: _r(evaluate.roll_up(_order_runs(s, d))),
        "bench_best": lambda s, d: evaluate.best_config(evaluate.roll_up(_order_runs(s, d))),
        "bench_runs": lambda s, d: _r(evaluate.runs_of(_order_runs(s, d), case="F")),
        "bench_grid": lambda s, d: evaluate.grid(_table(s, d, "region").select(F.col("r_name").alias("config")), _table(s, d, "nation").select(F.col("n_name").alias("case"), "n_nationkey"), _table(s, d, "customer").select("c_nationkey").distinct().join(_table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("case"))),
        "probe_rows": lambda s, d: _r(_probes(s, d)),
        "plausible_times": lambda s, d: _r(_pts(s, d)),
        "interval_frames": lambda s, d: _r(media.interval_frames(p(s, d).index.select("source_id", "local_index", "ts"), 3.0, 20.0, 0.5)),
        "feature_cache": _cached,
        "ground_truth_rows": lambda s, d: _r(_json(s, d, media.truth_rows)),
        "prediction_rows": lambda s, d: _r(_json(s, d, media.prediction_rows)),
        "pts_times": lambda s, d: _r(_log(s, d)),
        "source_lookup": lambda s, d: media.by_name(_table(s, d, "part").select(F.col("p_partkey").alias("source_id"), F.col("p_brand").alias("name")), "Brand#1").unionByName(media.by_id(_table(s, d, "part").select(F.col("p_partkey").alias("source_id"), F.col("p_brand").alias("name")), 17)),
        "content_fingerprint": lambda s, d: _table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("b")).select("doc_id", fs.fingerprint(F.length("b").cast("long"), F.col("b")).alias("fingerprint")),
        "first_candidates": lambda s, d: resolve.first_candidates(_candidates(s, d), 3).select("shot_id", "source_id", "rank"),
        "running_cursor": lambda s, d: _r(report.running_cursor(_table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("length")), "l_orderkey", "l_linenumber", "length")),
        "scalar_functions": lambda s, d: _r(_scalars(s, d)),
        "vector_functions": lambda s, d: _r(_gem(s, d)),
        "space_guard": _space,
    }


# --- SQL ------------------------------------------------------------------------------------------------------------


def _values(rows) -> str:
    def one(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def _plan_rows():
    at = 0.0
    for shot, n, label, first, speed, strength in planted.PLAN:
        for i in range(n):
            yield shot, i, at + i, strength[i % len(strength)], label, first + int(speed * i + 0.5), (label + 1 + (3 * i + shot) % 9) % 10, (7 * shot + 17 * i) % 40
        at += n


def _truth_rows():
    at = 0.0
    for shot, n, label, first, speed, _ in planted.PLAN:
        hidden = label == planted.WITHHELD
        yield shot, at, at + n - 0.5, "_Hidden" if hidden else str(label), float(first), first + speed * (n - 0.5), speed, "unknown" if hidden else ""
        at += n


def _shot_rows():
    at = 0.0
    for shot, n, *_ in planted.PLAN:
        yield shot, at, at + n - 0.5
        at += n


BASE = f"""
WITH fr AS (SELECT label AS source_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS local_index, embedding::DOUBLE[] AS descriptor FROM embeddings),
bl AS (SELECT a.local_index, list_transform(range(1, len(a.descriptor) + 1), lambda k: a.descriptor[k] * 0.99::DOUBLE + b.descriptor[k] * 0.141::DOUBLE) AS v FROM fr a JOIN fr b USING (local_index) WHERE a.source_id = 3 AND b.source_id = 8),
ix0 AS (SELECT * FROM fr WHERE source_id <> 9 UNION ALL SELECT 103, local_index, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-8)) FROM bl),
ix AS (SELECT source_id::INT AS source_id, local_index, local_index::DOUBLE AS ts, descriptor FROM ix0),
pl AS (SELECT * FROM (VALUES {_values(_plan_rows())}) t(shot_id, q_idx, q_ts, a, l1, i1, l2, i2)),
shots AS (SELECT * FROM (VALUES {_values(_shot_rows())}) t(shot_id, "start", "end")),
qm AS (SELECT shot_id, q_idx, q_ts, list_transform(range(1, len(x.descriptor) + 1), lambda k: a * x.descriptor[k] + sqrt(1 - a * a) * y.descriptor[k]) AS v
       FROM pl JOIN fr x ON x.source_id = l1 AND x.local_index = i1 JOIN fr y ON y.source_id = l2 AND y.local_index = i2),
q AS (SELECT shot_id, q_idx, q_ts, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-8)) AS descriptor FROM qm),
sim AS (SELECT shot_id, q_idx, q_ts, source_id, local_index AS s_idx, ts AS s_ts, list_dot_product(q.descriptor, ix.descriptor) AS sim FROM q, ix),
mx AS (SELECT shot_id, source_id, q_idx, max(sim) AS sim FROM sim GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY shot_id, q_idx ORDER BY sim DESC, source_id, s_idx)::INT AS rank FROM sim QUALIFY rank <= 10),
sc0 AS (SELECT *, row_number() OVER (PARTITION BY shot_id, source_id ORDER BY sim DESC) AS r, count(*) OVER (PARTITION BY shot_id, source_id) AS n FROM mx),
sc AS (SELECT shot_id, source_id, avg(sim) FILTER (WHERE r <= greatest(1, round_even(n * 0.8::DOUBLE, 0))) AS visual, median(sim) AS median, avg((sim > 0.5)::INT::DOUBLE) AS hit_ratio FROM sc0 GROUP BY ALL),
vt0 AS (SELECT shot_id, source_id, sum(greatest(sim, 0)) AS v FROM top GROUP BY ALL),
vt AS (SELECT shot_id, source_id, coalesce(v / nullif(sum(v) OVER (PARTITION BY shot_id), 0), 0) AS vote FROM vt0),
rk0 AS (SELECT shot_id, source_id, visual, median, hit_ratio, coalesce(vote, 0) AS vote, 0.75::DOUBLE * visual + 0.25::DOUBLE * coalesce(vote, 0) AS score FROM sc LEFT JOIN vt USING (shot_id, source_id)),
rk1 AS (SELECT *, (row_number() OVER (PARTITION BY shot_id ORDER BY score DESC, source_id))::INT AS rank FROM rk0 QUALIFY rank <= 5),
rk AS (SELECT * FROM (SELECT *, max((visual >= 0.3)::INT) OVER (PARTITION BY shot_id) AS any_good FROM rk1) WHERE visual >= 0.3 OR (any_good = 0 AND rank = 1)),
th0 AS (SELECT *, row_number() OVER (PARTITION BY shot_id, source_id ORDER BY sim DESC, q_idx, s_idx) AS r, count(*) OVER (PARTITION BY shot_id, source_id) AS n FROM sim),
nq AS (SELECT shot_id, count(DISTINCT q_idx) AS nq FROM q GROUP BY ALL),
th AS (SELECT shot_id, source_id, greatest(sim, 0.35) AS threshold FROM th0 JOIN nq USING (shot_id) WHERE r = least(n, greatest(1, nq * 5))),
an AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shot_id, source_id, q_idx ORDER BY sim DESC, s_idx) AS r FROM sim) WHERE r = 1 AND sim >= 0.35)
"""


_POINTS = """,
cp AS (SELECT s.* FROM (SELECT *, row_number() OVER (PARTITION BY shot_id, source_id, q_idx ORDER BY sim DESC, s_idx) AS r FROM sim) s JOIN th USING (shot_id, source_id) JOIN rk USING (shot_id, source_id) WHERE r <= 5 AND (sim >= threshold OR (r = 1 AND sim >= 0.35)))"""


def _rounded(select: str, doubles: str, plain: str) -> str:
    return f"SELECT {', '.join(plain.split())}, {', '.join(f'round({c}, {R}) + 0.0 AS {c}' for c in doubles.split())} FROM ({select})"


_STAT = """WITH ev AS (SELECT user_id, event_id, value / (abs(value) + 100.0::DOUBLE) AS score FROM events), md AS (SELECT user_id, median(score) AS med FROM ev GROUP BY ALL),
ma AS (SELECT user_id, med, median(abs(score - med)) AS mad FROM ev JOIN md USING (user_id) GROUP BY ALL),
st AS (SELECT user_id, med, mad, least(0.35::DOUBLE, greatest(0.12::DOUBLE, med + 6.0::DOUBLE * 1.4826::DOUBLE * mad)) AS threshold FROM ma)"""
_SEG = f"WITH seg AS (SELECT * FROM (VALUES {_values(SEGMENTS)}) t(query_id, query_start, query_end, source, source_start, source_end, confidence, status, speed))"
_DET = r"""m0 AS (SELECT g.*, p.id AS pid, p.query_start AS pq0, p.query_end AS pq1, p.source AS ps, p.source_start AS ps0, p.source_end AS ps1, p.status AS pst, p.speed AS psp,
       greatest(0, least(g.query_end, p.query_end) - greatest(g.query_start, p.query_start)) AS ov FROM g JOIN p ON p.query_start < g.query_end AND p.query_end > g.query_start),
m1 AS (SELECT * FROM m0 WHERE ov / greatest(query_end - query_start, 1e-9) >= 0.3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY ov DESC, pid) = 1),
m AS (SELECT g.*, pid, pq0, pq1, ps, ps0, ps1, pst, psp, (g.source LIKE '\_Hidden%' ESCAPE '\' OR g.note LIKE '%unknown%') AND pid IS NOT NULL AS ux FROM g LEFT JOIN m1 USING (id)),
det0 AS (SELECT *, coalesce(pid IS NOT NULL AND ps IS NOT NULL AND pst <> 'UNKNOWN', FALSE) AS named FROM m),
det1 AS (SELECT *, coalesce(named AND ps = source, FALSE) AND NOT ux AS ok FROM det0),
det2 AS (SELECT *, greatest(0, least(source_end, ps1) - greatest(source_start, ps0)) AS si, greatest(0, least(query_end, pq1) - greatest(query_start, pq0)) AS qi FROM det1),
det AS (SELECT id, source, pid AS pred_id, ps AS pred_source, ux AS unknown_expected, CASE WHEN pid IS NULL THEN 'MISS' ELSE pst END AS status, ok AS source_correct,
       coalesce(ok AND si / ((source_end - source_start) + (ps1 - ps0) - si) >= 0.5, FALSE) AS segment_correct,
       CASE WHEN ok THEN si / ((source_end - source_start) + (ps1 - ps0) - si) END AS iou,
       CASE WHEN ok THEN si * qi / ((query_end - query_start) * (source_end - source_start) + (pq1 - pq0) * (ps1 - ps0) - si * qi) END AS iou_2d,
       CASE WHEN ok THEN abs(ps0 - source_start) END AS start_error, CASE WHEN ok THEN abs(ps1 - source_end) END AS end_error,
       CASE WHEN ok THEN abs(ps0 + (query_start - pq0) * psp - source_start) END AS aligned_error, ux AND NOT named AS unknown_correct FROM det2),
fp AS (SELECT id, source FROM p WHERE source IS NOT NULL AND status <> 'UNKNOWN' AND id NOT IN (SELECT pred_id FROM det WHERE source_correct))"""
_EVAL = f"""WITH g AS (SELECT * FROM (VALUES {_values(TRUTH)}) t(id, query_start, query_end, source, source_start, source_end, speed, note)),
p AS (SELECT * FROM (VALUES {_values(PREDICTIONS)}) t(id, query_start, query_end, source, source_start, source_end, confidence, status, speed)),
{_DET}"""
_PART = f"""WITH g AS (SELECT p_partkey::INT AS id, p_partkey * 4.0::DOUBLE AS query_start, p_partkey * 4.0::DOUBLE + 4 AS query_end, CASE WHEN p_size % 10 = 0 THEN '_Hidden' ELSE 's' || p_partkey % 7 END AS source, p_size * 3.0::DOUBLE AS source_start, p_size * 3.0::DOUBLE + 4 AS source_end, 1::DOUBLE AS speed,
    CASE WHEN p_size % 10 = 0 THEN 'unknown' ELSE substr('ABCDEFGHI', (p_partkey % 9)::INT + 1, 1) || ' edit' END AS note FROM part),
p AS (SELECT p_partkey::INT AS id, p_partkey * 4.0::DOUBLE + p_size % 3 * 0.5::DOUBLE AS query_start, p_partkey * 4.0::DOUBLE + 4 AS query_end, CASE WHEN p_size % 6 > 0 THEN 's' || (p_partkey + (p_size % 5 = 1)::INT) % 7 END AS source, CASE WHEN p_size % 6 > 0 THEN p_size * 3 + p_partkey % 4 * 0.25::DOUBLE END AS source_start,
    CASE WHEN p_size % 6 > 0 THEN p_size * 3 + p_partkey % 4 * 0.25::DOUBLE + 4 - p_partkey % 3 * 0.75::DOUBLE END AS source_end, p_size / 64.0::DOUBLE AS confidence, CASE WHEN p_size % 6 = 0 THEN 'UNKNOWN' WHEN p_size > 40 THEN 'HIGH' ELSE 'LOW' END AS status, 1::DOUBLE AS speed FROM part WHERE p_size > 3),
{_DET}"""
_LINES = """seg AS (SELECT l_orderkey AS query_id, i, i * 2.0::DOUBLE AS query_start, i * 2.0::DOUBLE + 2 AS query_end, CASE WHEN l_tax > 0.005 THEN CASE WHEN l_linestatus = 'O' THEN 'open' ELSE 'shut' END END AS source, CASE WHEN l_tax > 0.005 THEN i * 2 + l_suppkey % 3 * 0.25::DOUBLE END AS source_start,
    CASE WHEN l_tax > 0.005 THEN i * 2 + l_suppkey % 3 * 0.25::DOUBLE + 2 END AS source_end, l_quantity / 64::DOUBLE AS confidence, CASE WHEN l_tax > 0.005 THEN CASE WHEN l_quantity > 40 THEN 'HIGH' ELSE 'LOW' END ELSE 'UNKNOWN' END AS status, 1 + l_linenumber % 4 * 0.0625::DOUBLE AS speed
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem))"""
_RUN = f"""WITH runs AS (SELECT o_orderpriority AS config, o_orderstatus AS "case", o_orderkey % 13 <> 5 AS ok, o_orderkey % 64 / 64::DOUBLE AS source_recall, o_orderkey % 32 / 32::DOUBLE AS segment_recall, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE o_orderkey % 16 / 4::DOUBLE END AS start_error, o_orderkey % 128 / 2::DOUBLE AS total_s, o_orderkey % 2048 / 2::DOUBLE AS peak_mb FROM orders),
ru AS (SELECT config, avg(source_recall) FILTER (WHERE source_recall >= 0) AS source_recall, avg(segment_recall) FILTER (WHERE segment_recall >= 0) AS segment_recall,
       avg(start_error) FILTER (WHERE start_error >= 0) AS start_error, avg(total_s) FILTER (WHERE total_s >= 0) AS total_s, max(peak_mb) AS peak_mb, count(*) AS n_runs FROM runs WHERE ok GROUP BY config)"""
_PIX = "WITH px AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 127.5::DOUBLE)::INT) AS pixels FROM embeddings), hi AS (SELECT *, list_transform(range(0, 32), lambda b: len(list_filter(pixels, lambda p: p // 8 = b))::DOUBLE / len(pixels)) AS hist FROM px)"
_CONF = """WITH x AS (SELECT l_orderkey, l_linenumber, l_orderkey * 7919 % 9973 / 9973.0::DOUBLE AS v, 1 - l_tax * 5 AS c, l_discount * 2 AS margin, l_linenumber / 7.0::DOUBLE AS r2, l_tax * 4 AS rmse, l_linenumber * 0.7::DOUBLE AS len FROM lineitem),
y AS (SELECT *, greatest(0, least(1, margin / (4 * 0.04::DOUBLE))) AS mar, greatest(0, least(1, 0.5::DOUBLE * r2 + 0.5::DOUBLE * exp(-rmse / 0.5::DOUBLE))) AS ali FROM x),
z AS (SELECT l_orderkey, l_linenumber, margin, round(greatest(0, least(1, (0.45::DOUBLE * greatest(0, least(1, v)) + 0.25::DOUBLE * greatest(0, least(1, c)) + 0.15::DOUBLE * mar + 0.15::DOUBLE * ali)
      * (0.85::DOUBLE + 0.15::DOUBLE * greatest(0.4::DOUBLE, least(1, len / 3))))), 6) AS confidence FROM y)"""
_LABEL = "lpad((floor({c} / 6000)::BIGINT)::VARCHAR, 2, '0') || '-' || lpad((floor({c} / 100)::BIGINT % 60)::VARCHAR, 2, '0') || '-' || lpad(({c}::BIGINT % 100)::VARCHAR, 2, '0')"


def _label(t: str) -> str:
    return _LABEL.format(c=f"round_even({t} * 100, 0)")


_TN = BASE.replace("WITH fr AS", "WITH RECURSIVE fr AS", 1) + _POINTS + """,
pts AS (SELECT shot_id, source_id, list(q_idx ORDER BY q_idx, s_idx) AS qs, list(s_idx ORDER BY q_idx, s_idx) AS ss, list(sim ORDER BY q_idx, s_idx) AS vs, list(q_ts ORDER BY q_idx, s_idx) AS qt, list(s_ts ORDER BY q_idx, s_idx) AS st, count(*) AS n FROM cp GROUP BY ALL),
dp AS (SELECT shot_id, source_id, 0 AS i, []::DOUBLE[] AS best, []::BIGINT[] AS pred, qs, ss, vs, n FROM pts
       UNION ALL SELECT shot_id, source_id, i + 1, list_append(best, vs[i + 1] + coalesce(list_max(cand), 0)), list_append(pred, CASE WHEN coalesce(list_max(cand), 0) > 0 THEN list_position(cand, list_max(cand)) ELSE 0 END), qs, ss, vs, n
       FROM (SELECT *, list_transform(range(1, i + 1), lambda j: CASE WHEN qs[i + 1] - qs[j] BETWEEN 1 AND 10 AND ss[i + 1] - ss[j] BETWEEN 1 AND 10 AND ss[i + 1] - ss[j] >= 0.5 * (qs[i + 1] - qs[j]) AND ss[i + 1] - ss[j] <= 2 * (qs[i + 1] - qs[j]) THEN best[j] ELSE 0 END) AS cand FROM dp WHERE i < n)),
fin AS (SELECT shot_id, source_id, list_position(best, list_max(best)) AS k, pred FROM dp WHERE i = n),
bt AS (SELECT shot_id, source_id, k, pred FROM fin UNION ALL SELECT shot_id, source_id, pred[k], pred FROM bt WHERE pred[k] > 0),
ch AS (SELECT shot_id, source_id, k FROM bt QUALIFY count(*) OVER (PARTITION BY shot_id, source_id) >= 3),
tp AS (SELECT shot_id, source_id, qs[k] AS q_idx, qt[k] AS q_ts, ss[k] AS s_idx, st[k] AS s_ts, vs[k] AS sim FROM ch JOIN pts USING (shot_id, source_id)),
du AS (SELECT source_id, max(ts) AS duration FROM ix GROUP BY source_id)
"""


def _fit_sql(rounds: int = 3) -> str:
    """The robust time fit with its rounds written out."""
    g = "PARTITION BY shot_id, source_id"
    out = f", r0 AS (SELECT shot_id, source_id, q_ts AS q, s_ts AS s, TRUE AS m, FALSE AS stop, 1::DOUBLE AS slope, median(s_ts - q_ts) OVER ({g}) AS ic FROM tp)"
    for k in range(1, rounds + 1):
        out += f"""
, a{k} AS (SELECT shot_id, source_id, count(*) AS c, max(q) - min(q) AS rg, greatest(0.5::DOUBLE, least(2::DOUBLE, regr_slope(s, q))) AS sl FROM r{k - 1} WHERE m GROUP BY ALL)
, b{k} AS (SELECT r.*, c < 2 OR rg < 1e-9 AS flat, CASE WHEN c < 2 OR rg < 1e-9 THEN 1 ELSE sl END AS ns FROM r{k - 1} r JOIN a{k} USING (shot_id, source_id))
, c{k} AS (SELECT shot_id, source_id, median(s - ns * q) AS ni FROM b{k} WHERE m GROUP BY ALL)
, d{k} AS (SELECT b{k}.*, ni, abs(s - (ns * q + ni)) AS rs FROM b{k} JOIN c{k} USING (shot_id, source_id))
, e{k} AS (SELECT shot_id, source_id, greatest(2 * stddev_pop(rs), 0.15::DOUBLE) AS thr FROM d{k} WHERE m GROUP BY ALL)
, f{k} AS (SELECT *, rs <= thr AS nm FROM d{k} JOIN e{k} USING (shot_id, source_id))
, g{k} AS (SELECT *, sum(nm::INT) OVER ({g}) AS nc, bool_and(nm = m) OVER ({g}) AS same, count(*) OVER ({g}) AS n FROM f{k})
, h{k} AS (SELECT *, nc < greatest(2, floor(0.4::DOUBLE * n)) OR same AS last FROM g{k})
, r{k} AS (SELECT shot_id, source_id, q, s, CASE WHEN stop OR flat OR (last AND nc < 2) THEN m ELSE nm END AS m, stop OR flat OR last AS stop, CASE WHEN stop THEN slope ELSE ns END AS slope, CASE WHEN stop THEN ic ELSE ni END AS ic FROM h{k})"""
    return out + f"""
, i0 AS (SELECT shot_id, source_id, any_value(slope) AS slope, any_value(ic) AS intercept, sqrt(avg(pow(s - (slope * q + ic), 2)) FILTER (WHERE m)) AS rmse, sum(pow(s - (slope * q + ic), 2)) FILTER (WHERE m) AS res,
         var_pop(s) FILTER (WHERE m) * count(*) FILTER (WHERE m) AS tot, count(*)::INT AS n_points, (count(*) FILTER (WHERE m))::INT AS n_inliers FROM r{rounds} GROUP BY ALL)
, fit AS (SELECT shot_id, source_id, slope, intercept, CASE WHEN tot > 1e-9 THEN greatest(0, least(1, 1 - res / tot)) WHEN rmse < 0.3 THEN 1 ELSE 0 END AS r2, rmse, n_points, n_inliers FROM i0)
"""


_MAPPED = """SELECT shot_id, source_id, greatest(0, least(duration, least(slope * "start" + intercept, slope * "end" + intercept))) AS source_start,
    greatest(0, least(duration, greatest(slope * "start" + intercept, slope * "end" + intercept))) AS source_end FROM fit JOIN shots USING (shot_id) JOIN du USING (source_id)"""
_TRACE = f""", ps AS (SELECT shot_id, source_id, avg(sim) AS visual, least(1, count(DISTINCT q_idx)::DOUBLE / (max(q_idx) - min(q_idx) + 1)) AS coverage FROM tp GROUP BY ALL)
, mp AS ({_MAPPED})
, al AS (SELECT *, visual * (0.5::DOUBLE + 0.5::DOUBLE * coverage) AS comp FROM ps JOIN fit USING (shot_id, source_id) JOIN mp USING (shot_id, source_id))
, be AS (SELECT *, comp - greatest(coalesce(lead(comp) OVER w, 0), 0) AS margin, row_number() OVER w AS k FROM al WINDOW w AS (PARTITION BY shot_id ORDER BY comp DESC, source_id))
, cf AS (SELECT s.shot_id, "start" AS query_start, "end" AS query_end, source_id, source_start, source_end, slope, comp, margin,
    CASE WHEN comp IS NULL THEN 0 ELSE greatest(0, least(1, (0.45::DOUBLE * greatest(0, least(1, visual)) + 0.25::DOUBLE * greatest(0, least(1, coverage)) + 0.15::DOUBLE * greatest(0, least(1, margin / (4 * 0.04::DOUBLE)))
    + 0.15::DOUBLE * greatest(0, least(1, 0.5::DOUBLE * r2 + 0.5::DOUBLE * exp(-rmse / 0.5::DOUBLE)))) * (0.85::DOUBLE + 0.15::DOUBLE * greatest(0.4::DOUBLE, least(1, ("end" - "start") / 3))))) END AS confidence
    FROM shots s LEFT JOIN (SELECT * FROM be WHERE k = 1) b USING (shot_id))
, gr AS (SELECT *, CASE WHEN comp IS NULL OR source_end - source_start < 0.4::DOUBLE THEN 'UNKNOWN' WHEN margin < 0.04 AND confidence < 0.8 THEN 'UNKNOWN' WHEN confidence >= 0.8 THEN 'HIGH' WHEN confidence >= 0.65 THEN 'MEDIUM' WHEN confidence >= 0.5 THEN 'LOW' ELSE 'UNKNOWN' END AS status FROM cf)
SELECT shot_id, round(query_start, 6) AS query_start, round(query_end, 6) AS query_end, CASE WHEN status <> 'UNKNOWN' THEN source_id::VARCHAR END AS source, round(CASE WHEN status <> 'UNKNOWN' THEN source_start END, 6) + 0.0 AS source_start,
    round(CASE WHEN status <> 'UNKNOWN' THEN source_end END, 6) + 0.0 AS source_end, round(confidence, 6) AS confidence, status, round(CASE WHEN status <> 'UNKNOWN' THEN slope ELSE 1 END, 6) + 0.0 AS speed FROM gr"""


def oracle_sql() -> dict[str, str]:
    b = lambda select, doubles, plain: BASE + _rounded(select, doubles, plain)
    return {
        "frames_view": b("SELECT source_id, local_index, ts, len(descriptor)::INT AS dim, descriptor[1] AS first, list_sum(list_transform(range(1, len(descriptor) + 1), lambda k: descriptor[k] * k)) AS weighed FROM ix", "ts first weighed", "source_id local_index dim"),
        "self_exclusion": "SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id = 0)",
        "content_dedupe": "SELECT key, min(doc_id) AS doc_id, count(DISTINCT doc_id) - 1 AS n_duplicates FROM (SELECT sha256(coalesce(text, '')) AS key, doc_id FROM documents) GROUP BY key",
        "content_duplicates": "SELECT DISTINCT key, first AS doc_id, doc_id AS duplicate FROM (SELECT *, min(doc_id) OVER (PARTITION BY key) AS first FROM (SELECT sha256(coalesce(text, '')) AS key, doc_id FROM documents)) WHERE doc_id <> first",
        "closed_time_slice": BASE + "SELECT source_id, local_index, ts FROM ix WHERE ts BETWEEN 2 - 1e-9 AND 5 + 1e-9",
        "sampled_frames": BASE + "SELECT source_id, min(local_index) AS local_index FROM ix GROUP BY source_id, floor(ts * 0.25)",
        "shot_frame_range_join": BASE + """SELECT s.shot_id, q.shot_id AS of_shot, q_idx, q_ts FROM q JOIN shots s ON q_ts BETWEEN s."start" - 1e-9 AND s."end" + 1e-9""",
        "nearest_frame_fallback": BASE + """, f AS (SELECT local_index::DOUBLE AS t FROM fr WHERE source_id = 0), g AS (SELECT * FROM (VALUES (1, 3.2::DOUBLE, 3.6::DOUBLE), (2, 7.4, 7.6), (3, 2.0, 4.0), (4, 9.7, 9.9), (5, 100000.25, 100000.75)) t(shot_id, a, z)),
            e AS (SELECT shot_id, (a + z) / 2 AS mid FROM g WHERE NOT EXISTS (SELECT 1 FROM f WHERE t BETWEEN a - 1e-9 AND z + 1e-9))
            SELECT shot_id, mid, t AS nearest_ts FROM e, f QUALIFY row_number() OVER (PARTITION BY shot_id ORDER BY abs(t - mid), t) = 1""",
        "cosine_pairs": b("SELECT * FROM sim", "q_ts s_ts sim", "shot_id q_idx source_id s_idx"),
        "frame_topn_search": b("SELECT * FROM top WHERE rank <= 5", "sim", "shot_id q_idx source_id s_idx rank"),
        "source_scores": b("SELECT * FROM sc", "visual median hit_ratio", "shot_id source_id"),
        "frame_votes": b("SELECT * FROM vt", "vote", "shot_id source_id"),
        "rank_candidates": b("SELECT * FROM rk", "visual median hit_ratio vote score", "shot_id source_id rank"),
        "adaptive_threshold": b("SELECT * FROM th", "threshold", "shot_id source_id"),
        "candidate_points": b("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shot_id, source_id, q_idx ORDER BY sim DESC, s_idx) AS r FROM sim) JOIN th USING (shot_id, source_id) WHERE r <= 5 AND (sim >= threshold OR (r = 1 AND sim >= 0.35))", "sim", "shot_id source_id q_idx s_idx"),
        "align_none": b("SELECT * FROM an", "sim", "shot_id source_id q_idx s_idx"),
        "align_tn": _TN + _rounded("SELECT shot_id, source_id, 0 AS path, q_idx, q_ts, s_idx, s_ts, sim FROM tp", "q_ts s_ts sim", "shot_id source_id path q_idx s_idx"),
        "robust_time_fit": _TN + _fit_sql() + _rounded("SELECT * FROM fit", "slope intercept r2 rmse", "shot_id source_id n_points n_inliers"),
        "time_mapping": _TN + _fit_sql() + _rounded(_MAPPED, "source_start source_end", "shot_id source_id"),
        "trace_once": _TN + _fit_sql() + _TRACE,
        # at one frame a second each level sees the same frames, so the first level stays
        "resolve_ladder": _TN + _fit_sql() + _TRACE[: _TRACE.index(", cf AS")] + _rounded("SELECT shot_id, source_id, 0 AS level, comp AS composite, margin FROM be WHERE k = 1", "composite margin", "shot_id source_id level"),
        "trace_evaluated": _TN + _fit_sql() + _TRACE[: _TRACE.rindex("SELECT shot_id")] + f""", g AS (SELECT * FROM (VALUES {_values(_truth_rows())}) t(id, query_start, query_end, source, source_start, source_end, speed, note)),
p AS (SELECT shot_id AS id, query_start, query_end, CASE WHEN status <> 'UNKNOWN' THEN source_id::VARCHAR END AS source, CASE WHEN status <> 'UNKNOWN' THEN source_start END AS source_start, CASE WHEN status <> 'UNKNOWN' THEN source_end END AS source_end, confidence, status, CASE WHEN status <> 'UNKNOWN' THEN slope ELSE 1 END AS speed FROM gr),
{_DET}""" + _rounded("SELECT * FROM det", "iou iou_2d start_error end_error aligned_error", "id source pred_id pred_source unknown_expected status source_correct segment_correct unknown_correct"),
        "align_hv": (BASE + _POINTS).replace("sim AS (", "sim AS MATERIALIZED (").replace("cp AS (", "cp AS MATERIALIZED (").replace("rk AS (", "rk AS MATERIALIZED (").replace("th AS (", "th AS MATERIALIZED (") + """,
sl AS (SELECT * FROM (VALUES (1, 0.8::DOUBLE), (2, 0.9), (3, 1.0), (4, 1.1), (5, 1.25)) t(o, k)),
h0 AS (SELECT cp.*, o, s_idx - k * q_idx AS off FROM cp, sl),
h1 AS (SELECT *, min(off) OVER w AS lo, max(off) OVER w AS hi FROM h0 WINDOW w AS (PARTITION BY shot_id, source_id, o)),
h2 AS (SELECT *, (hi + 1e-6 - lo) / greatest(4, ceil(hi - lo)::INT + 1) AS w, greatest(4, ceil(hi - lo)::INT + 1) AS n FROM h1),
h3 AS (SELECT *, least(n - 1, floor((off - lo) / w)) AS bin FROM h2),
h4 AS (SELECT shot_id, source_id, o, bin, any_value(lo) + bin * any_value(w) - 1 AS a, any_value(lo) + (bin + 1) * any_value(w) + 1 AS z, sum(sim) AS weight FROM h3 GROUP BY shot_id, source_id, o, bin QUALIFY row_number() OVER (PARTITION BY shot_id, source_id, o ORDER BY weight DESC, bin) = 1),
h5 AS (SELECT h0.*, sum(sim) OVER v AS total, count(*) OVER v AS c FROM h0 JOIN h4 USING (shot_id, source_id, o) WHERE off BETWEEN a AND z WINDOW v AS (PARTITION BY shot_id, source_id, o)),
h6 AS (SELECT shot_id, source_id, o FROM h5 WHERE c >= 3 QUALIFY row_number() OVER (PARTITION BY shot_id, source_id ORDER BY total DESC, o) = 1)
""" + _rounded("SELECT h5.*, 0 AS path FROM h5 JOIN h6 USING (shot_id, source_id, o)", "q_ts s_ts sim", "shot_id source_id path q_idx s_idx"),
        "build_shots": """WITH RECURSIVE ev AS (SELECT user_id, event_id / 100.0::DOUBLE AS t FROM events), du AS (SELECT user_id, max(t) + 3.0::DOUBLE AS duration FROM ev GROUP BY user_id),
g AS (SELECT user_id, min(t) AS t FROM ev WHERE t >= 2 GROUP BY user_id UNION ALL SELECT g.user_id, (SELECT min(t) FROM ev e WHERE e.user_id = g.user_id AND e.t - g.t >= 2) AS t FROM g WHERE g.t IS NOT NULL),
bo AS (SELECT user_id, 0::DOUBLE AS t FROM du UNION ALL SELECT g.user_id, t FROM g JOIN du USING (user_id) WHERE t < duration - 1e-3 UNION ALL SELECT user_id, duration FROM du),
se AS (SELECT user_id, t AS a, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS z FROM bo QUALIFY z - a >= 1e-3),
pa AS (SELECT user_id, a, z, n, unnest(range(0, n)) AS k FROM (SELECT *, greatest(1, ceil((z - a) / 8)::INT) AS n FROM se)),
sh AS (SELECT user_id, a + k * ((z - a) / n) AS "start", CASE WHEN k = n - 1 THEN z ELSE a + (k + 1) * ((z - a) / n) END AS "end" FROM pa),
nu AS (SELECT *, row_number() OVER w AS i, lead("start") OVER w AS ns, lead("end") OVER w AS ne, count(*) OVER (PARTITION BY user_id) AS c FROM sh WINDOW w AS (PARTITION BY user_id ORDER BY "start"))
SELECT user_id, i::INT AS shot_id, round("start", 6) + 0.0 AS "start", round(CASE WHEN i = c - 1 AND ne - ns < 1 THEN ne ELSE "end" END, 6) + 0.0 AS "end" FROM nu WHERE NOT (c > 1 AND i = c AND "end" - "start" < 1)""",
        "path_summary": b("""SELECT shot_id, source_id, min(q_idx) AS q_start, max(q_idx) AS q_end, min(s_idx) AS s_start, max(s_idx) AS s_end, count(*) AS n, avg(sim) AS visual,
            least(1, count(DISTINCT q_idx)::DOUBLE / (max(q_idx) - min(q_idx) + 1)) AS coverage, CASE WHEN max(q_idx) = min(q_idx) THEN 1 ELSE regr_slope(s_idx, q_idx) END AS slope,
            CASE WHEN max(q_idx) = min(q_idx) THEN avg(s_idx) - avg(q_idx) ELSE regr_intercept(s_idx, q_idx) END AS intercept,
            CASE WHEN count(*) < 2 THEN 1 WHEN max(q_idx) = min(q_idx) THEN 0 WHEN regr_syy(s_idx, q_idx) <= 1e-9 THEN 1 ELSE greatest(0, least(1, regr_r2(s_idx, q_idx))) END AS linearity FROM an GROUP BY ALL""", "visual coverage slope intercept linearity", "shot_id source_id q_start q_end s_start s_end n"),
        "score_normalise": BASE + """,
pool AS (SELECT cand, other, local_index FROM (SELECT c.source_id AS cand, i.source_id AS other, i.local_index, row_number() OVER (PARTITION BY c.source_id ORDER BY md5(i.source_id || ':' || i.local_index), i.source_id, i.local_index) AS k
    FROM (SELECT DISTINCT source_id FROM rk) c JOIN ix i ON i.source_id <> c.source_id) WHERE k <= 256),
bi AS (SELECT shot_id, cand AS source_id, q_idx, avg(sim) AS bias FROM (SELECT rk.shot_id, cand, q_idx, sim, row_number() OVER (PARTITION BY rk.shot_id, cand, q_idx ORDER BY sim DESC) AS r
    FROM rk JOIN pool ON cand = rk.source_id JOIN sim o ON o.shot_id = rk.shot_id AND o.source_id = other AND o.s_idx = pool.local_index) WHERE r <= 10 GROUP BY ALL)
""" + _rounded("SELECT shot_id, source_id, q_idx, max(sim) - 0.5::DOUBLE * any_value(bias) AS best FROM sim JOIN rk USING (shot_id, source_id) JOIN bi USING (shot_id, source_id, q_idx) GROUP BY ALL", "best", "shot_id source_id q_idx"),
        "best_second_margin": b("SELECT a.shot_id, a.source_id, a.score, a.score - greatest(coalesce(b.score, 0), 0) AS margin, 1 + coalesce(a.score - b.score < 0.12, FALSE)::INT AS n_refine FROM rk a LEFT JOIN rk b ON b.shot_id = a.shot_id AND b.rank = 2 WHERE a.rank = 1", "score margin", "shot_id source_id n_refine"),
        "confidence_status": _CONF + " SELECT l_orderkey, l_linenumber, confidence, CASE WHEN margin < 0.04 AND confidence < 0.8 THEN 'UNKNOWN' WHEN confidence >= 0.8 THEN 'HIGH' WHEN confidence >= 0.65 THEN 'MEDIUM' WHEN confidence >= 0.5 THEN 'LOW' ELSE 'UNKNOWN' END AS status FROM z",
        "shot_score_stats": _STAT + _rounded("SELECT * FROM st", "med mad threshold", "user_id"),
        "shot_local_maxima": _STAT + _rounded("SELECT * FROM (SELECT *, lag(score) OVER w AS b, lead(score) OVER w AS a FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) JOIN st USING (user_id) WHERE score >= threshold AND score >= 2.5::DOUBLE * med AND coalesce(b, -1e300) <= score AND coalesce(a, -1e300) <= score", "score", "user_id event_id"),
        "greedy_min_gap": "WITH RECURSIVE g AS (SELECT user_id, min(event_id)::DOUBLE AS t FROM events WHERE event_id >= 400 GROUP BY user_id UNION ALL SELECT g.user_id, (SELECT min(event_id)::DOUBLE FROM events e WHERE e.user_id = g.user_id AND e.event_id - g.t >= 400) AS t FROM g WHERE g.t IS NOT NULL) SELECT user_id, t FROM g WHERE t IS NOT NULL",
        "fixed_shots": "SELECT p_partkey, unnest(list_transform(range(1, greatest(1, ceil(p_size / 3.0::DOUBLE)::INT)), lambda k: k * 3.0::DOUBLE)) AS cut FROM part",
        "histogram_features": _PIX + _rounded("SELECT vec_id, (b - 1)::INT AS bin, hist[b] AS share FROM hi, (SELECT unnest(range(1, 33)) AS b) WHERE hist[b] > 0", "share", "vec_id bin"),
        "change_scores": _PIX + _rounded("""SELECT label, vec_id, CASE WHEN h IS NULL THEN 0 ELSE 0.5::DOUBLE * (1 - list_sum(list_transform(range(1, 33), lambda k: least(hist[k], h[k])))) + 0.5::DOUBLE * least(3 * (list_sum(list_transform(range(1, len(pixels) + 1), lambda k: abs(pixels[k] - p[k])))::DOUBLE / len(pixels) / 255), 1) END AS score
            FROM (SELECT *, lag(hist) OVER w AS h, lag(pixels) OVER w AS p FROM hi WINDOW w AS (PARTITION BY label ORDER BY vec_id))""", "score", "label vec_id"),
        "merge_segments": "WITH RECURSIVE " + _LINES + """,
f AS (SELECT query_id, i, 1 AS id, query_start, query_end, source, source_start, source_end, confidence, status, speed FROM seg WHERE i = 1
    UNION ALL SELECT query_id, i, CASE WHEN j THEN id ELSE id + 1 END, CASE WHEN j THEN query_start ELSE q0 END, q1, CASE WHEN j THEN source ELSE src END, CASE WHEN j THEN source_start ELSE s0 END, s1,
        CASE WHEN j THEN (confidence * (q1 - query_start) + cf * (q1 - q0)) / ((q1 - query_start) + (q1 - q0)) ELSE cf END, CASE WHEN j THEN status ELSE st END, CASE WHEN j THEN speed ELSE sp END
    FROM (SELECT f.* EXCLUDE (i), s.i, s.query_start AS q0, s.query_end AS q1, s.source AS src, s.source_start AS s0, s.source_end AS s1, s.confidence AS cf, s.status AS st, s.speed AS sp,
        coalesce(f.source = s.source AND f.status <> 'UNKNOWN' AND s.status <> 'UNKNOWN' AND abs(s.query_start - f.query_end) <= 0.35 AND abs(s.source_start - (f.source_end + (s.query_start - f.query_end) * f.speed)) <= 0.6 AND abs(s.speed - f.speed) < 0.12, FALSE) AS j
        FROM f JOIN seg s ON s.query_id = f.query_id AND s.i = f.i + 1))
""" + _rounded("SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY i DESC) = 1", "query_start query_end source_start source_end confidence speed", "query_id id source status"),
        "merge_fixture": "SELECT * FROM (VALUES (1, 1, 0.0::DOUBLE, 6.0::DOUBLE, 'a', 10.0::DOUBLE, 16.0::DOUBLE, round((((0.9 * 4 + 0.7 * 2) / 6) * 6 + 0.6 * 2) / 8, 6)::DOUBLE, 'HIGH', 1.0::DOUBLE), (2, 1, 0.0, 2.0, 'a', 10.0, 12.0, 0.9, 'HIGH', 1.0), (2, 2, 2.0, 4.0, 'a', 40.0, 42.0, 0.8, 'HIGH', 1.0), (3, 1, 0.0, 2.0, 'a', 10.0, 12.0, 0.9, 'HIGH', 1.0), (3, 2, 2.0, 4.0, 'b', 12.0, 14.0, 0.8, 'HIGH', 1.0), (4, 1, 0.0, 2.0, 'a', 10.0, 12.0, 0.9, 'HIGH', 1.0), (4, 2, 2.0, 4.0, NULL, NULL, NULL, 0.2, 'UNKNOWN', 1.0), (5, 1, 0.0, 4.3, 'a', 10.0, 14.2, round((0.9 * 4.3 + 0.5 * 2) / 6.3, 6), 'HIGH', 1.0), (5, 2, 4.3, 6.0, 'a', 14.2, 16.5, 0.5, 'LOW', 1.25)) t(query_id, id, query_start, query_end, source, source_start, source_end, confidence, status, speed)",
        "report_rows": "WITH " + _LINES + f""" SELECT query_id, printf('%.3f', query_start) AS query_start, printf('%.3f', query_end) AS query_end, coalesce(source, '') AS source, coalesce(printf('%.3f', source_start), '') AS source_start, coalesce(printf('%.3f', source_end), '') AS source_end,
            printf('%.4f', confidence) AS confidence, status, printf('%.4f', speed) AS speed, CASE WHEN source IS NULL THEN '' ELSE lpad(query_id::VARCHAR, greatest(3, len(query_id::VARCHAR))::INT, '0') || '_' || source || '_' || {_label("source_start")} || '_' || {_label("source_end")} || '.mp4' END AS clip FROM seg""",
        "status_summary": "WITH " + _LINES + _rounded("SELECT query_id, count(*) AS n, count(*) FILTER (WHERE status = 'HIGH') AS high, count(*) FILTER (WHERE status = 'MEDIUM') AS medium, count(*) FILTER (WHERE status = 'LOW') AS low, count(*) FILTER (WHERE status = 'UNKNOWN') AS unknown, round(coalesce(sum(query_end - query_start) FILTER (WHERE status <> 'UNKNOWN'), 0) / 20.0::DOUBLE, 4) AS matched_ratio FROM seg GROUP BY query_id", "matched_ratio", "query_id n high medium low unknown"),
        "eval_fixture": _EVAL + _rounded("SELECT * FROM det", "iou iou_2d start_error end_error aligned_error", "id source pred_id pred_source unknown_expected status source_correct segment_correct unknown_correct"),
        "eval_matching": _PART + _rounded("SELECT * FROM det", "iou iou_2d start_error end_error aligned_error", "id source pred_id pred_source unknown_expected status source_correct segment_correct unknown_correct"),
        "eval_summary": _PART + _rounded("""SELECT count(*) FILTER (WHERE NOT unknown_expected) AS n_truth, (SELECT count(*) FROM p) AS n_pred, coalesce(median(end_error), -1) AS median_end_error, coalesce(median(iou_2d), -1) AS median_iou_2d, avg(source_correct::INT::DOUBLE) FILTER (WHERE NOT unknown_expected) AS source_recall, avg(segment_correct::INT::DOUBLE) FILTER (WHERE NOT unknown_expected) AS segment_recall, coalesce(avg(start_error), -1) AS start_error, coalesce(avg(end_error), -1) AS end_error,
            coalesce(median(start_error), -1) AS median_start_error, coalesce(avg(aligned_error), -1) AS aligned_error, coalesce(avg(iou), -1) AS mean_iou, coalesce(median(iou), -1) AS median_iou, coalesce(avg(unknown_correct::INT::DOUBLE) FILTER (WHERE unknown_expected), 1) AS unknown_accuracy,
            (SELECT count(*) FROM fp) AS n_false, (SELECT count(*) FROM p WHERE source IS NOT NULL AND status <> 'UNKNOWN') AS n_named, (SELECT count(*) FROM fp)::DOUBLE / (SELECT count(*) FROM p WHERE source IS NOT NULL AND status <> 'UNKNOWN') AS false_positive_rate FROM det""", "source_recall segment_recall start_error end_error median_start_error aligned_error mean_iou median_iou unknown_accuracy false_positive_rate median_end_error median_iou_2d", "n_truth n_pred n_false n_named"),
        "false_positives": _PART + " SELECT * FROM fp",
        "view_means": _rounded("""SELECT vec_id, m[1] / sqrt(list_dot_product(m, m)) AS first, m[2] / sqrt(list_dot_product(m, m)) AS second, list_sum(list_transform(range(1, len(m) + 1), lambda k: m[k] * k)) / sqrt(list_dot_product(m, m)) AS weighed FROM (SELECT vec_id, list_transform(range(1, len(e) + 1), lambda k: (e[k] + e[len(e) + 1 - k]) / 2) AS m FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))""", "first second weighed", "vec_id"),
        "rescan_sources": BASE + "SELECT source_id, max(ts) AS duration FROM ix GROUP BY source_id HAVING max(ts) <= 48",
        "edit_support": _PART + ", nt AS (SELECT id, note AS nt FROM g) " + _rounded("SELECT nt[1:1] AS kind, count(*) FILTER (WHERE source_correct) AS n_correct, count(*) AS n, avg(start_error) AS start_error FROM det JOIN nt USING (id) WHERE regexp_matches(nt, '^[A-Z] ') GROUP BY 1", "start_error", "kind n_correct n"),
        "failures": _PART + " SELECT DISTINCT id, status FROM det WHERE NOT source_correct AND NOT unknown_expected ORDER BY id, status LIMIT 20",
        "bench_rollup": _RUN + _rounded("SELECT * FROM ru", "source_recall segment_recall start_error total_s peak_mb", "config n_runs"),
        "bench_runs": _RUN + _rounded("""SELECT * FROM runs WHERE ok AND "case" = 'F'""", "source_recall segment_recall start_error total_s peak_mb", 'config "case" ok'),
        "bench_grid": """SELECT r_name AS config, n_name AS "case", n_nationkey FROM region, nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)""",
        "probe_rows": _rounded("""SELECT p_partkey, fps, 25.0::DOUBLE AS nominal_fps, duration, round(duration * fps)::BIGINT AS frame_count, CASE WHEN turned THEN 1080 ELSE 1920 END AS width, CASE WHEN turned THEN 1920 ELSE 1080 END AS height, FALSE AS has_audio, abs(fps - 25) / 25 > 0.02 AS is_vfr,
            CASE WHEN duration IS NULL THEN 'no duration' END AS error, CASE WHEN turned THEN 'portrait' ELSE 'landscape' END AS orientation
            FROM (SELECT p_partkey, p_size / 2::DOUBLE AS fps, CASE WHEN p_size % 3 > 0 THEN p_size * 0.5::DOUBLE WHEN p_size % 5 > 0 THEN p_size * 1.5::DOUBLE END AS duration, p_size % 4 = 1 AS turned FROM part)""", "fps nominal_fps duration", "p_partkey frame_count width height has_audio is_vfr error orientation"),
        "plausible_times": _rounded("""SELECT source_id, local_index, pts, CASE WHEN good THEN pts ELSE (n - 1) / 4::DOUBLE END AS ts, CASE WHEN good THEN 'pts' ELSE 'estimated' END AS time_source
            FROM (SELECT *, bool_and(up) OVER (PARTITION BY source_id) AND min(pts) OVER (PARTITION BY source_id) BETWEEN -1 AND 2 AS good FROM (SELECT *, coalesce(lag(pts) OVER w < pts, TRUE) AS up, row_number() OVER w AS n
            FROM (SELECT l_orderkey AS source_id, l_linenumber AS local_index, min(l_quantity / 32::DOUBLE) AS pts FROM lineitem GROUP BY ALL) WINDOW w AS (PARTITION BY source_id ORDER BY local_index)))""", "pts ts", "source_id local_index time_source"),
        "interval_frames": BASE + _rounded("SELECT source_id, min(local_index) AS local_index, min(ts) AS ts FROM ix WHERE ts BETWEEN 3 - 1e-9 AND 20 + 1e-9 GROUP BY source_id, floor(ts * 0.5)", "ts", "source_id local_index"),
        "feature_cache": "SELECT label, count(*) AS n FROM embeddings GROUP BY label",
        "ground_truth_rows": _rounded("SELECT n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) END::INT AS id, n_nationkey * 4::DOUBLE AS query_start, n_nationkey * 4::DOUBLE + 4 AS query_end, n_name AS source, n_nationkey::DOUBLE AS source_start, n_nationkey::DOUBLE + 4 AS source_end, CASE WHEN n_nationkey % 3 = 0 THEN 1.25 ELSE 1 END::DOUBLE AS speed, CASE WHEN n_nationkey % 5 = 0 THEN 'note' ELSE '' END AS note FROM nation", "query_start query_end source_start source_end speed", "n_regionkey id source note"),
        "prediction_rows": _rounded("SELECT n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE 0 END::INT AS id, n_nationkey * 4::DOUBLE AS query_start, n_nationkey * 4::DOUBLE + 4 AS query_end, n_name AS source, n_nationkey::DOUBLE AS source_start, n_nationkey::DOUBLE + 4 AS source_end, CASE WHEN n_nationkey % 4 = 0 THEN 0.5 ELSE 0 END::DOUBLE AS confidence, CASE WHEN n_nationkey % 4 = 0 THEN 'LOW' ELSE 'UNKNOWN' END AS status, CASE WHEN n_nationkey % 3 = 0 THEN 1.25 ELSE 1 END::DOUBLE AS speed FROM nation", "query_start query_end source_start source_end confidence speed", "n_regionkey id source status"),
        "pts_times": _rounded("SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1)::INT AS i, l_quantity / 4::DOUBLE AS pts_time FROM lineitem", "pts_time", "l_orderkey i"),
        "source_lookup": "SELECT source_id, name FROM (SELECT p_partkey AS source_id, p_brand AS name FROM part WHERE p_brand = 'Brand#1' ORDER BY p_partkey LIMIT 1) UNION ALL SELECT p_partkey, p_brand FROM part WHERE p_partkey = 17",
        "content_fingerprint": "SELECT doc_id, sha256(octet_length(encode(coalesce(text, '')))::VARCHAR || coalesce(text, '')) AS fingerprint FROM documents",
        "first_candidates": BASE + "SELECT shot_id, source_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY shot_id ORDER BY rank) AS n FROM rk) WHERE n <= 3",
        "top_candidates": BASE + """SELECT shot_id, '[' || string_agg('{"rank":' || rank || ',"source_id":' || source_id || ',"score":' || round(score, 4) || '}', ',' ORDER BY rank) || ']' AS candidates FROM (SELECT *, row_number() OVER (PARTITION BY shot_id ORDER BY rank) AS n FROM rk) WHERE n <= 5 GROUP BY shot_id""",
        "clip_manifest": "WITH " + _LINES + f""" SELECT query_id AS id, lpad(query_id::VARCHAR, greatest(3, len(query_id::VARCHAR))::INT, '0') || '_' || source || '_' || {_label("source_start")} || '_' || {_label("source_end")} || '.mp4' AS name, source, round(source_start, 6) + 0.0 AS source_start, round(source_end, 6) + 0.0 AS source_end, source_end - source_start > 1e-3 AS ok FROM seg WHERE source IS NOT NULL AND status <> 'UNKNOWN'""",
        "sample_times": _PART + _rounded("SELECT id, i::INT AS i, source_start + i * (source_end - 1e-3::DOUBLE - source_start) / 4 AS ts FROM g, range(0, 5) r(i)", "ts", "id i"),
        "concat_manifest": _rounded("""SELECT l_orderkey, l_linenumber, length, coalesce(sum(length) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cursor, bool_and(sound) OVER (PARTITION BY l_orderkey) AS audio
            FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS length, bool_or(l_tax > 0.005) AS sound FROM lineitem GROUP BY ALL)""", "length cursor", "l_orderkey l_linenumber audio"),
        "stage_times": _rounded("SELECT event_type, sum(value) AS seconds, count(*) AS n FROM events GROUP BY event_type", "seconds", "event_type n"),
        "bench_best": _RUN + " SELECT (SELECT config FROM ru ORDER BY segment_recall DESC, source_recall DESC, coalesce(start_error, 99) LIMIT 1) AS best, (SELECT config FROM ru ORDER BY total_s, config LIMIT 1) AS fastest, (SELECT config FROM ru ORDER BY peak_mb, config LIMIT 1) AS leanest",
        "running_cursor": _rounded("SELECT l_orderkey, l_linenumber, coalesce(sum(sum(l_quantity)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cursor FROM lineitem GROUP BY l_orderkey, l_linenumber", "cursor", "l_orderkey l_linenumber"),
        "scalar_functions": _rounded(f"""SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN 0 ELSE c_custkey::DOUBLE / c_nationkey END AS rate, CASE WHEN 12 > c_nationkey THEN 'portrait' WHEN 12 < c_nationkey THEN 'landscape' ELSE 'square' END AS orientation, greatest(0, least(5000, c_acctbal)) AS clipped,
            {_label("floor(abs(c_acctbal) / 10)")} AS label, greatest(0, least(c_nationkey, 15) - 5)::DOUBLE / (c_nationkey + 10 - greatest(0, least(c_nationkey, 15) - 5)) AS iou, c_nationkey / 25.0::DOUBLE * 0.75::DOUBLE AS composite, CASE WHEN c_nationkey < 7 THEN '-' ELSE printf('%.3f', c_nationkey / 7.0::DOUBLE - 1) END AS shown FROM customer""", "rate clipped iou composite", "c_custkey orientation label shown"),
        "vector_functions": _rounded("SELECT vec_id, pow(list_sum(list_transform(embedding::DOUBLE[], lambda x: pow(greatest(x, 1e-6), 4))) / len(embedding), 0.25) AS gem, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS square, embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS first, list_sum(list_transform(range(1, len(embedding) + 1), lambda k: embedding[k]::DOUBLE * k)) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS weighed FROM embeddings", "gem square first weighed", "vec_id"),
        "space_guard": """SELECT dim, 'l2' AS normalization, count(*) AS n, substr(sha256('{"dim":' || dim || ',"normalization":"l2"}'), 1, 16) AS params FROM (SELECT len(embedding)::INT AS dim FROM embeddings) GROUP BY dim""",
    }
