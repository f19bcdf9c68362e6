"""Merging of neighbouring segments: an ordered fold with carried state, as a higher-order aggregate on each query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MergeConfig

SEGMENT = "struct<query_start:double,query_end:double,source:string,source_start:double,source_end:double,confidence:double,status:string,speed:double,scores:map<string,double>>"


def merge_segments(segments: DataFrame, query: str = "query_id", cfg: MergeConfig = MergeConfig()) -> DataFrame:
    """Segments of each query in time order, joined where source, time lines and speed carry on. Numbered from 1.

    The weight of the part so far is the length of the joined segment, not of the part before joining.
    """
    names = [x.split(":")[0] for x in SEGMENT[7:-1].replace("map<string,double>", "map").split(",")]
    one = F.struct(*[F.col(n) for n in names]).cast(SEGMENT)
    rows = segments.groupBy(query).agg(F.sort_array(F.collect_list(one.dropFields("scores").withField("scores_json", F.to_json("scores")))).alias("s"))
    items = F.transform("s", lambda x: F.struct(*[x[n].alias(n) for n in names[:-1]], F.from_json(x["scores_json"], "map<string,double>").alias("scores")))

    def step(acc: Column, seg: Column) -> Column:
        prev = F.element_at(acc, -1)
        follows = (
            prev["source"].isNotNull() & (seg["source"] == prev["source"]) & (prev["status"] != "UNKNOWN") & (seg["status"] != "UNKNOWN")
            & (F.abs(seg["query_start"] - prev["query_end"]) <= cfg.query_gap)
            & (F.abs(seg["source_start"] - (prev["source_end"] + (seg["query_start"] - prev["query_end"]) * prev["speed"])) <= cfg.source_gap)
            & (F.abs(seg["speed"] - prev["speed"]) < cfg.speed_gap)
        )
        w1, w2 = seg["query_end"] - prev["query_start"], seg["query_end"] - seg["query_start"]
        mean = lambda a, b: F.when(w1 + w2 > 0, (a * w1 + b * w2) / (w1 + w2)).otherwise(a)
        empty = F.create_map().cast("map<string,double>")
        scores = F.map_zip_with(F.coalesce(prev["scores"], empty), F.coalesce(seg["scores"], empty), lambda _, a, b: mean(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))))
        joined = F.struct(prev["query_start"].alias("query_start"), seg["query_end"].alias("query_end"), prev["source"].alias("source"), prev["source_start"].alias("source_start"), seg["source_end"].alias("source_end"), mean(prev["confidence"], seg["confidence"]).alias("confidence"), prev["status"].alias("status"), prev["speed"].alias("speed"), scores.alias("scores")).cast(SEGMENT)
        rest = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when((F.size(acc) > 0) & F.coalesce(follows, F.lit(False)), F.concat(rest, F.array(joined))).otherwise(F.concat(acc, F.array(seg.cast(SEGMENT))))

    first = F.filter(F.array(F.lit(None).cast(SEGMENT)), lambda x: x.isNotNull())
    # an element past the end is null, not an error: the fold starts on an empty array
    safe = lambda acc, seg: F.when(F.size(acc) == 0, F.array(seg.cast(SEGMENT))).otherwise(step(acc, seg))
    folded = rows.select(query, F.posexplode(F.aggregate(items, first, safe)).alias("i", "x"))
    return folded.select(query, (F.col("i") + 1).alias("id"), "x.*")
