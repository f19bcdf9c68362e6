"""The whole trace against the same steps one shot after another, on frames at eight a second; errors, crops and the shot detector."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewake import catalogue
from framewake.config import RefineConfig, ShotConfig, TraceConfig
from framewake.functions import scalars as fs
from framewake.operators import align, evaluate, features, report, resolve, retrieval, shots
from framewake.sources import media

RATE, SF = 8, "/root/testdata/sf0.001"


def smooth(rng, n, dim=24):
    """A series of unit vectors that change slowly."""
    steps = rng.normal(size=(n // 4 + 3, dim))
    at = np.arange(n) / 4
    mixed = steps[at.astype(int)] * (1 - at % 1)[:, None] + steps[at.astype(int) + 1] * (at % 1)[:, None]
    return mixed / np.linalg.norm(mixed, axis=1, keepdims=True)


class World:
    def __init__(self):
        rng = np.random.default_rng(11)
        self.sources = {k: smooth(rng, 30 * RATE) for k in (1, 2, 4, 5)}
        near = self.sources[2] + 0.12 * rng.normal(size=self.sources[2].shape)
        self.sources[3] = near / np.linalg.norm(near, axis=1, keepdims=True)
        #: shot: source, first second, speed, seconds, noise
        plan = {1: (1, 3.0, 1.0, 5.0, 0.0), 2: (2, 8.0, 1.0, 4.0, 0.05), 3: (None, 0, 1, 4.0, 0), 4: (4, 10.0, 1.0, 1.0, 0.1), 5: (5, 6.0, 1.5, 6.0, 0.15), 6: (1, 20.0, 1.0, 4.0, 0.3), 7: (4, 2.25, 1.25, 3.0, 0.22), 8: (2, 15.0, 1.0, 3.0, 0.25)}
        self.shots, self.frames, at = {}, {}, 0.0
        for shot, (source, first, speed, seconds, noise) in plan.items():
            t = np.arange(int(seconds * RATE)) / RATE
            v = smooth(rng, len(t)) if source is None else self.sources[source][np.rint((first + speed * t) * RATE).astype(int)]
            v = v + noise * rng.normal(size=v.shape)
            self.frames[shot] = (at + t, v / np.linalg.norm(v, axis=1, keepdims=True))
            self.shots[shot] = (at, at + seconds - 1 / RATE)
            at += seconds

    def tables(self, spark):
        q = [(k, i, float(t), v.tolist()) for k, (ts, vs) in self.frames.items() for i, (t, v) in enumerate(zip(ts, vs, strict=True))]
        ix = [(k, i, i / RATE, v.tolist()) for k, vs in self.sources.items() for i, v in enumerate(vs)]
        return (
            spark.createDataFrame(q, "shot_id int, q_idx int, q_ts double, descriptor array<double>"),
            spark.createDataFrame(ix, "source_id int, local_index int, ts double, descriptor array<double>"),
            spark.createDataFrame([(k, a, b) for k, (a, b) in self.shots.items()], "shot_id int, start double, end double"),
        )


def sampled(ts, fps):
    seen, keep = set(), []
    for i, t in enumerate(ts):
        if (b := math.floor(t * fps + 1e-9)) not in seen:
            seen.add(b)
            keep.append(i)
    return np.array(keep)


class Plain:
    """The steps of the trace as loops over shots, candidates and levels."""

    def __init__(self, world, ranked, cfg):
        self.w, self.ranked, self.cfg = world, ranked, cfg

    def item(self, shot, source, fps, window=None, index=None):
        q_ts, q = self.w.frames[shot]
        s = (index or self.w.sources)[source]
        s_ts = np.arange(len(s)) / RATE
        duration, keep = s_ts[-1], sampled(s_ts, fps)
        if window:
            lo, hi = max(0.0, window[0] - 1.5), min(duration, window[1] + 1.5)
            if hi - lo < 0.05:
                return None
            keep = keep[(s_ts[keep] >= lo - 1e-9) & (s_ts[keep] <= hi + 1e-9)]
        of_q = sampled(q_ts, fps)
        sim = q[of_q] @ s[keep].T
        paths = align.align_matrix(sim, self.cfg.align)
        if not paths:
            return None
        a, b = paths[0].T
        slope, offset, r2, rmse, _ = align.robust_fit(q_ts[of_q][a], s_ts[keep][b], self.cfg.align)
        ends = sorted(slope * t + offset for t in self.w.shots[shot])
        visual, coverage = float(sim[a, b].mean()), min(1.0, len(set(a.tolist())) / (a.max() - a.min() + 1))
        start, end = (min(max(x, 0.0), duration) for x in ends)
        return {"source": source, "start": start, "end": end, "visual": visual, "coverage": coverage, "slope": slope, "r2": r2, "rmse": rmse, "score": visual * (0.5 + 0.5 * coverage)}

    def grade(self, it, margin, shot):
        clip = lambda x, lo=0.0, hi=1.0: min(max(x, lo), hi)
        a, b = self.w.shots[shot]
        fit = clip(0.5 * it["r2"] + 0.5 * math.exp(-it["rmse"] / 0.5))
        raw = 0.45 * clip(it["visual"]) + 0.25 * clip(it["coverage"]) + 0.15 * clip(margin / 0.16) + 0.15 * fit
        return clip(raw * (0.85 + 0.15 * clip((b - a) / 3, 0.4, 1.0)))

    def status(self, conf, margin):
        if margin < 0.04 and conf < 0.8:
            return "UNKNOWN"
        return next((name for least, name in ((0.8, "HIGH"), (0.65, "MEDIUM"), (0.5, "LOW")) if conf >= least), "UNKNOWN")

    def segment(self, shot, crops=None):
        sources = self.ranked[shot]
        found = [x for s in sources if (x := self.item(shot, s, 1.0))]
        for fps in (2.0, 4.0):
            if max((x["score"] for x in found), default=0.0) >= 0.8:
                break
            found += [x for s in sources if (x := self.item(shot, s, fps))]
        best = {}
        for x in found:
            if x["source"] not in best or x["score"] > best[x["source"]]["score"]:
                best[x["source"]] = x
        if not best:
            return None, 0.0, 0.0, "UNKNOWN"
        order = sorted(best.values(), key=lambda x: (-x["score"], sources.index(x["source"])))
        chosen = order[: 2 if len(order) > 1 and order[0]["score"] - order[1]["score"] < 0.12 else 1]
        refined = [self.item(shot, x["source"], 4.0, (x["start"], x["end"])) or x for x in chosen]
        refined.sort(key=lambda x: -x["score"])
        top = refined[0]
        others = [x["score"] for x in [*refined[1:], *order] if x["source"] != top["source"]]
        margin = top["score"] - max(others, default=0.0)
        conf = self.grade(top, margin, shot)
        if conf < 0.85 and (hard := self.item(shot, top["source"], 8.0, (top["start"], top["end"]))) and self.grade(hard, margin, shot) > conf:
            top, conf = hard, self.grade(hard, margin, shot)
        if crops and self.status(conf, margin) == "UNKNOWN":
            tried = [x for index in crops for s in sources[:3] if (x := self.item(shot, s, 4.0, index=index))]
            if tried:
                tried.sort(key=lambda x: -x["score"])
                rest = max((x["score"] for x in tried[1:] if x["source"] != tried[0]["source"]), default=0.0)
                if (c := self.grade(tried[0], tried[0]["score"] - rest, shot)) > conf:
                    top, margin, conf = tried[0], tried[0]["score"] - rest, c
        status = "UNKNOWN" if top["end"] - top["start"] < 0.4 else self.status(conf, margin)
        return top, margin, conf, status


@pytest.fixture(scope="module")
def world():
    return World()


@pytest.fixture(scope="module")
def ranked(spark, world):
    q, ix, _ = world.tables(spark)
    cfg = TraceConfig()
    out = {}
    for r in resolve.retrieve(resolve.at_rate(q, 1.0, "shot_id", "q_ts", "q_idx"), resolve.at_rate(ix, 1.0, "source_id", "ts", "local_index"), cfg).orderBy("shot_id", "rank").collect():
        out.setdefault(r.shot_id, []).append(r.source_id)
    return out


def check(got, plain, shots_of, crops=None):
    statuses = set()
    for shot in shots_of:
        top, margin, conf, status = plain.segment(shot, crops)
        r = got[shot]
        assert (r.status, r.confidence) == (status, pytest.approx(conf)), shot
        statuses.add(status)
        if top:
            assert r.scores["margin"] == pytest.approx(margin) and r.scores["visual"] == pytest.approx(top["visual"])
        if status != "UNKNOWN":
            assert (r.source, r.source_start, r.source_end, r.speed) == (str(top["source"]), pytest.approx(top["start"]), pytest.approx(top["end"]), pytest.approx(top["slope"])), shot
        else:
            assert r.source is None and r.source_start is None and r.speed == 1.0
    return statuses


def test_the_trace_equals_its_steps_shot_by_shot(spark, world, ranked):
    cfg = TraceConfig()
    got = {r.shot_id: r for r in resolve.resolve(*world.tables(spark), cfg).collect()}
    assert len(check(got, Plain(world, ranked, cfg), world.shots)) >= 2
    assert got[1].source == "1" and got[1].source_start == pytest.approx(3.0, abs=0.3) and got[5].speed == pytest.approx(1.5, abs=0.1)
    whole = resolve.trace(*world.tables(spark), cfg).orderBy("id").collect()
    assert [r.id for r in whole] == list(range(1, len(whole) + 1)) and whole[0].query_start == 0.0 and whole[-1].query_end == max(b for _, b in world.shots.values())


def test_crops_are_tried_for_what_stays_unknown(spark, world, ranked):
    cfg = TraceConfig()
    plain = Plain(world, ranked, cfg)
    open_ = [k for k in world.shots if plain.segment(k)[3] == "UNKNOWN"]
    assert open_
    # a crop of a source in which the shot can be seen as it is
    crops = [dict(world.sources), dict(world.sources)]
    for shot in open_:
        source = ranked[shot][0]
        made = world.sources[source].copy()
        v = world.frames[shot][1]
        made[40 : 40 + len(v)] = v
        crops[1][source] = made
    rows = [(k, i, i / RATE, v.tolist(), ratio) for ratio, index in zip((0.9, 0.8), crops, strict=True) for k, vs in index.items() for i, v in enumerate(vs)]
    cropped = spark.createDataFrame(rows, "source_id int, local_index int, ts double, descriptor array<double>, crop double")
    got = {r.shot_id: r for r in resolve.resolve(*world.tables(spark), cfg, cropped).collect()}
    check(got, plain, world.shots, crops)
    assert any(got[k].status != "UNKNOWN" for k in open_)


def test_refinement_can_be_off_and_normalised(spark, world, ranked):
    q, ix, s = world.tables(spark)
    plain = resolve.resolve(q, ix, s, TraceConfig(refine=RefineConfig(enabled=False))).collect()
    once = {r.shot_id: r for r in resolve.trace_once(resolve.at_rate(q, 1.0, "shot_id", "q_ts", "q_idx"), resolve.at_rate(ix, 1.0, "source_id", "ts", "local_index"), s).collect()}
    assert all((r.status, r.confidence, r.source) == (once[r.shot_id].status, pytest.approx(once[r.shot_id].confidence), once[r.shot_id].source) for r in plain)
    normal = {r.shot_id: r for r in resolve.resolve(q, ix, s, TraceConfig(refine=RefineConfig(normalise=True))).collect()}
    assert normal[1].source == "1" and normal[1].scores["visual"] > 0.95


def test_a_broken_shot_is_unknown_and_harms_no_other(spark, world):
    q, ix, s = world.tables(spark)
    few = q.where("shot_id in (1, 2)")
    broken = few.unionByName(q.where("shot_id = 5").withColumn("descriptor", F.when(F.col("q_idx") == 3, F.transform("descriptor", lambda x: F.lit(float("nan")))).otherwise(F.col("descriptor"))))
    shots_ = s.where("shot_id in (1, 2, 5)")
    got = {r.shot_id: r for r in resolve.resolve(broken, ix, shots_).collect()}
    assert got[1].source == "1" and got[1].status == "HIGH" and (got[5].status, got[5].confidence, got[5].source) == ("UNKNOWN", 0.0, None)
    assert [r.shot_id for r in features.index_or_errors(broken, "shot_id")[1].collect()] == [5]


def test_an_index_without_frames_is_an_error(spark, world):
    q, ix, s = world.tables(spark)
    with pytest.raises(ValueError, match="no source"):
        resolve.resolve(q, ix.where("false"), s)


def test_a_bad_source_takes_no_other_with_it(spark):
    rng = np.random.default_rng(2)
    pixels = lambda: bytearray(rng.integers(0, 256, (8, 8, 3), dtype=np.uint8).tobytes())
    rows = [(s, i, 8, 8, pixels()) for s in (1, 2, 3) for i in range(3)] + [(4, 0, 8, 8, None), (4, 1, 8, 8, pixels()), (5, 0, 8, 8, bytearray(b"short"))]
    frames = spark.createDataFrame(rows, "source_id int, frame_idx int, height int, width int, pixels binary")
    encoded = features.encode(frames, keys=("source_id", "frame_idx"))
    index, errors = features.index_or_errors(encoded)
    assert {r.source_id for r in index.collect()} == {1, 2, 3} and {r.source_id for r in errors.collect()} == {4, 5} and "error" not in index.columns
    odd = spark.createDataFrame([(1, [1.0, float("nan")], None), (2, [1.0, 0.0], None), (3, [float("inf"), 0.0], None), (4, None, None)], "source_id int, descriptor array<double>, error string")
    index, errors = features.index_or_errors(odd)
    assert [r.source_id for r in index.collect()] == [2] and {r.error for r in errors.collect()} == {"descriptor is not finite"}


def test_crops_are_the_mean_of_the_area(spark):
    frame = np.arange(16 * 16 * 3).reshape(1, 16, 16, 3).astype(np.uint8)
    flat = np.full((1, 20, 30, 3), 77, np.uint8)
    assert np.array_equal(features.centre_crop(flat, 0.5), flat) and np.array_equal(features.centre_crop(frame, 1.0), frame)
    half = features.centre_crop(frame, 0.5)  # eight pixels on sixteen: each twice
    assert np.array_equal(half, np.repeat(np.repeat(frame[:, 4:12, 4:12], 2, 1), 2, 2))
    rows = [(1, 0, 16, 16, bytearray(frame.tobytes()))]
    views = features.cropped_views(spark.createDataFrame(rows, "media_id int, frame_idx int, height int, width int, pixels binary"), (1.0, 0.9, 0.5)).collect()
    assert sorted(r.crop for r in views) == [0.5, 0.9] and np.allclose(next(r for r in views if r.crop == 0.5).descriptor, features.colour_histogram(half)[0])


def test_the_detector_cuts_where_pictures_change(spark):
    levels = [10, 10, 10, 10, 200, 200, 200, 200, 200, 90, 90, 90, 90, 90, 90]
    rows = [(1, i / 2, [v] * 16) for i, v in enumerate(levels)] + [(2, 0.0, [5] * 16), (2, 0.5, [250] * 16)]
    frames = spark.createDataFrame(rows, "m int, ts double, pixels array<int>")
    durations = spark.createDataFrame([(1, 7.5), (2, 1.0), (3, 30.0)], "m int, duration double")
    got = {}
    for r in shots.detect_shots(frames, durations, "m", "ts", "pixels").orderBy("m", "shot_id").collect():
        got.setdefault(r.m, []).append((r.start, r.end))
    assert got == {1: [(0.0, 2.0), (2.0, 4.5), (4.5, 7.5)], 2: [(0.0, 1.0)], 3: [(0.0, 10.0), (10.0, 20.0), (20.0, 30.0)]}
    fixed = [(r.start, r.end) for r in shots.detect_shots(frames, durations, "m", "ts", "pixels", ShotConfig(method="fixed")).where("m = 1").orderBy("shot_id").collect()]
    assert fixed == [(0.0, 2.0), (2.0, 4.0), (4.0, 6.0), (6.0, 7.5)]
    with pytest.raises(ValueError, match="unknown"):
        shots.detect_shots(frames, durations, "m", "ts", "pixels", ShotConfig(method="x"))


def test_a_broken_cache_is_a_miss_and_a_failed_write_a_warning(spark, tmp_path):
    want = spark.createDataFrame([(1,), (2,)], "k int")
    build = lambda keys: keys.withColumn("v", F.col("k") * 2)
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_bytes(b"no parquet at all")
    with pytest.warns(UserWarning, match="can't be read"):
        assert sorted(r.v for r in media.cached(spark, str(tmp_path / "broken"), want, "k", build).collect()) == [2, 4]
    (tmp_path / "file").write_bytes(b"x")
    with pytest.warns(UserWarning, match="can't be written"):
        assert sorted(r.v for r in media.cached(spark, str(tmp_path / "file" / "below"), want, "k", build).collect()) == [2, 4]


def test_missing_predictions_on_hidden_sources_are_misses(spark):
    truth = spark.createDataFrame([(1, 0.0, 4.0, "_Hidden", 0.0, 4.0, 1.0, ""), (2, 4.0, 8.0, "_Hidden", 0.0, 4.0, 1.0, ""), (3, 8.0, 12.0, "a", 0.0, 4.0, 1.0, "")], "id int, query_start double, query_end double, source string, source_start double, source_end double, speed double, note string")
    said = spark.createDataFrame([(2, 4.0, 8.0, None, None, None, 0.1, "UNKNOWN", 1.0), (3, 8.0, 12.0, "a", 0.0, 4.0, 0.9, "HIGH", 1.0)], "id int, query_start double, query_end double, source string, source_start double, source_end double, confidence double, status string, speed double")
    detail = evaluate.details(truth, said)
    got = {r.id: r for r in detail.collect()}
    assert (got[1].status, got[1].unknown_expected, got[1].source_correct) == ("MISS", False, False) and got[2].unknown_expected and got[2].unknown_correct
    s = evaluate.summary(detail, said).first()
    assert (s.n_truth, s.n_pred, s.n_named, s.source_recall, s.unknown_accuracy, s.median_end_error, s.median_iou_2d) == (2, 2, 1, 0.5, 1.0, 0.0, 1.0)


def test_the_report_rounds_halves_to_the_even_number(spark):
    df = spark.createDataFrame([(0.53125,), (0.59375,), (-1.0,), (None,)], "x double")
    assert [r[0] for r in df.select(fs.shown(F.col("x"), 4)).collect()] == ["0.5312", "0.5938", "-", "-"]


def test_status_shares_are_of_the_whole_duration(spark):
    segments = catalogue._segments(spark)
    durations = segments.select("query_id").distinct().withColumn("duration", F.lit(8.0))
    got = {r.query_id: r.matched_ratio for r in report.status_summary(segments, "query_id", durations).collect()}
    assert got[1] == 0.75 and got[4] == 0.25


def test_candidates_and_margins(spark):
    rows = [(1, 1, 0.9, 1), (1, 2, 0.85, 2), (1, 3, 0.5, 3), (2, 4, 0.9, 1), (2, 5, 0.7, 2)]
    items = spark.createDataFrame(rows, "shot_id int, source_id int, composite double, place int")
    assert {(r.shot_id, r.source_id) for r in resolve.refine_choice(items).collect()} == {(1, 1), (1, 2), (2, 4)}
    assert {r.shot_id: round(r.margin, 6) for r in resolve.best_and_margin(items).collect()} == {1: 0.05, 2: 0.2}
    ranks = items.withColumn("rank", F.col("place") * 2)
    assert resolve.first_candidates(ranks, 2).count() == 4 and resolve.first_candidates(ranks, 0).count() == 2


def test_biased_frames_align_by_what_is_theirs(spark, world):
    q, ix, s = world.tables(spark)
    pairs = spark.createDataFrame([(1, 1), (1, 2)], "shot_id int, source_id int")
    bias = retrieval.frame_bias(q, ix, pairs, 3, 50)
    assert {(r.shot_id, r.source_id) for r in bias.collect()} == {(1, 1), (1, 2)}
    both = q.join(pairs, "shot_id").join(bias, ["shot_id", "source_id", "q_idx"])
    plain, less = ({(r.q_idx, r.s_idx): r.sim for r in align.align(x, ix, pairs.where("source_id = 1")).collect()} for x in (q, both))
    assert less and all(v == pytest.approx(plain[k]) for k, v in less.items() if k in plain)


def test_the_nearest_frame_of_an_empty_shot(spark):
    rng = np.random.default_rng(6)
    times = sorted({round(float(t), 3) for t in [*rng.uniform(0, 40, 12), *rng.uniform(300, 420, 9), 1000.0]})
    frames = spark.createDataFrame([(t,) for t in times], "q_ts double")
    spans = [(k, float(a), float(a) + 0.004) for k, a in enumerate([*rng.uniform(0, 1200, 150), 16.0, 31.998, -0.002])]
    got = {r.shot_id: r.nearest_ts for r in retrieval.nearest_for_empty(frames, spark.createDataFrame(spans, "shot_id int, start double, end double")).collect()}
    want = {k: min(times, key=lambda t, m=(a + z) / 2: (abs(t - m), t)) for k, a, z in spans if not any(a - 1e-9 <= t <= z + 1e-9 for t in times)}
    assert got == want
    assert {r.nearest_ts for r in retrieval.nearest_for_empty(frames.limit(0), spark.createDataFrame(spans[:2], "shot_id int, start double, end double")).collect()} == {None}
