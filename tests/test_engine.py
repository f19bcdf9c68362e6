"""Sources, shots, merging, reports and the whole trace."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from framewake import catalogue, config
from framewake.functions import scalars as fs
from framewake.operators import features, merge, report, retrieval, shots
from framewake.plans import planted
from framewake.sources import media

SF = "/root/testdata/sf0.001"


def test_scan_takes_media_files_below_a_folder(spark, tmp_path):
    for name, content in (("a.mp4", b"1"), ("b/C.MKV", b"1"), ("b/d.txt", b"1"), ("e.webm", b"2")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    assert [r.path.rsplit("/", 1)[1] for r in media.scan(spark, str(tmp_path)).orderBy("path").collect()] == ["a.mp4", "C.MKV", "e.webm"]
    prints = media.with_fingerprint(spark, str(tmp_path))
    assert prints.select("fingerprint").distinct().count() == 2
    first = media.dedupe_content(prints, "fingerprint", "path").collect()
    assert sorted(r.n_duplicates for r in first) == [0, 1]
    other = media.duplicates(prints, "fingerprint", "path").collect()
    assert len(other) == 1 and other[0].path.endswith("a.mp4") and other[0].duplicate.endswith("C.MKV")


def test_sampled_fingerprints_see_one_byte(spark):
    a, b = bytes(40), bytes(20) + b"x" + bytes(19)
    df = spark.createDataFrame([(40, a), (40, b)], "length long, content binary")
    assert df.select(fs.fingerprint(F.col("length"), F.col("content"), 10).alias("f")).distinct().count() == 2


def test_probe_rows_fall_back(spark):
    def probe(duration=None, fmt=None, rate="25/1", frames=None, rotation=None, kind="video"):
        return json.dumps({"streams": [{"codec_type": kind, "avg_frame_rate": rate, "r_frame_rate": "25/1", "width": "1920", "height": "1080", "duration": duration, "nb_frames": frames, "rotation": rotation}], "format": {"duration": fmt}})

    rows = [(1, probe("4.0")), (2, probe(None, "6.0", rotation="90")), (3, probe(None, None, frames="50")), (4, probe(kind="audio")), (5, probe("N/A", None)), (6, probe("2", rate="0/0")), (7, probe("2", rate="20/1"))]
    got = {r.id: r for r in media.probe_rows(spark.createDataFrame(rows, "id int, probe string")).collect()}
    assert (got[1].duration, got[1].frame_count, got[1].orientation) == (4.0, 100, "landscape")
    assert (got[2].duration, got[2].orientation) == (6.0, "portrait") and got[3].duration == 2.0
    assert got[4].error == "no video stream" and got[5].error == "no duration" and got[1].error is None
    assert got[6].fps == 25.0 and got[7].is_vfr and not got[1].is_vfr


def test_times_are_stored_or_estimated(spark):
    rows = [(1, 0, 0.0), (1, 1, 0.05), (2, 0, 0.0), (2, 1, 0.0), (3, 0, 9.0), (3, 1, 9.1)]
    got = {(r.source_id, r.local_index): (r.ts, r.time_source) for r in media.plausible_times(spark.createDataFrame(rows, "source_id int, local_index int, pts double"), 10.0).collect()}
    assert got[1, 1] == (0.05, "pts") and got[2, 1] == (0.1, "estimated") and got[3, 0] == (0.0, "estimated")


def test_cache_builds_what_is_missing(spark, tmp_path):
    asked = []

    def build(keys):
        asked.append(sorted(r.k for r in keys.collect()))
        return keys.withColumn("v", F.col("k") * 2)

    want = lambda *k: spark.createDataFrame([(x,) for x in k], "k int")
    path = str(tmp_path / "cache")
    assert media.cached(spark, path, want(1, 2), "k", build).count() == 2
    assert sorted(r.v for r in media.cached(spark, path, want(2, 3), "k", build).collect()) == [4, 6]
    assert media.cached(spark, path, want(1, 3), "k", build).count() == 2
    assert asked == [[1, 2], [3]]


def test_spaces_must_agree(spark):
    same = spark.createDataFrame([("m", 8), ("m", 8)], "model string, dim int")
    media.require_one_space(same, "model", "dim")
    with pytest.raises(ValueError, match="incompatible"):
        media.require_one_space(same.union(spark.createDataFrame([("m", 16)], "model string, dim int")), "model", "dim")


def test_ground_truth_defaults(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"segments": [{"query_start": 0, "query_end": 4, "source": "a", "source_start": 1, "source_end": 5}, {"id": 9, "query_start": 4, "query_end": 6, "source": "b", "source_start": 1, "source_end": 5, "speed": 1.25, "note": "n"}]}))
    rows = media.ground_truth(spark, str(tmp_path / "t.json")).collect()
    assert [(r.id, r.speed, r.note) for r in rows] == [(1, 1.0, ""), (9, 1.25, "n")]


def test_slices_are_closed(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("ts"))
    assert media.time_slice(df, 2, 5).count() == 4


def test_names_of_clips(spark):
    rows = spark.createDataFrame([(1, "x/Source003.mp4", 52.31, 56.42), (5, "Source01.mp4", 60.515, 64.995)], "id int, source string, a double, b double")
    got = [r[0] for r in rows.select(fs.clip_name(F.col("id"), F.col("source"), F.col("a"), F.col("b"))).collect()]
    assert got == ["001_Source003_00-52-31_00-56-42.mp4", "005_Source01_01-00-52_01-05-00.mp4"]


def test_params_hash_does_not_depend_on_order(spark):
    df = spark.range(1).select(fs.params_hash(b=F.lit(2), a=F.lit("x")).alias("p"), fs.params_hash(a=F.lit("x"), b=F.lit(2)).alias("q")).first()
    assert df.p == df.q and len(df.p) == 16


def brute_shots(cuts, duration, least, most):
    kept, last = [], 0.0
    for t in sorted(cuts):
        if t - last >= least:
            kept.append(t)
            last = t
    bounds = [0.0, *[t for t in kept if t < duration], duration]
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a < 1e-3:
            continue
        n = max(1, -int(-(b - a) // most))
        out += [[a + k * (b - a) / n, a + (k + 1) * (b - a) / n] for k in range(n)]
    if len(out) > 1 and out[-1][1] - out[-1][0] < 0.5 * least:
        last = out.pop()
        out[-1][1] = last[1]
    return out


@pytest.mark.parametrize("cuts, duration", [([], 5.0), ([4.0, 8.48], 13.0), ([0.2, 1.0, 1.3, 9.0, 29.9], 30.0), ([2.0], 2.3), ([5.0, 5.1, 5.9], 6.0)])
def test_shots_cover_the_time_line(spark, cuts, duration):
    cfg = config.ShotConfig()
    df = spark.createDataFrame([(1, cuts, duration)], "m int, t array<double>, d double")
    got = [(r.shot_id, r.start, r.end) for r in shots.build_shots(df, "m", "t", "d", cfg).orderBy("shot_id").collect()]
    want = brute_shots(cuts, duration, cfg.min_shot, cfg.max_shot)
    assert [g[0] for g in got] == list(range(1, len(want) + 1))
    assert [list(g[1:]) for g in got] == [pytest.approx(w) for w in want]


def test_shots_are_built_for_every_user(spark):
    got, want = {}, {}
    for r in catalogue.queries()["build_shots"](spark, SF).orderBy("user_id", "shot_id").collect():
        got.setdefault(r.user_id, []).append([r.start, r.end])
    for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id").collect():
        want.setdefault(r.user_id, []).append(r.event_id / 100.0)
    assert set(got) == set(want)
    for user, times in want.items():
        brute = brute_shots(times, max(times) + 3.0, 2.0, 8.0)
        assert len(got[user]) == len(brute) and all(g == pytest.approx(w, abs=2e-6) for g, w in zip(got[user], brute, strict=True))


def test_cuts_are_found_where_frames_change(spark):
    pixels = [[10] * 16] * 5 + [[200] * 16] * 5 + [[90] * 16] * 5
    df = spark.createDataFrame([(1, k, p) for k, p in enumerate(pixels)], "m int, k int, pixels array<int>").withColumn("hist", shots.gray_histogram(F.col("pixels")))
    scores = shots.change_scores(df, "m", "k", "hist", "pixels")
    assert [r.k for r in shots.peaks(scores, "m", "k", shots.thresholds(scores, "m")).orderBy("k").collect()] == [5, 10]


def test_fixed_windows_end_before_the_end(spark):
    df = spark.createDataFrame([(9.0,), (10.0,), (2.0,)], "d double")
    assert [r[0] for r in df.select(shots.fixed_cuts(F.col("d"), 3.0)).collect()] == [[3.0, 6.0], [3.0, 6.0, 9.0], []]


def test_segments_are_merged_as_a_fold(spark):
    got = merge.merge_segments(catalogue._segments(spark)).orderBy("query_id", "id").collect()
    assert [(r.query_id, r.query_end) for r in got] == [(1, 6.0), (2, 2.0), (2, 4.0), (3, 2.0), (3, 4.0), (4, 2.0), (4, 4.0), (5, 4.3), (5, 6.0)]
    assert got[0].scores["visual"] == pytest.approx(got[0].confidence)


def test_blocked_search_equals_all_pairs(spark):
    frames = planted.all_frames(spark, SF)
    q, index = planted.query_frames(spark, frames), planted.index_frames(frames)
    pairs = retrieval.cosine_pairs(q, index).toPandas()
    best = pairs.groupby(["shot_id", "source_id", "q_idx"]).sim.max()
    got = retrieval.frame_maxima(q, index).toPandas().set_index(["shot_id", "source_id", "q_idx"]).sim
    assert len(best) == len(got) and (best.sort_index() - got.sort_index()).abs().max() < 1e-12
    top = retrieval.top_frames(q, index, 3).toPandas()
    want = pairs.sort_values("sim", ascending=False).groupby(["shot_id", "q_idx"]).head(3)
    assert set(zip(top.shot_id, top.q_idx, top.source_id, top.s_idx, strict=True)) == set(zip(want.shot_id, want.q_idx, want.source_id, want.s_idx, strict=True))


def test_the_trace_names_the_planted_sources(spark):
    got = {r.shot_id: r for r in entry.queries()["trace_once"](spark, SF).collect()}
    want = {s: str(label) for s, n, label, *_ in planted.PLAN if s not in (6, 7, 10)}
    assert {s: got[s].source for s in want} == want
    assert {got[s].status for s in (6, 7, 10)} == {"UNKNOWN"} and {got[s].source for s in (6, 7, 10)} == {None}
    assert [got[s].status for s in (1, 2, 4, 8, 11)] == ["HIGH"] * 5 and got[9].status == "MEDIUM" and got[13].status == "LOW"
    assert got[8].speed == pytest.approx(2.0) and got[1].source_start == pytest.approx(10.0)
    assert got[1].confidence == pytest.approx(1.0, abs=0.01) and got[11].confidence == pytest.approx(0.859, abs=0.01)


def test_reports_are_written(spark, tmp_path):
    segments = catalogue._segments(spark).drop("scores")
    report.write_csv(segments, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 12
    report.write_json(segments, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 12
    assert report.clip_manifest(segments, "query_id").count() == 11
    assert report.sample_times(segments.where("source is not null"), 4, "query_id").count() == 44


def test_settings_load():
    made = config.load({"align": {"min_sim": 0.5, "slopes": [1.0]}})
    assert made.align.min_sim == 0.5 and made.align.slopes == (1.0,) and made.shots.min_shot == 0.6
    with pytest.raises(ValueError, match="unknown settings"):
        config.load({"align": {"min_simm": 1}})


def test_every_query_runs_and_has_one_schema(spark):
    found = catalogue.queries()
    assert set(catalogue.oracle_sql()) <= set(found)
    for name in ("trace_evaluated", "resolve_ladder", "report_rows", "space_guard", "bench_best", "nearest_frame_fallback"):
        assert found[name](spark, SF).count() > 0, name


def test_frame_descriptors(spark):
    import numpy as np

    from framewake.operators import features

    frames = np.random.default_rng(0).integers(0, 256, (3, 32, 48, 3), dtype=np.uint8)
    got = features.colour_histogram(frames)
    assert got.shape == (3, 512) and np.abs(np.linalg.norm(got, axis=1) - 1).max() < 1e-5
    # a cell's colours, counted plainly: the second row and third column of the grid, green
    cell = frames[1, 8:16, 24:36, 1]
    plain = np.histogram(cell, bins=8, range=(0, 256))[0]
    part = got[1].reshape(16, 32)[6, 8:16]
    assert np.allclose(part / part.sum(), plain / plain.sum())
    rows = [(1, k, 32, 48, bytearray(f.tobytes())) for k, f in enumerate(frames)] + [(1, 9, 32, 48, bytearray(b"x")), (1, 10, 32, 48, None)]
    out = {r.frame_idx: r for r in features.encode(spark.createDataFrame(rows, "media_id int, frame_idx int, height int, width int, pixels binary")).collect()}
    assert np.allclose(out[1].descriptor, got[1]) and out[9].error and out[10].error and not out[0].error
    assert features.centre_crop(frames, 0.5).shape == frames.shape and not np.array_equal(features.centre_crop(frames, 0.5), frames)
    with pytest.raises(ValueError, match="unknown"):
        features.encode(spark.createDataFrame([], "media_id int, frame_idx int, height int, width int, pixels binary"), "x")


def test_the_background_is_drawn_from_all_frames(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    frames = [(s, i, float(i), rng.normal(size=4).tolist()) for s in range(4) for i in range(100)]
    index = spark.createDataFrame(frames, "source_id int, local_index int, ts double, descriptor array<double>")
    query = spark.createDataFrame([(1, 0, 0.0, [1.0, 0.0, 0.0, 0.0])], "shot_id int, q_idx int, q_ts double, descriptor array<double>")
    pairs = spark.createDataFrame([(1, 0, s, i, 0.0) for s in (0, 2) for i in (0, 1)], "shot_id int, q_idx int, source_id int, s_idx int, sim double")
    chosen = {}
    for r in retrieval.background(index, pairs.select(F.col("source_id").alias("cand")).distinct(), 60).collect():
        chosen.setdefault(r.cand, []).append((r.other, r.local_index, r._d[0]))
    hashed = {(r.source_id, r.local_index): r.h for r in index.select("source_id", "local_index", F.md5(F.concat_ws(":", "source_id", "local_index").cast("binary")).alias("h")).collect()}
    for cand, got in chosen.items():
        want = sorted((p for p in hashed if p[0] != cand), key=lambda p: (hashed[p], p))[:60]
        assert sorted((o, i) for o, i, _ in got) == sorted(want) and max(i for _, i, _ in got) >= 50
    out = {r.source_id: r.sim for r in retrieval.normalized_scores(pairs, index, query, pool=60).collect()}
    assert set(out) == {0, 2} and all(out[c] == pytest.approx(-0.5 * np.mean(sorted((x for *_, x in chosen[c]), reverse=True)[:10])) for c in out)


def test_every_candidate_gets_a_normalised_score(spark):
    got = {(r.shot_id, r.source_id) for r in catalogue.queries()["score_normalise"](spark, SF).collect()}
    assert got == {(r.shot_id, r.source_id) for r in catalogue.queries()["rank_candidates"](spark, SF).collect()}


def test_every_byte_of_a_document_is_in_a_frame(spark, tmp_path):
    texts = [None, "", "short", "x" * 192, "y" * 193, "\u00e9\u65e5" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    frames = {}
    for r in features.byte_frames(docs, "doc_id", "text", 8).orderBy("doc_id", "frame_idx").collect():
        frames.setdefault(r.doc_id, []).append(r.pixels)
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        n = max(1, -(-len(raw) // 192))
        assert len(frames[k]) == n and all(p is None or len(p) in (0, 192) for p in frames[k])
        assert b"".join(bytes(p or b"") for p in frames[k]) == (raw.ljust(192 * n, b"\0") if raw else b"")
    got = catalogue.queries()["frame_descriptors"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.frame_idx) for r in got) == [(k, i) for k in range(len(texts)) for i in range(len(frames[k]))]
    assert all((r.error is not None) == (r.doc_id < 2) for r in got) and all(r.square == pytest.approx(1) and r.dim == 512 for r in got if r.doc_id >= 2)


def test_refinement_stays_near_the_coarse_interval(spark):
    got = {r.shot_id: r for r in catalogue.queries()["refined_segments"](spark, SF).collect()}
    assert got[1].source_start == pytest.approx(10.0) and got[8].slope == pytest.approx(2.0) and got[4].visual > 0.5
