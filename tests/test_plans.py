"""Stages on hand-made worlds, against a plain re-computation of the rules."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from kerbline.operators.tracks import WORKING
from kerbline.params import Params
from kerbline.plans import behaviour, checks, coupling, events, l1, mec, mec_report, profile, sweep
from kerbline.schemas import BASELINES, CONFLICTS, L1
from tests.fixtures import frame, random_world, raw_tables, savgol, vehicle

TINY = Params(frame_rate=1.0, min_conflict_duration=2.0, chunk_rows=16, join_chunk=4)
PLAIN = replace(TINY, chunk_rows=65536, join_chunk=256)


def rows_of(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def world(spark):
    frames, vehicles = random_world(11)
    raw = raw_tables(spark, frames, vehicles, rates=((1, 25.0), (2, None)))
    return frames, vehicles, raw


def expected_l1(frames, vehicles, p):
    meta = {(v[0], v[1]): v for v in vehicles}
    extent, tracks, out = {}, {}, {}
    for f in frames:
        width = meta[f[:2]][2]
        extent[f[0]] = max(extent.get(f[0], -1e9), f[3] + width)
        tracks.setdefault(f[:2], []).append(f)
    for key, track in tracks.items():
        _, _, width, height, kind, direction = meta[key]
        track.sort(key=lambda f: f[2])
        speed = [f[7] if direction == 2 else -f[7] for f in track]
        for f, v, a, raw_v in zip(track, savgol(speed, 0), savgol(speed, 1), speed):
            centre = f[3] + width / 2
            out[f[:3]] = dict(s=centre if direction == 2 else extent[key[0]] - centre, v=v, a=a, raw_v=raw_v,
                              width=width, lat=f[4] + height / 2, kind={"Car": 1, "Truck": 2}.get(kind))
    for f in frames:
        row, lead = out[f[:3]], out.get((f[0], f[9], f[2]))
        row["gap"] = lead and lead["s"] - row["s"] - (lead["width"] + row["width"]) / 2
        gain = lead and lead["v"] - row["v"]
        row["ttc"] = row["gap"] / gain if lead and gain > 0 else 99.0
    return out


@pytest.mark.parametrize("p", [TINY, PLAIN], ids=["tiny", "plain"])
def test_frame_table(spark, world, p):
    frames, vehicles, raw = world
    p = replace(p, frame_rate=20.0)
    table = l1.master_frames(raw, p)
    assert table.schema.simpleString() == L1.simpleString()
    got = rows_of(table, "recordingId", "trackId", "frame")
    want = expected_l1(frames, vehicles, p)
    assert set(got) == set(want)
    for key, w in want.items():
        g = got[key]
        assert g["s_long"] == pytest.approx(w["s"]) and g["d_lat"] == pytest.approx(w["lat"])
        assert g["v_long_raw"] == w["raw_v"] and g["veh_class"] == w["kind"]
        assert g["v_long_smooth"] == pytest.approx(w["v"], rel=1e-5)
        assert g["a_long_smooth"] == pytest.approx(w["a"], rel=1e-4, abs=1e-5)
        assert g["time"] == pytest.approx(key[2] / (25.0 if key[0] == 1 else 20.0))
        assert g["dt"] == pytest.approx(1 / (25.0 if key[0] == 1 else 20.0))
        assert (g["dist_headway"] is None) == (w["gap"] is None)
        if w["gap"] is not None:
            assert g["dist_headway"] == pytest.approx(w["gap"], abs=1e-6)
        if abs(w["ttc"]) < 90:
            assert g["TTC"] == pytest.approx(w["ttc"], rel=1e-3)
        assert g["global_track_id"] == key[0] * 10000 + key[1]
    boxes = table.groupBy("recordingId").agg(F.min("x_img"), F.max("x_img"), F.min("y_img"), F.max("y_img")).collect()
    assert all(b[1] == 0 and b[2] <= 1280 and b[3] == 0 and b[4] <= 720 for b in boxes)


def test_layout_does_not_change_the_frame_table(spark, world):
    _, _, raw = world
    tiny, plain = (l1.working_frames(raw, p).collect() for p in (TINY, PLAIN))
    assert sorted(map(str, tiny)) == sorted(map(str, plain))


def test_metadata_miss_is_an_error_when_strict(spark):
    raw = raw_tables(spark, [frame(track=1), frame(track=2)], [vehicle(track=1)])
    with pytest.raises(Exception, match="without vehicle metadata"):
        l1.master_frames(raw, PLAIN).collect()
    loose = rows_of(l1.master_frames(raw, replace(PLAIN, strict_metadata=False)), "trackId")
    assert loose[2,]["veh_class"] is None and loose[2,]["width"] == 4.0


def test_leaders(spark):
    frames = [
        frame(1, 1, 1, x=100, v=20, leader=2), frame(1, 2, 1, x=130, v=25),
        frame(1, 3, 1, x=100, v=20, leader=99), frame(1, 4, 1, x=128, v=20, leader=2),
        frame(1, 5, 1, x=100, v=25, leader=2), frame(1, 6, 1, x=100, v=30, leader=2),
        frame(2, 1, 1, x=10, v=5), frame(2, 7, 1, x=0, v=5, leader=2), frame(1, 8, 1, x=1, v=0, leader=0),
    ]
    vehicles = [vehicle(f[0], f[1]) for f in frames]
    got = rows_of(l1.master_frames(raw_tables(spark, frames, vehicles, ((1, 25.0), (2, 25.0))), TINY), "recordingId", "trackId")
    assert got[1, 1]["dist_headway"] == 26.0 and got[1, 1]["TTC"] == pytest.approx(5.2) and got[1, 1]["DRAC"] == 0.0
    assert got[1, 3]["dist_headway"] is None and got[1, 3]["TTC"] == 99.0 and got[1, 3]["DRAC"] == float("inf")
    assert got[1, 4]["dist_headway"] == -2.0 and got[1, 4]["TTC"] == pytest.approx(-0.4) and got[1, 4]["risk_level"] == 2
    assert got[1, 5]["TTC"] == 99.0
    assert got[1, 6]["TTC"] == 99.0 and got[1, 6]["DRAC"] == pytest.approx(25 / 42)
    assert got[2, 7]["dist_headway"] is None
    assert got[1, 8]["time_headway"] == 99.0 and got[1, 1]["time_headway"] == pytest.approx(1.3)


def l1_table(spark, rows):
    """A minimal L1 table: (rec, track, frame, ttc, accel, lane, co2, class)."""
    df = spark.createDataFrame(rows, "recordingId int, trackId long, frame long, TTC float, a_long_smooth float, "
                                     "laneId_raw long, cpf_co2_rate_gps float, veh_class int")
    return df.select(
        "*", F.col("frame").cast("double").alias("time"), F.lit(1.0).cast("float").alias("dt"),
        (F.col("frame") * 20.0).alias("s_long"), F.lit(20.0).cast("float").alias("v_long_smooth"),
        F.lit(0.5).cast("float").alias("cpf_fuel_rate_lps"), F.lit(1.0).cast("float").alias("vsp_co2_rate"),
        F.lit(0.1).cast("float").alias("vsp_nox_rate"))


def track_rows(rec, track, ttcs, frames=None, lane=2, accel=0.0, co2=2.0, cls=1):
    frames = frames or range(1, len(ttcs) + 1)
    lanes = lane if isinstance(lane, list) else [lane] * len(ttcs)
    accels = accel if isinstance(accel, list) else [accel] * len(ttcs)
    return [(rec, track, f, float(t), float(a), ln, float(co2), cls) for f, t, ln, a in zip(frames, ttcs, lanes, accels)]


EVENT_ROWS = (
    track_rows(1, 1, [99] * 30)
    + track_rows(1, 2, [1.5] * 20)
    + track_rows(1, 3, [3, 3] + [99] * 12 + [2, 2.5, 1.0] + [99] * 3 + [3.5, 3.9] + [99] * 20, lane=[2, 3] * 21)
    + track_rows(1, 4, [4.0] * 10 + [3.99] + [99] * 10)
    + track_rows(1, 5, [99, 99, 3, 3, 3, 99, 99], frames=[10, 11, 20, 31, 40, 41, 60], lane=[2, 2, 2, None, None, 3, 3])
    + track_rows(2, 2, [99] * 5 + [-0.5, 3], cls=2)
)


def expected_conflicts(rows, p):
    tracks, out = {}, []
    for r in rows:
        tracks.setdefault(r[:2], []).append(r)
    counters = {}
    for (rec, track), line in sorted(tracks.items()):
        line.sort(key=lambda r: r[2])
        runs, start = [], None
        for i, r in enumerate([*line, None]):
            low = r is not None and r[3] < p.ttc_conflict
            if low and start is None:
                start = i
            if not low and start is not None:
                runs.append(line[start:i])
                start = None
        for run in runs:
            if len(run) < p.min_conflict_duration:
                continue
            lo, hi = max(line[0][2], run[0][2] - 3), min(line[-1][2], run[-1][2] + 5)
            window = [r for r in line if lo <= r[2] <= hi]
            changes = sum(a[5] is None or b[5] is None or a[5] != b[5] for a, b in zip(window, window[1:]))
            counters[rec] = counters.get(rec, 0) + 1
            low = min(window, key=lambda r: (r[3], r[2]))
            out.append(dict(
                event_id=counters[rec], recordingId=rec, ego_id=track, start_frame=lo, end_frame=hi,
                start_time=float(window[0][2]), end_time=float(window[-1][2]), duration=float(len(window)),
                conf_start_frame=run[0][2], conf_end_frame=run[-1][2], conf_duration=float(len(run)),
                min_TTC=low[3], min_TTC_conf=min(r[3] for r in run), veh_class=window[0][7], num_lane_changes=changes,
                E_cpf_CO2=2.0 * len(window), E_cpf_fuel=0.5 * len(window), E_vsp_CO2=1.0 * len(window),
                E_vsp_NOx=0.1 * len(window), min_ttc_frame=low[2]))
    return out


@pytest.mark.parametrize("p", [TINY, PLAIN], ids=["tiny", "plain"])
def test_conflict_events(spark, p):
    table = events.conflict_events(l1_table(spark, EVENT_ROWS), p)
    assert table.columns == CONFLICTS.names + ["min_ttc_frame"]
    got = sorted((r.asDict() for r in table.collect()), key=lambda r: (r["recordingId"], r["event_id"]))
    want = expected_conflicts(EVENT_ROWS, p)
    assert len(got) == len(want) == 6
    for g, w in zip(got, want):
        assert g == {k: pytest.approx(v, rel=1e-6) for k, v in w.items()}


def test_conflict_parameters(spark):
    table = l1_table(spark, EVENT_ROWS)
    assert events.conflict_windows(table, replace(TINY, min_conflict_frames=3)).count() == 3
    assert events.conflict_windows(table, replace(TINY, max_gap_frames=0)).count() == 5
    none = events.conflict_events(table.filter("TTC > 50"), TINY)
    assert none.count() == 0 and none.columns[:19] == CONFLICTS.names
    swept = {(r.TTC_thr, r.dur_thr): r for r in sweep.threshold_sweep(table, TINY, (1.0, 2.0, 4.0), (2.0, 3.0)).collect()}
    assert len(swept) == 6
    assert [swept[t, d].n_conf for t in (1.0, 2.0, 4.0) for d in (2.0, 3.0)] == [0, 0, 1, 1, 6, 3]
    assert swept[1.0, 2.0].med_conf_dur is None and swept[4.0, 3.0].med_conf_dur == 3.0


def test_sweep_equals_separate_detections(spark):
    table = l1_table(spark, EVENT_ROWS)
    swept = {(r.TTC_thr, r.dur_thr): r for r in sweep.threshold_sweep(table, PLAIN, (3.6, 4.0), (1.0, 2.0)).collect()}
    for (ttc, length), cell in swept.items():
        alone = events.conflict_windows(table, replace(PLAIN, ttc_conflict=ttc, min_conflict_duration=length))
        stats = alone.agg(F.count("*"), F.percentile("min_TTC_conf", 0.5), F.percentile("E_cpf_CO2", 0.5)).first()
        assert (cell.n_conf, cell.med_min_TTC_conf, cell.med_E_CO2) == tuple(stats)


BASE_ROWS = (
    track_rows(1, 1, [99] * 7) + track_rows(1, 2, [99] * 8) + track_rows(1, 3, [99] * 11)
    + track_rows(1, 4, [99] * 12, accel=[0.0] * 11 + [-0.6])
    + track_rows(1, 5, [99] * 20, lane=[2] * 9 + [3] * 11) + track_rows(1, 6, [4.0] + [99] * 12)
    + track_rows(1, 7, [99] * 8, accel=0.5) + track_rows(1, 8, [99] * 8, lane=[None] * 3 + [2] * 5)
    + track_rows(1, 9, [99, 5] * 4, frames=[2, 3, 4, 9, 10, 11, 20, 21]) + track_rows(2, 1, [99] * 16, cls=2)
)


@pytest.mark.parametrize("p", [TINY, PLAIN], ids=["tiny", "plain"])
def test_baseline_events(spark, p):
    table = events.baseline_events(l1_table(spark, BASE_ROWS), p)
    assert table.columns == BASELINES.names
    got = [(r.recordingId, r.event_id, r.ego_id, r.start_frame, r.end_frame, r.num_lane_changes, r.mean_TTC)
           for r in table.orderBy("recordingId", "event_id").collect()]
    assert got == [
        (1, 1, 2, 1, 8, 0, 99.0), (1, 2, 3, 1, 8, 0, 99.0), (1, 3, 4, 1, 8, 0, 99.0), (1, 4, 5, 1, 8, 0, 99.0),
        (1, 5, 5, 13, 20, 0, 99.0), (1, 6, 6, 5, 12, 0, 99.0), (1, 7, 8, 1, 8, 3, 99.0), (1, 8, 9, 2, 21, 0, 52.0),
        (2, 1, 1, 1, 8, 0, 99.0), (2, 2, 1, 5, 12, 0, 99.0), (2, 3, 1, 9, 16, 0, 99.0)]


def test_working_columns_and_gap_free_promise_agree(spark):
    rows = [r for r in EVENT_ROWS if r[1] != 5]
    table = l1_table(spark, rows)
    slow = events.conflict_windows(table, TINY).collect()
    fast = events.conflict_windows(table, replace(TINY, consecutive_frames=True)).collect()
    assert sorted(map(str, slow)) == sorted(map(str, fast)) and not set(WORKING) & set(table.columns)


@pytest.fixture(scope="module")
def costs(spark):
    rows = (
        track_rows(1, 1, [99] * 4 + [1.5, 1.0, 2.5] + [99] * 30, co2=5.0) + track_rows(1, 2, [99] * 20, co2=2.0)
        + track_rows(1, 3, [99] * 3 + [2.2, 2.2] + [99] * 20, cls=2) + track_rows(2, 1, [99] * 3 + [2.5, 2.9] + [99] * 9, co2=3.0)
        + track_rows(2, 4, [99] * 9, co2=1.0)
    )
    table = l1_table(spark, rows)
    conflicts, baselines = events.build_events(table, PLAIN)
    return table, conflicts, baselines


@pytest.mark.parametrize("p", [replace(TINY, match_band=3.5), replace(PLAIN, match_band=3.5)], ids=["tiny", "plain"])
def test_costs(spark, costs, p):
    table, conflicts, baselines = costs
    mec_table = mec.match_baselines(table, conflicts, baselines, p)
    got = rows_of(mec_table, "rec_id", "event_id")
    assert set(got) == {(1, 0), (1, 1), (2, 0)}
    one = got[1, 0]
    assert one["l2_event_id"] == 1 and one["ego_id"] == 1 and one["duration"] == 11.0 and one["duration_base"] == 8.0
    assert one["base_event_id"] == 1 and one["base_ego_id"] == 1
    assert one["E_real_CO2"] == 55.0 and one["dist_real_m"] == 200.0 and one["E_real_CO2_per_km"] == pytest.approx(275.0)
    assert one["E_base_CO2"] == 40.0 and one["MEC_CO2_per_event"] == 15.0
    assert one["MEC_CO2_per_km"] == pytest.approx(275.0 - 40.0 / 0.14)
    assert one["E_real_CO2_per_s"] == 5.0 and one["MEC_bucket"] == "<2" and one["flow_state"] == "unknown"
    assert got[1, 1]["base_event_id"] is not None and got[1, 1]["veh_class"] == 2
    narrow = rows_of(mec.match_baselines(table, conflicts, baselines, replace(p, match_band=1.0)), "rec_id", "event_id")
    assert all(r["base_event_id"] is None and r["MEC_CO2_per_km"] is None for r in narrow.values())


def test_metrics_without_frame_lengths(spark, costs):
    table, conflicts, _ = costs
    with_dt = rows_of(mec.episode_metrics(table, {"c": conflicts}, TINY), "recordingId", "event_id")
    without = rows_of(mec.episode_metrics(table.drop("dt"), {"c": conflicts}, TINY), "recordingId", "event_id")
    assert with_dt == {k: {n: pytest.approx(v) if isinstance(v, float) else v for n, v in r.items()} for k, r in without.items()}


def test_cost_reports(spark):
    rows = [(1, i, v, t, d, c, "unknown", 1.0, 2.0) for i, (v, t, d, c) in enumerate([
        (1.0, 1.5, 0.5, 1), (2.0, 2.0, 0.9, 1), (float("inf"), 2.5, 0.9, 2), (None, 3.5, 1.5, 2), (4.0, None, 0.3, None)])]
    df = spark.createDataFrame(rows, "rec_id int, event_id long, MEC_CO2_per_km double, ttc_conf_min double, conf_dur double, "
                                     "vehicle_class int, flow_state string, E_real_CO2_per_km double, duration double")
    df = df.withColumns({"MEC_bucket": F.lit("b"), "E_base_CO2_per_km": F.lit(1.0), "MEC_CO2_per_event": F.lit(3.0)})
    for p in (TINY, PLAIN):
        head = mec_report.headline(df, p).first()
        assert (head.n_events, head.median) == (5, 2.0) and head.p90 == pytest.approx(3.6)
        stats = rows_of(mec_report.basic_stats(df.filter("event_id <> 2"), p), "scope", "severity_bin", "veh_class")
        assert stats["overall", None, None]["count"] == 3 and stats["overall", None, None]["median"] == 2.0
        assert stats["by_group", "<=2s", "Car"]["q10"] == pytest.approx(1.1) and stats["by_group", "<=2s", "Car"]["mean"] is None
        assert stats["by_group", "unknown", None]["median"] == 4.0 and len(stats) == 4
        debug = mec_report.debug_summary(df, p).collect()
        assert len(debug) == 2 and debug[0].n_events == 5 and debug[1].min_TTC_bucket == "b" and debug[1].n_events is None
    bins = rows_of(mec_report.bin_counts(df, PLAIN), "severity_bin", "duration_bin")
    assert bins["unknown", "<=0.4s"]["n_events"] == 1 and len(bins) == 5
    full = mec_report.summary_table(df, PLAIN, complete=True)
    assert full.count() == 5 and full.filter("n_events = 0").count() == 1
    no_id = mec_report.normalise(df.drop("event_id", "flow_state"), TINY, ("MEC_CO2_per_km", "conf_duration"))
    assert sorted(r.event_id for r in no_id.collect()) == [0, 1, 2, 3, 4] and no_id.first().flow_state == "unknown"
    bare = mec_report.with_bins(spark.range(1))
    assert bare.first().severity_bin == "unknown" and bare.first().duration_bin == "unknown"


def test_alignment_and_lags(spark):
    rows = [r[:6] + (float(c), 1) for r, c in zip(
        track_rows(1, 1, [99, 99, 3, 1, 1, 3, 99, 99, 99]), [1, 1, 2, 2, 2, 9, 9, 1, 1])]
    table = l1_table(spark, rows)
    conflicts = events.conflict_events(table, PLAIN)
    for given in (conflicts, conflicts.drop("min_ttc_frame"), conflicts.drop("min_ttc_frame", "start_frame", "conf_start_frame",
                                                                             "end_frame", "conf_end_frame")):
        for p in (TINY, PLAIN):
            series = {r.offset: (r.ttc, r.co2) for r in coupling.aligned_series(table, given, p).collect()}
            assert len(series) == 16 and series[0] == (1.0, 2.0) and series[-3] == (99.0, 1.0) and series[-4] == (None, None)
            assert [r.lag for r in coupling.lags(table, given, p).collect()] == [2.0]
    curve = {r.offset: r for r in coupling.aligned_curve(table, conflicts, TINY).collect()}
    assert curve[1].TTC_mean == 1.0 and curve[1].n_episodes == 1 and curve[9].TTC_p90 is None and curve[9].n_episodes == 1
    stats = coupling.lag_stats(table, conflicts, TINY).first()
    assert tuple(stats) == (2.0, 2.0, 2.0, 2.0)
    assert coupling.episode_rows(table, conflicts, PLAIN, max_episodes=0).count() == 0
    missing = table.filter("frame <> 5")
    linear = {r.offset: r.ttc for r in coupling.aligned_series(missing, conflicts, PLAIN).collect()}
    assert linear[1] == 2.0


def test_phase_plane(spark):
    table = l1_table(spark, EVENT_ROWS)
    conflicts = events.conflict_events(table, PLAIN)
    samples = coupling.phase_samples(table, conflicts, TINY)
    assert samples.agg(F.min("TTC"), F.max("TTC")).first() == (0.0, 60.0)
    assert samples.count() == conflicts.agg(F.sum("duration")).first()[0]
    severe = coupling.severe_conflicts(conflicts, 2).collect()
    assert [(r.recordingId, r.event_id) for r in severe] == [(1, 3), (1, 1)]
    assert coupling.severe_trajectories(table, conflicts, PLAIN, 1).select("event_id").distinct().count() == 1
    assert sum(r.n for r in coupling.phase_density(table, conflicts, TINY).collect()) == samples.count()


def test_behaviour(spark):
    rows = [(1, i, 1, 1 + i % 3 * 0.8, 1.0, 10.0 * (i % 3) + i * 0.01, 5.0 * (i % 3), 1, 8) for i in range(30)]
    rows += [(1, 90, 1, 3.5, 1.0, 1.0, 1.0, 1, 8), (1, 91, 1, 1.0, 0.5, 1.0, 1.0, 1, 8), (1, 92, 1, 1.0, 1.0, None, 1.0, 1, 8)]
    df = spark.createDataFrame(rows, "rec_id int, event_id long, ego_id long, min_TTC_conf double, conf_duration double, "
                                     "MEC_CO2_per_km double, E_real_CO2_per_km double, start_frame long, end_frame long")
    chosen = behaviour.clustering_events(df)
    assert chosen.count() == 30
    clustered = behaviour.cluster_events(chosen)
    again = behaviour.cluster_events(chosen)
    labels = {r.event_id: r.cluster for r in clustered.collect()}
    assert labels == {r.event_id: r.cluster for r in again.collect()} == {i: i % 3 for i in range(30)}
    summary = {r.cluster: r for r in behaviour.cluster_summary(clustered, TINY).collect()}
    assert [summary[c]["count"] for c in range(3)] == [10, 10, 10] and summary[1].min_TTC_conf_median == pytest.approx(1.8)
    table = l1_table(spark, track_rows(1, 1, [9, 9, 1, 9, 9, 9, 9, 9], accel=[0, -2, 0, 3, 0, 0, 0, 0]))
    curves = behaviour.cluster_curves(table, clustered, PLAIN)
    assert {r.offset: r.a_mean for r in curves.filter("cluster = 0").collect()}[-1] == -2.0
    assert curves.count() == 42
    extremes = behaviour.kinematic_extremes(table, chosen.filter("event_id = 3"), TINY).first()
    assert (extremes.max_decel, extremes.max_accel, extremes.v_drop) == (-2.0, 3.0, 0.0)
    assert behaviour.cluster_events(chosen.filter("event_id < 0")).columns[-1] == "cluster"
    scaled, used = behaviour.scaled_features(chosen)
    assert used == ["min_TTC_conf", "conf_duration", "MEC_CO2_per_km", "E_real_CO2_per_km"]
    constant = behaviour.feature_array(scaled).agg(F.max(F.abs(F.get("features_z", F.lit(1))))).first()[0]
    assert constant == 0.0
    with pytest.raises(ValueError):
        behaviour.scaled_features(spark.range(1))


def test_profiles_and_checks(spark, costs):
    table, conflicts, baselines = costs
    prof = {r.rec_id: r for r in profile.l2_profile(conflicts, baselines, TINY).collect()}
    assert prof[1].n_conf == 2 and prof[2].n_conf == 1 and prof[2].n_base == baselines.filter("recordingId = 2").count()
    l1p = profile.l1_profile(table, spark.createDataFrame([(1,), (9,)], "rec_id int"))
    assert {r.rec_id: r.n_rows for r in l1p.collect()}[9] == 0
    assert profile.missing_columns(table.drop("dt")) == ["dt"]
    assert ("TTC", "float") in profile.schema_listing(table)
    counts = profile.class_counts(conflicts.withColumn("veh_class", F.lit(None).cast("byte")), baselines, keep_null=False)
    assert counts.filter("event_type = 'conflict'").count() == 0
    for p in (TINY, PLAIN):
        described = {(r.event_type, r.field): r for r in profile.describe_events(conflicts, baselines, p).collect()}
        assert described["conflict", "conf_duration"]["count"] == 3 and described["conflict", "conf_duration"].q50 == 2.0
        assert described["conflict", "conf_duration"].std == pytest.approx(0.57735, rel=1e-4)
    steps = l1_table(spark, track_rows(1, 1, [9] * 40)).withColumn("s_long", F.when(F.col("frame") == 17, 0.0).otherwise(F.col("s_long")))
    got = checks.backward_steps(steps, TINY).first()
    assert (got.negative_count, got.total_steps) == (1, 39)
    assert checks.emission_checks(table.withColumn("cpf_co2_rate_gps", F.lit(-1.0))).filter("field = 'cpf_co2_rate_gps'").first().neg_ratio == 1.0
    nulls = {r.field: r.null_ratio for r in checks.null_ratios(table.withColumn("TTC", F.when(F.col("frame") > 5, F.col("TTC")))).collect()}
    assert 0 < nulls["TTC"] < 1 and nulls["frame"] == 0.0
