"""Operators against plain Python, on inputs cut into pieces as small as they go."""

from dataclasses import replace
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.operators.alignment import resample
from kerbline.operators.hexbin import hexbin
from kerbline.operators.intervals import hop_windows, runs, slice_frames
from kerbline.operators.matching import build_tree, descend, nearest_by_speed
from kerbline.operators.ordered import number_rows
from kerbline.operators import ordered, quantiles
from kerbline.operators.quantiles import summarise
from kerbline.operators.sampling import head_per_group, sample_rows
from kerbline.operators.smoothing import with_smoothed
from kerbline.operators.tracks import HALO, index_and_halo, track_pieces, with_shifted, with_working_columns
from kerbline.params import Params
from tests.fixtures import random_world, savgol

TINY = Params(chunk_rows=16, join_chunk=4)


def track_frame(spark, gaps):
    frames, _ = random_world(3, gaps=gaps)
    rows = [(f[0], f[1], f[2], f[7], f[10]) for f in frames]
    return rows, spark.createDataFrame(rows, "recordingId int, trackId long, frame long, v double, laneId_raw long")


def by_track(rows):
    tracks = {}
    for row in rows:
        tracks.setdefault(row[:2], []).append(row)
    return {k: sorted(v, key=lambda r: r[2]) for k, v in tracks.items()}


@pytest.mark.parametrize("gaps", [False, True])
@pytest.mark.parametrize("chunk", [16, 65536])
def test_smoothing_matches_polynomial_fits(spark, gaps, chunk):
    p = replace(TINY, consecutive_frames=not gaps, chunk_rows=chunk)
    rows, df = track_frame(spark, gaps)
    halved = index_and_halo(df, track_pieces(df, p), p, 8, 8)
    smooth = with_smoothed(halved, "v", {"s": 0, "d": 1}, p).filter(~F.col(HALO))
    found = {(r.recordingId, r.trackId, r.frame): (r.s, r.d, r.row_idx, r.n_rows) for r in smooth.collect()}
    assert len(found) == len(rows)
    for key, track in by_track(rows).items():
        values = [r[3] for r in track]
        for i, (row, s, d) in enumerate(zip(track, savgol(values, 0), savgol(values, 1))):
            got = found[(*key, row[2])]
            assert got[2:] == (i, len(track))
            assert got[0] == pytest.approx(s, rel=1e-5)
            assert got[1] == pytest.approx(d, rel=1e-4, abs=1e-5)


def test_short_tracks_and_sample_distance(spark):
    p = replace(TINY, accel_delta=0.04, short_track_accel="null")
    _, df = track_frame(spark, False)
    cut = index_and_halo(df, track_pieces(df, p), p, 8, 8)
    r = with_smoothed(cut, "v", {"d": 1}, p).filter(~F.col(HALO))
    assert r.filter("n_rows < 5 AND d IS NOT NULL").count() == 0
    one = with_smoothed(cut, "v", {"d": 1}, replace(p, accel_delta=1.0)).filter(~F.col(HALO))
    both = r.select("recordingId", "trackId", "frame", F.col("d").alias("a")).join(one, ["recordingId", "trackId", "frame"])
    assert both.filter("n_rows >= 5 AND abs(a - d * 25) > 1e-3 * (1 + abs(a))").count() == 0


def test_missing_frames_are_refused_when_promised_consecutive(spark):
    _, df = track_frame(spark, True)
    with pytest.raises(Exception, match="consecutive_frames"):
        track_pieces(df, replace(TINY, consecutive_frames=True)).collect()


@pytest.mark.parametrize("gaps", [False, True])
def test_neighbouring_rows_cross_pieces(spark, gaps):
    rows, df = track_frame(spark, gaps)
    p = replace(TINY, consecutive_frames=not gaps)
    found = {(r.recordingId, r.trackId, r.frame): (r.before, r.after)
             for r in with_shifted(df, {"before": ("v", -1), "after": ("v", 1)}, p).collect()}
    for key, track in by_track(rows).items():
        values = [None, *[r[3] for r in track], None]
        for i, row in enumerate(track):
            assert found[(*key, row[2])] == (values[i], values[i + 2])
    changed = {(r.recordingId, r.trackId, r.frame): r.lane_changed for r in with_working_columns(df, p).collect()}
    for key, track in by_track(rows).items():
        for before, row in zip([None, *track], track):
            assert changed[(*key, row[2])] == (before is None or before[4] != row[4])


def python_runs(track, flags, max_gap=None):
    found, current = [], None
    for i, (row, flag) in enumerate(zip(track, flags)):
        far = current and max_gap is not None and row[2] - track[i - 1][2] > max_gap + 1
        if flag and current and not far:
            current[1], current[2] = row[2], current[2] + 1
        elif flag:
            if current:
                found.append(tuple(current))
            current = [row[2], row[2], 1]
        elif current:
            found.append(tuple(current))
            current = None
    return found + ([tuple(current)] if current else [])


@pytest.mark.parametrize("max_gap", [None, 3])
def test_runs_across_pieces(spark, max_gap):
    rng = random.Random(5)
    p = replace(TINY, max_gap_frames=max_gap)
    rows, expected = [], []
    for track in range(1, 12):
        share = (0.0, 0.5, 0.9, 0.97, 1.0)[track % 5]
        number, line, flags = 1, [], []
        for i in range(150):
            line.append((1, track, number, i))
            flags.append(rng.random() < share)
            number += 1 if rng.random() < 0.9 else 5
        rows += [(*row, flag) for row, flag in zip(line, flags)]
        expected += [(track, *run) for run in python_runs(line, flags, max_gap)]
    df = spark.createDataFrame(rows, "recordingId int, trackId long, frame long, row_idx long, flag boolean").filter("flag")
    measures = {"low": (F.min("row_idx"), F.min("low"))}
    found = [(r.trackId, r.run_start, r.run_end, r.run_rows) for r in runs(df, measures, p).collect()]
    assert sorted(found) == sorted(expected)


@pytest.mark.parametrize("n", [7, 8, 11, 12, 13, 30])
def test_hop_windows(spark, n):
    df = spark.range(n).select(F.col("id").alias("row_idx"), F.lit(n).cast("long").alias("n_rows"))
    found = {}
    for r in hop_windows(df, 8, 4).collect():
        found.setdefault(r.window_no, []).append(r.row_idx)
    assert {k: sorted(v) for k, v in found.items()} == {
        i: list(range(s, s + 8)) for i, s in enumerate(range(0, n - 8 + 1, 4))}


def test_slices_equal_nested_loops(spark):
    rng = random.Random(2)
    frames = [(rec, track, f) for rec in (1, 2) for track in (1, 2) for f in range(3, 60) if rng.random() < 0.8]
    events = [(rec, track, i, s, s + rng.randint(-1, 25)) for i, (rec, track, s) in enumerate(
        (rng.choice([1, 2]), rng.choice([1, 2, 3]), rng.randint(0, 60)) for _ in range(60))]
    fdf = spark.createDataFrame(frames, "recordingId int, trackId long, frame long")
    edf = spark.createDataFrame(events, "recordingId int, ego_id int, event_id int, s int, e int")
    found = sorted((r.event_id, r.frame) for r in slice_frames(fdf, edf, F.col("s"), F.col("e"), TINY).collect())
    assert found == sorted((i, f) for rec, track, i, s, e in events for frec, ft, f in frames
                           if (frec, ft) == (rec, track) and s <= f <= e)


def test_numbering_with_a_dominant_group(spark):
    rows = [(0 if i % 3 else i % 7, (i * 37) % 5, i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g int, t int, i int").repartition(7)
    got = {r.i: r.n for r in number_rows(df, ["g"], ["t", "i"], "n").collect()}
    for group in {g for g, _, _ in rows}:
        order = sorted((t, i) for g, t, i in rows if g == group)
        assert [got[i] for _, i in order] == list(range(1, len(order) + 1))


def test_numbering_without_group(spark):
    got = number_rows(spark.range(500).repartition(6), [], ["id"], "n").collect()
    assert all(r.n == r.id + 1 for r in got) and len(got) == 500


def test_distributed_quantiles_equal_numpy(spark):
    rng = random.Random(9)
    rows = [(None if i % 11 == 0 else i % 3, 99.0 if i % 3 else rng.uniform(0, 5), None if i % 5 == 0 else rng.gauss(0, 1))
            for i in range(3000)]
    rows += [(7, None, None), (8, 1.5, None)]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    wanted = [("a", 0.1, "a10"), ("a", 0.5, "a50"), ("b", 0.9, "b90")]
    out = {r.g: r for r in summarise(df, ["g"], [F.count("*").alias("n")], wanted).collect()}
    assert set(out) == {None, 0, 1, 2, 7, 8}
    for g in out:
        for column, q, name in wanted:
            values = [r[1 if column == "a" else 2] for r in rows if r[0] == g]
            values = [v for v in values if v is not None]
            want = np.percentile(values, q * 100) if values else None
            assert out[g][name] == (None if want is None else pytest.approx(want, rel=1e-12))
        assert out[g].n == sum(r[0] == g for r in rows)
    total = summarise(df, [], [F.count("*").alias("n")], [("a", 0.25, "q")]).first()
    assert total.n == len(rows)
    assert total.q == pytest.approx(np.percentile([r[1] for r in rows if r[1] is not None], 25))


@pytest.mark.parametrize("accuracy", [20, 100])
def test_quantiles_of_large_groups_come_from_brackets(spark, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = random.Random(accuracy)
    draws = (lambda: rng.gauss(0, 1), lambda: float(rng.choice([1, 1, 1, 2, 50])), lambda: 7.0, lambda: rng.random() ** 9)
    rows = [(g, draws[g]()) for g in range(4) for _ in range(3000)] + [(4, None), (5, 1.5)]
    df = spark.createDataFrame(rows, "g int, a double").repartition(7)
    wanted = [("a", q, f"q{int(q * 1000)}") for q in (0.0, 0.05, 0.1, 0.5, 0.9, 0.999, 1.0)]
    for r in quantiles.summarise(df, ["g"], [], wanted).collect():
        values = [v for g, v in rows if g == r.g and v is not None]
        for _, q, name in wanted:
            assert r[name] == (pytest.approx(np.percentile(values, 100 * q), rel=1e-12, abs=1e-15) if values else None)
    plan = quantiles.summarise(df, ["g"], [], wanted)._jdf.queryExecution().toString()
    assert "percentile_approx" in plan and "rangepartitioning" not in plan


def test_nearest_neighbour_equals_all_pairs(spark):
    rng = random.Random(4)
    speeds = [20.0, 20.5, 21.0, 25.0, None]
    probes = [(1 if i % 3 else 2, rng.choice([1, 2, None]), i, rng.choice([7.0, 8.0, 10.0, 10.5, None]),
               rng.choice(speeds + [rng.uniform(18, 30)])) for i in range(150)]
    cands = [(1 if i % 3 else 2, rng.choice([1, 1, 2]), i, rng.choice([8.0, 8.0, 9.0]),
              rng.choice(speeds + [rng.uniform(18, 30)])) for i in range(120)]
    expected = {}
    for rec, cls, i, dur, v in probes:
        options = [(((dur - d) / 2) ** 2 + ((v - w) / 5) ** 2, b) for r, c, b, d, w in cands
                   if r == rec and c == cls and None not in (cls, dur, v, w) and abs(d - dur) <= 2.0]
        if options:
            expected[(rec, i)] = min(options)[1]
    pdf = spark.createDataFrame(probes, "recordingId int, veh_class int, l2_event_id long, probe_duration double, probe_speed double")
    cdf = spark.createDataFrame(cands, "recordingId int, veh_class int, base_id long, cand_duration double, cand_speed double")
    found = {(r.recordingId, r.l2_event_id): r.base_id for r in nearest_by_speed(pdf, cdf, TINY).collect()}
    assert found == expected and expected


@pytest.mark.parametrize("shape", ["spread", "cluster far away", "one line"])
def test_nearest_neighbour_with_all_durations_different(spark, shape):
    rng = random.Random(6)
    at = {"spread": lambda: (rng.uniform(5, 11), rng.uniform(10, 40)),
          "cluster far away": lambda: (8 + rng.uniform(0, 0.01), 30 + rng.uniform(0, 0.01)),
          "one line": lambda: (rng.uniform(7, 9), 20.0)}[shape]
    cands = [(1, 1, i, *at()) for i in range(1000)]
    probes = [(1, 1, i, rng.uniform(6, 10), rng.uniform(10, 40)) for i in range(1000)]
    pdf = spark.createDataFrame(probes, "recordingId int, veh_class int, l2_event_id long, probe_duration double, probe_speed double")
    cdf = spark.createDataFrame(cands, "recordingId int, veh_class int, base_id long, cand_duration double, cand_speed double")
    tree = build_tree(cdf)
    assert len(tree.levels) == 3
    assert sum(front.count() for front in descend(pdf, tree, TINY)) < 100 * len(probes)
    duration, speed = (np.array([c[k] for c in cands]) for k in (3, 4))
    expected = {}
    for _, _, i, d, v in probes:
        cost = np.where(np.abs(duration - d) <= 2.0, ((d - duration) / 2) ** 2 + ((v - speed) / 5) ** 2, np.inf)
        if np.isfinite(cost.min()):
            expected[i] = int(cost.argmin())
    found = {r.l2_event_id: r.base_id for r in nearest_by_speed(pdf, cdf, TINY).collect()}
    assert found == expected


def test_resampling(spark):
    p = Params(frame_rate=1.0)
    rows = spark.createDataFrame(
        [(1, 1, -2, 10.0, None), (1, 1, 1, 40.0, None), (1, 1, 2, None, None), (1, 2, 0, 5.0, 1.0), (1, 2, 3, None, 4.0)],
        "recordingId int, event_id long, offset long, ttc double, co2 double")
    events = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "recordingId int, event_id long")
    got = {(r.event_id, r.offset): (r.ttc, r.co2) for r in resample(rows, events, ["ttc", "co2"], (-3.0, 4.0), p).collect()}
    assert {k[0] for k in got} == {1, 2} and len(got) == 16
    assert [got[1, k][0] for k in range(-3, 5)] == [None, 10.0, 20.0, 30.0, 40.0, None, None, None]
    assert all(got[1, k][1] is None for k in range(-3, 5))
    assert [got[2, k][0] for k in range(-3, 5)] == [None, None, 5.0, 5.0, 5.0, None, None, None]
    assert [got[2, k][1] for k in range(-3, 5)] == [None, None, None, 1.0, 2.0, 3.0, 4.0, None]


def test_hexbin_assigns_the_nearest_centre(spark):
    rng = random.Random(8)
    points = [(rng.uniform(0, 60), rng.gauss(5, 2)) for _ in range(800)]
    df = spark.createDataFrame([*points, (None, 1.0)], "x double, y double")
    cells = hexbin(df, "x", "y", 20).collect()
    assert sum(c.n for c in cells) == 800
    xs, ys = [q[0] for q in points], [q[1] for q in points]
    w, h = (max(xs) - min(xs)) / 20, (max(ys) - min(ys)) / int(20 / 3 ** 0.5)
    counts = {}
    for x, y in points:
        u, v = (x - min(xs)) / w, (y - min(ys)) / h
        centres = [(i, j) for i in range(22) for j in range(13)] + [(i + .5, j + .5) for i in range(-1, 22) for j in range(-1, 13)]
        best = min(centres, key=lambda c: (u - c[0]) ** 2 + 3 * (v - c[1]) ** 2)
        counts[best] = counts.get(best, 0) + 1
    found = {(round((c.centre_x - min(xs)) / w * 2) / 2, round((c.centre_y - min(ys)) / h * 2) / 2): c.n for c in cells}
    assert found == counts
    same = hexbin(spark.createDataFrame([(1.0, 1.0)] * 3, "x double, y double"), "x", "y", 60).collect()
    assert [c.n for c in same] == [3]


def test_samples_do_not_depend_on_partitioning(spark):
    df = spark.range(1000)
    first, second = (sorted(r.id for r in sample_rows(d, ["id"], 10, 3).collect()) for d in (df.repartition(3), df.repartition(9)))
    assert first == second and len(first) == 10
    heads = head_per_group(df.withColumn("g", F.col("id") % 3), ["g"], ["id"], 2).collect()
    assert sorted(r.id for r in heads) == [0, 1, 2, 3, 4, 5]


def test_stored_rows_are_numbered_alike_whatever_the_groups(spark, monkeypatch):
    rows = spark.range(500).selectExpr("IF(id % 7 = 0, NULL, id % 3) AS g", "pmod(xxhash64(id), 1000003) AS o")
    found = []
    for most in (1_000_000, 10):
        monkeypatch.setattr(ordered, "WINDOW_ROWS", most)
        found.append(sorted(map(str, ordered.number_rows(rows, ["g"], ["o"], "n", stored=True).collect())))
    assert found[0] == found[1] and len(found[0]) == 500
    assert ordered.number_rows(rows.limit(0), ["g"], ["o"], "n", stored=True).count() == 0
