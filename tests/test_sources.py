"""CSV sources, stage tables, recording selection, and the stages end to end."""

import csv
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from kerbline.operators import store
from kerbline.params import Params
from kerbline.plans import stages, views
from kerbline.schemas import RECORDING_META, TRACKS, TRACKS_META
from kerbline.sources.raw import (
    only_recordings, read_raw, read_tracks, resolve_recordings, select_recordings,
)
from kerbline.sources.tables import read_recordings, read_table, write_csv, write_recordings, write_table
from kerbline.sources.versions import Versions

P = Params(frame_rate=5.0, min_conflict_duration=0.4, consecutive_frames=True)


def test_selection_of_recordings():
    assert select_recordings("all") is None and select_recordings(" ALL ") is None
    assert select_recordings(" 1, 2 ") == [1, 2] and select_recordings("1-3,5") == [1, 2, 3, 5]
    assert select_recordings(None) is None and select_recordings("  ") is None
    assert resolve_recordings([4], True) == [4] and resolve_recordings(None, True) == [1]
    assert resolve_recordings([], False) is None


def write_raw(folder, recordings=(1, 2)):
    """Two lanes of vehicles; followers close in on slower leaders."""
    for rec in recordings:
        def rows(name, schema, records):
            with open(folder / f"{rec:02d}_{name}.csv", "w", newline="") as handle:
                out = csv.DictWriter(handle, schema.names, restval="0")
                out.writeheader()
                out.writerows(records)

        rows("recordingMeta", RECORDING_META, [{"id": rec, "frameRate": 5, "month": "9.2017", "upperLaneMarkings": "8.5;12.5"}])
        vehicles, frames = [], []
        for i in range(1, 7):
            direction = 2 if i <= 3 else 1
            sign = 1 if direction == 2 else -1
            vehicles.append({"id": i, "width": 4.5, "height": 2, "class": "Truck" if i % 3 == 0 else "Car",
                             "drivingDirection": direction, "numFrames": 80})
            for f in range(1, 81):
                leader = i - 1 if i not in (1, 4) else 0
                speed = 20 + i % 3 * 2 - (0.1 * f if i == 2 else 0) + (1.5 if i == 1 and f > 30 else 0)
                x = 200 - sign * 20 * i + sign * 4 * f
                frames.append({"frame": f, "id": i, "x": x, "y": 8, "width": 4.5, "height": 2, "xVelocity": sign * speed,
                               "precedingId": leader, "laneId": 2 + (i == 5 and f > 40), "dhw": 15.5 if leader else 0})
        rows("tracksMeta", TRACKS_META, vehicles)
        rows("tracks", TRACKS, frames)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    raw, out = tmp_path_factory.mktemp("raw"), str(tmp_path_factory.mktemp("out"))
    write_raw(raw)
    stages.build_frames(spark, str(raw), out, P)
    stages.build_event_tables(spark, out, P)
    return str(raw), out


def test_csv_carries_the_recording_of_its_file(spark, built):
    raw, _ = built
    tracks = read_tracks(spark, raw)
    assert tracks.groupBy("recordingId").count().orderBy("recordingId").collect() == [(1, 480), (2, 480)]
    assert read_tracks(spark, raw, [2]).select("recordingId").distinct().collect() == [(2,)]
    assert read_raw(spark, raw).recordings.select("upperLaneMarkings").first()[0] == "8.5;12.5"
    with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND"):
        read_tracks(spark, raw, [7]).count()


def test_frames_round_trip(spark, built):
    _, out = built
    frames = stages.read_frames(spark, out)
    assert frames.schema.simpleString() == stages.L1_STORED.simpleString() and frames.count() == 960
    pruned = stages.read_frames(spark, out, [2])
    assert "recordingId" in pruned._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    assert pruned.select("recordingId").distinct().collect() == [(2,)]
    with pytest.raises(FileNotFoundError, match="9"):
        stages.read_frames(spark, out, [1, 9], strict=True)
    assert stages.read_frames(spark, out, [1, 9]).count() == 480
    few = read_recordings(spark, f"{out}/l1", columns=["recordingId", "TTC"])
    assert few.columns == ["recordingId", "TTC"]


def test_quality_of_frames(spark, built):
    """The acceptance limits for a frame table."""
    from kerbline.plans import checks, profile

    raw, out = built
    frames = stages.read_frames(spark, out)
    assert all(r.null_ratio < 1e-6 for r in checks.null_ratios(frames, checks.KEY_FIELDS).collect())
    assert all(r.negative_count < 5 or r.negative_ratio < 0.01 for r in checks.backward_steps(frames, P).collect())
    quality = checks.track_quality(frames).first()
    assert quality.v_negative_ratio < 0.01 and quality.a_inside_ratio > 0.98
    assert quality.co2_max < 1e4 and quality.fuel_max < 1e3 and quality.co2_nonneg_ratio > 0.999
    headway = checks.headway_check(frames).first()
    assert headway.pos_ratio >= 0.95 and headway.mean_abs_diff < 5
    assert checks.ttc_quantiles(frames, P).first().q_low > -0.5
    for r in checks.emission_checks(frames).collect():
        assert r.neg_ratio_ok and not r.exceeds_max
    tracks = read_tracks(spark, raw)
    assert all(r.diff_ratio < 0.2 for r in profile.row_drift(tracks, frames).collect())
    aligned = checks.raw_alignment(frames, tracks)
    assert aligned.count() == 960
    assert all(max(r[2:]) < 1e-3 for r in checks.alignment_summary(aligned).collect())


def test_stages_end_to_end(spark, built):
    _, out = built
    conflicts, baselines = stages.read_events(spark, out)
    assert conflicts.count() > 0 and baselines.count() > 0
    assert conflicts.groupBy("recordingId").agg(F.max("event_id") == F.count("*")).orderBy("recordingId").collect() == [(1, True), (2, True)]
    stages.explore(spark, out, P)
    stages.build_costs(spark, out, P)
    stages.report_costs(spark, out, P)
    stages.profile_behaviour(spark, out, replace(P), k=2, all_features=True)
    stages.couple(spark, out, P)
    stages.scan_thresholds(spark, out, P)
    assert read_table(spark, f"{out}/mec").count() == conflicts.count()
    sweep = spark.read.option("header", True).csv(f"{out}/reports/threshold_sweep")
    assert sweep.count() == 12
    assert spark.read.option("header", True).csv(f"{out}/reports/l1_sample").count() == 10
    curve = spark.read.option("header", True).csv(f"{out}/reports/aligned_curve")
    assert curve.count() == 76


def test_thresholds_can_be_overridden(spark, built, tmp_path):
    _, out = built
    frames = str(tmp_path)
    write_recordings(stages.read_frames(spark, out, [1]), f"{frames}/l1")
    stages.build_event_tables(spark, frames, P, ids=[1], ttc_conflict=0.01)
    assert stages.read_events(spark, frames)[0].count() == 0
    with pytest.raises(FileNotFoundError):
        stages.build_event_tables(spark, frames, P, ids=[2])


def test_views(spark, built):
    _, out = built
    frames = stages.read_frames(spark, out)
    assert views.frame_snapshot(frames, 5, 1).count() == 6 and views.frame_snapshot(frames, 5, colour="s_long").count() == 12
    profile = views.track_profile(frames, 1, 2).collect()
    assert [r.frame for r in profile] == list(range(1, 81))
    conflicts, _ = stages.read_events(spark, out)
    trace = views.event_trace(frames, conflicts, P)
    spans = trace.groupBy("recordingId", "event_id").agg(F.min("t"), F.count("*"), F.sum(F.col("in_core").cast("int")))
    assert all(r[2] == 0.0 and r[4] >= 2 for r in spans.collect())
    bare = views.event_trace(frames.withColumn("time", F.lit(None).cast("double")), conflicts, P)
    assert bare.agg(F.min("t")).first()[0] == 0.0
    old = frames.withColumn("veh_class", F.when(F.col("veh_class") == 2, "Truck").otherwise("Car"))
    assert views.load_master(old, ["frame", "veh_class"]).groupBy("veh_class").count().orderBy("veh_class").collect() == [
        (1, 640), (2, 320)]


def test_sinks(spark, tmp_path):
    write_csv(spark.range(10).repartition(4), str(tmp_path / "some"))
    assert len(list((tmp_path / "some").glob("*.csv"))) > 1
    assert spark.read.option("header", True).csv(str(tmp_path / "some")).count() == 10
    assert only_recordings(spark.range(3), None) is not None


class _Session:
    """Just what scratch_dir looks at."""

    def __init__(self, configured, master, checkpoint=None):
        self.conf = {"spark.checkpoint.dir": configured} if configured else {}
        self.sparkContext = self
        self.master, self.applicationId = master, f"app-{master}"
        self.getCheckpointDir = lambda: checkpoint


def test_scratch_folder_follows_the_session(spark):
    assert store.scratch_dir(_Session("hdfs://shared/scratch/", "yarn")) == "hdfs://shared/scratch"
    assert store.scratch_dir(_Session(None, "yarn", "hdfs://shared/x")) == "hdfs://shared/x"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        store.scratch_dir(_Session(None, "yarn"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        store.scratch_dir(_Session(None, "local[2]"))
    table = store.materialize(spark.range(5), "probe")
    assert table.count() == 5 and f"{store.scratch_dir(spark)}/kerbline-probe-" in table.inputFiles()[0].replace("file://", "")


def test_a_query_run_again_takes_no_more_scratch(spark):
    from pathlib import Path

    from kerbline import catalog
    from tests.conftest import SMALL

    def tables():
        return {p.name for p in Path(store.scratch_dir(spark).removeprefix("file:")).iterdir() if p.name.startswith("kerbline-")}

    names = ["l1_master", "mec_basic_stats", "threshold_sweep", "aligned_curve"]
    for name in names:
        catalog.run(name, spark, SMALL).collect()
    before = tables()
    for name in names:
        catalog.run(name, spark, SMALL).collect()
    assert len(tables()) == len(before) and tables() != before


def test_recordings_are_built_one_after_another(spark, tmp_path):
    rows = spark.range(40).selectExpr("int(id % 4) AS recordingId", "id")
    path = str(tmp_path / "t")
    write_recordings(rows.where("recordingId = 1"), path, ids=[1])
    write_recordings(rows.where("recordingId = 2"), path, ids=[2])
    assert sorted(r[0] for r in read_recordings(spark, path).select("recordingId").distinct().collect()) == [1, 2]
    write_recordings(rows.where("recordingId = 1 AND id < 0"), path, ids=[1])
    assert [r[0] for r in read_recordings(spark, path).select("recordingId").distinct().collect()] == [2]
    write_recordings(rows.where("recordingId = 3"), path)
    assert [r[0] for r in read_recordings(spark, path).select("recordingId").distinct().collect()] == [3]


def test_files_of_one_folder_may_have_different_columns(spark, tmp_path):
    (tmp_path / "01_tracks.csv").write_text("frame,id,x,y,xVelocity,note\n1,7,1.5,2,20,early\n2,7,2.5,2,NaN,\n")
    (tmp_path / "02_tracks.csv").write_text("id,frame,y,x,laneId\n9,1,4,3.5,6\n")
    (tmp_path / "03_tracks.csv").write_text("frame,id,x,y,xVelocity,note\n1,8,0,0,1,z\n")
    (tmp_path / "04_tracks.csv").write_text("")
    tracks = read_tracks(spark, str(tmp_path)).orderBy("recordingId", "frame")
    types = {f.name: f.dataType for f in TRACKS.fields}
    assert all(f.dataType == types[f.name] for f in tracks.schema.fields if f.name in types)
    rows = tracks.select("recordingId", "frame", "id", "x", "y", "xVelocity", "laneId", "note").collect()
    assert [tuple(r) for r in rows] == [
        (1, 1, 7, 1.5, 2.0, 20.0, None, "early"), (1, 2, 7, 2.5, 2.0, None, None, None), (2, 1, 9, 3.5, 4.0, None, 6, None),
        (3, 1, 8, 0.0, 0.0, 1.0, None, "z")]
    assert read_tracks(spark, str(tmp_path), [2]).columns == ["id", "frame", "y", "x", "laneId", "recordingId"]
    assert read_tracks(spark, str(tmp_path), [4]).count() == 0
    plan = read_tracks(spark, str(tmp_path)).select("x")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 2  # one scan per header


def counts(spark, path):
    return {r[0]: r[1] for r in read_recordings(spark, path).groupBy("recordingId").count().collect()}


def test_a_write_that_fails_leaves_the_table_as_it_was(spark, tmp_path):
    rows = spark.range(40).selectExpr("int(id % 4) AS recordingId", "id")
    path = str(tmp_path / "t")
    write_recordings(rows, path)
    broken = rows.where("recordingId = 1").withColumn("id", F.when(F.col("id") < 30, F.col("id")).otherwise(F.raise_error(F.lit("broken")).cast("long")))
    with pytest.raises(Exception, match="broken"):
        write_recordings(broken, path, ids=[1])
    with pytest.raises(Exception, match="broken"):
        write_recordings(broken, path)
    assert counts(spark, path) == dict.fromkeys(range(4), 10)
    whole = str(tmp_path / "w")
    write_table(rows, whole)
    with pytest.raises(Exception, match="broken"):
        write_table(broken, whole)
    assert read_table(spark, whole).count() == 40


def test_a_table_can_be_rebuilt_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    write_recordings(spark.range(40).selectExpr("int(id % 4) AS recordingId", "id"), path)
    opened = read_recordings(spark, path)
    write_recordings(read_recordings(spark, path, ids=[1]).where("id < 9"), path, ids=[1])
    assert counts(spark, path) == {0: 10, 1: 2, 2: 10, 3: 10}
    assert opened.count() == 40  # a reader that has started keeps its version
    for k in range(4):
        write_recordings(read_recordings(spark, path, ids=[2]).where(f"id >= {8 * k}"), path, ids=[2])
    assert counts(spark, path) == {0: 10, 1: 2, 2: 4, 3: 10}
    # Of old versions only those remain that the last two manifests name.
    named = {f for n in Versions(spark, path)._numbers() for f in Versions(spark, path)._read(n).values()}
    assert {p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("v=")} == named and len(Versions(spark, path)._numbers()) == 2


def test_of_two_writes_at_once_the_second_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    write_recordings(spark.range(4).selectExpr("int(id) AS recordingId", "id"), path)
    versions = Versions(spark, path)
    number, parts = versions.current()
    versions.publish(parts, number)
    with pytest.raises(Exception, match="exist"):
        versions.publish({}, number)
    assert counts(spark, path) == dict.fromkeys(range(4), 1)


def test_folders_without_versions_are_read_and_taken_over(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(40).selectExpr("int(id % 4) AS recordingId", "id")
    rows.write.partitionBy("recordingId").parquet(path)
    assert counts(spark, path) == dict.fromkeys(range(4), 10)
    for _ in range(3):
        write_recordings(rows.where("recordingId = 1 AND id < 9"), path, ids=[1])
    assert counts(spark, path) == {0: 10, 1: 2, 2: 10, 3: 10}


def test_rebuilding_a_recording_without_conflicts_drops_its_old_ones(spark, built, tmp_path):
    raw, _ = built
    out = str(tmp_path)
    for ids in ([1], [2]):
        stages.build_frames(spark, raw, out, P, ids)
    stages.build_event_tables(spark, out, P)
    assert sorted(r[0] for r in stages.read_frames(spark, out).select("recordingId").distinct().collect()) == [1, 2]
    before = {r[0]: r[1] for r in stages.read_events(spark, out)[0].groupBy("recordingId").count().collect()}
    stages.build_event_tables(spark, out, P, ids=[1], ttc_conflict=0.01)
    assert {r[0]: r[1] for r in stages.read_events(spark, out)[0].groupBy("recordingId").count().collect()} == {2: before[2]}


def test_no_recording_is_dropped_and_all_missing_ones_are_named(spark):
    frames = spark.range(79).selectExpr("int(id + 1) AS recordingId")
    assert only_recordings(frames, resolve_recordings(None, False)).count() == 79
    with pytest.raises(FileNotFoundError) as error:
        only_recordings(frames, range(60, 130), strict=True)
    assert str(list(range(80, 130))) in str(error.value)
    plan = only_recordings(frames, [1, 2], strict=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_files_may_lack_optional_columns(spark, tmp_path):
    write_raw(tmp_path, (3,))
    with open(tmp_path / "03_tracks.csv", newline="") as handle:
        rows = list(csv.DictReader(handle))
    few = ["frame", "id", "x", "y", "width", "height", "xVelocity", "yVelocity", "xAcceleration", "yAcceleration", "precedingId"]
    with open(tmp_path / "03_tracks.csv", "w", newline="") as handle:
        out = csv.DictWriter(handle, few, extrasaction="ignore")
        out.writeheader()
        out.writerows(rows)
    with open(tmp_path / "03_recordingMeta.csv", "w") as handle:
        handle.write("id,note\n3,x\n")
    stages.build_frames(spark, str(tmp_path), str(tmp_path / "out"), P)
    frames = stages.read_frames(spark, str(tmp_path / "out"))
    assert frames.count() == 480 and frames.select(F.min("laneId_raw"), F.count("ttc_raw"), F.min("dt")).first() == (0, 0, pytest.approx(0.2))


def test_trajectories_are_written_by_many_tasks(spark, built):
    from kerbline.plans import coupling
    _, out = built
    conflicts, _ = stages.read_events(spark, out)
    plan = coupling.severe_trajectories(stages.read_frames(spark, out), conflicts, P)._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan
