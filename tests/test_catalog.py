"""Registered queries against their SQL, on the smallest tables, in two physical layouts."""

from dataclasses import replace

import pytest

import __spark_entry__ as contract
from kerbline import catalog
from kerbline.plans.workspace import Workspace, open_workspace
from kerbline.sources.activity import ACTIVITY_PARAMS, activity_frames
from tests.conftest import SMALL
from verification.compare import connect, difference
from verification.oracle import ORACLE

NO_SQL = {"clusters", "cluster_summary", "cluster_curves"}


@pytest.fixture(scope="module")
def sql():
    return connect(SMALL)


@pytest.fixture(scope="module")
def answers(sql):
    found = {}
    for name, text in ORACLE.items():
        result = sql.execute(text)
        found[name] = ([c[0] for c in result.description], result.fetchall())
    return found


@pytest.fixture(scope="module")
def scattered(spark):
    """Every operator with tracks in many small pieces."""
    p = replace(ACTIVITY_PARAMS, chunk_rows=16, join_chunk=8)
    return Workspace(spark, SMALL, p)


def test_every_query_has_sql():
    assert set(catalog.CATALOG) - set(ORACLE) == NO_SQL
    assert set(ORACLE) <= set(catalog.CATALOG) <= set(contract.queries())


@pytest.mark.parametrize("name", list(catalog.CATALOG))
def test_query_equals_sql(spark, answers, name):
    df = contract.queries()[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    if name not in NO_SQL:
        assert difference(df.columns, rows, *answers[name]) is None


HEAVY = ["l1_master", "l2_conflict_events", "l2_baseline_events", "mec_match", "mec_basic_stats", "threshold_sweep",
         "l2_describe", "aligned_curve", "lag_stats", "dq_monotonic", "dq_ttc_quantiles", "l2_overall"]


@pytest.mark.parametrize("name", HEAVY)
def test_layout_for_large_inputs_gives_the_same(scattered, answers, name):
    df = catalog.neat(catalog.CATALOG[name](scattered))
    assert difference(df.columns, [tuple(r) for r in df.collect()], *answers[name]) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 3


def test_costs_are_made_without_the_wide_frame_tables(spark):
    narrow, wide = (Workspace(spark, SMALL, ACTIVITY_PARAMS) for _ in range(2))
    costs = sorted(map(str, narrow.mec.collect()))
    assert "l1" not in narrow._tables and "smoothed" not in narrow._tables and len(narrow.event_frames.columns) < 20
    assert narrow.event_frames.exceptAll(wide.l1.select(narrow.event_frames.columns)).count() == 0
    assert narrow.event_frames.count() == wide.l1.count() and wide.event_frames is wide.l1
    assert costs == sorted(map(str, wide.mec.collect()))


def test_workspace_is_shared_and_renewed(spark):
    one = open_workspace(spark, SMALL)
    assert open_workspace(spark, SMALL) is one
    one.raw
    location = spark._jvm.org.apache.hadoop.fs.Path(one.raw.tracks.inputFiles()[0].rsplit("/", 1)[0])
    location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)
    assert open_workspace(spark, SMALL) is not one


def test_frame_numbers_with_one_dominant_user(spark):
    events = spark.range(3000).selectExpr(
        "id AS event_id", "IF(id % 3 = 0, id % 5, 7) AS user_id", "timestamp_seconds(id % 11) AS ts", "'view' AS event_type",
        "1.0D AS value")
    found = sorted((r.event_id, r.frame) for r in activity_frames(events).collect())
    rows = events.collect()
    place = {}
    for user in {r.user_id for r in rows}:
        own = sorted((r.ts, r.event_id) for r in rows if r.user_id == user)
        place |= {event: n for n, (_, event) in enumerate(own, 1)}
    assert found == sorted(place.items())
