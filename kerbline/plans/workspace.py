"""Stage tables of one input folder, each built once per session and read by everything after it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from kerbline.operators.store import kept, materialize
from kerbline.params import Params
from kerbline.plans.events import baseline_events, conflict_events
from kerbline.plans.l1 import event_frames, piece_table, smoothed_frames, working_frames
from kerbline.plans.mec import match_baselines
from kerbline.sources.activity import ACTIVITY_PARAMS, read_activity
from kerbline.sources.raw import RawTables

_OPEN: dict[tuple, "Workspace"] = {}


@dataclass
class Workspace:
    spark: SparkSession
    folder: str
    p: Params
    _tables: dict[str, object] = field(default_factory=dict)
    _places: list[str] = field(default_factory=list)

    def table(self, name: str, build):
        """The table of that name, built at its first use."""
        if name not in self._tables:
            with kept():
                self._tables[name] = built = build()
            for frame in (built.tracks, built.tracks_meta) if isinstance(built, RawTables) else (built,):
                if isinstance(frame, DataFrame) and (files := frame.inputFiles()):
                    self._places.append(files[0].rpartition("/")[0])
        return self._tables[name]

    @property
    def raw(self) -> RawTables:
        return self.table("raw", lambda: read_activity(self.spark, self.folder, self.p))

    @property
    def pieces(self) -> DataFrame:
        return self.table("pieces", lambda: piece_table(self.raw, self.p))

    @property
    def smoothed(self) -> DataFrame:
        return self.table("smoothed", lambda: smoothed_frames(self.raw, self.p, self.pieces))

    @property
    def l1(self) -> DataFrame:
        return self.table("l1", lambda: materialize(working_frames(self.raw, self.p, self.smoothed), "l1"))

    @property
    def event_frames(self) -> DataFrame:
        """What the event and cost stages read: L1 if it is there, else its few columns that these need."""
        if "l1" in self._tables:
            return self.l1
        return self.table("event-frames", lambda: materialize(
            event_frames(self.raw, self.p, self.pieces, self._tables.get("smoothed")), "event-frames"))

    @property
    def conflicts(self) -> DataFrame:
        return self.table("conflicts", lambda: materialize(conflict_events(self.event_frames, self.p), "conflict-events"))

    @property
    def baselines(self) -> DataFrame:
        return self.table("baselines", lambda: materialize(baseline_events(self.event_frames, self.p), "baseline-events"))

    @property
    def mec(self) -> DataFrame:
        return self.table("mec", lambda: materialize(
            match_baselines(self.event_frames, self.conflicts, self.baselines, self.p), "mec"))

    def readable(self) -> bool:
        """Whether the stage tables are still there, by a look at their folders; no job is run."""
        return all(_stamp(self.spark, path) is not None for path in self._places)


def _stamp(spark: SparkSession, path: str) -> tuple | None:
    """Size and time of a file or folder; None where there is none."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = location.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(location):
        return None
    status = system.getFileStatus(location)
    return (status.getLen() if status.isFile() else system.getContentSummary(location).getLength(), status.getModificationTime())


def open_workspace(spark: SparkSession, folder: str, p: Params = ACTIVITY_PARAMS) -> Workspace:
    """The session's workspace for a folder; a new one when the input changed or scratch was cleared."""
    key = (spark.sparkContext.applicationId, folder, p)
    stamp = _stamp(spark, f"{folder}/events.parquet")
    known = _OPEN.get(key)
    if known is None or known[0] != stamp or not known[1].readable():
        _OPEN[key] = (stamp, Workspace(spark, folder, p))
    return _OPEN[key][1]
