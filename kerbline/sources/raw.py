"""Raw trajectory tables as delivered: CSV files per recording."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from kerbline.params import Params
from kerbline.schemas import RECORDING_META, TRACKS, TRACKS_META


@dataclass(frozen=True)
class RawTables:
    """Frames and vehicle metadata carry ``recordingId``; recordings carry it as ``id``."""

    recordings: DataFrame
    tracks_meta: DataFrame
    tracks: DataFrame


def select_recordings(spec: str | None) -> list[int] | None:
    """``1,2`` or ``1-3,5`` as ids; None, which is no filter, for ``all`` and for an empty specification."""
    text = (spec or "").strip()
    if not text or text.lower() == "all":
        return None
    ids: set[int] = set()
    for part in filter(None, (piece.strip() for piece in text.split(","))):
        low, dash, high = part.partition("-")
        ids.update(range(int(low), int(high) + 1) if dash else [int(low)])
    return sorted(ids)


def resolve_recordings(ids: Sequence[int] | None, test_mode: bool, p: Params = Params()) -> list[int] | None:
    """The ids asked for; else the test selection, or None for whatever is there."""
    if ids:
        return list(ids)
    return list(p.test_recordings) if test_mode else None


def only_recordings(df: DataFrame, ids: Sequence[int] | None, strict: bool = False,
                    column: str = "recordingId") -> DataFrame:
    """Keep the given recordings (partition pruning on partitioned tables).

    Missing ones are skipped, or with ``strict`` raise an error.
    """
    if ids is None:
        return df
    kept = df.filter(F.col(column).isin([int(i) for i in ids]))
    if strict:
        wanted = df.sparkSession.createDataFrame([(int(i),) for i in ids], T.StructType(
            [T.StructField(column, T.IntegerType())]))
        # One row per recording meets the list, which is no longer than what was asked for.
        missing = wanted.distinct().join(kept.select(column).distinct(), column, "left_anti").orderBy(column).collect()
        if missing:
            raise FileNotFoundError(f"recordings not found: {[row[0] for row in missing]}")
    return kept


def _headers(spark: SparkSession, folder: str, suffix: str, ids: Sequence[int] | None) -> dict[str, list[str]]:
    """The files of a kind by their header line. Of each file only the beginning is read, on the driver."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if ids is None:
        files = system.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/*_{suffix}.csv")) or []
        paths = [status.getPath() for status in files]
    else:
        paths = [jvm.org.apache.hadoop.fs.Path(f"{folder}/{int(i):02d}_{suffix}.csv") for i in ids]
    found: dict[str, list[str]] = {}
    for path in paths:
        if not system.exists(path):
            raise FileNotFoundError(f"{path} does not exist")
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(system.open(path), "UTF-8"))
        try:
            found.setdefault((lines.readLine() or "").strip(), []).append(path.toString())
        finally:
            lines.close()
    if not found:
        raise FileNotFoundError(f"{folder}/*_{suffix}.csv does not exist")
    return found


def _csv(spark: SparkSession, schema: T.StructType, folder: str, suffix: str,
         ids: Sequence[int] | None, numbered: bool = False) -> DataFrame:
    """The columns that the files have, in the types of ``schema``; those it does not know are text.

    Files of one header are read together; a column that only some headers have is null in the other files. An empty file has
    no rows. ``numbered`` adds the recording that the file's name begins with.
    """
    known = {f.name: f.dataType for f in schema.fields}
    options = {"header": True, "nanValue": "NaN", "enforceSchema": False}
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)_", 1).cast("int")

    def read(paths: list[str]) -> DataFrame:
        names = spark.read.options(**options).csv(paths).columns
        present = T.StructType([T.StructField(c, known.get(c, T.StringType())) for c in names])
        df = spark.read.schema(present).options(**options).csv(paths)
        doubles = [f.name for f in present.fields if f.dataType == T.DoubleType()]
        df = df.withColumn("recordingId", number) if numbered else df
        return df.withColumns({c: F.nanvl(c, F.lit(None)) for c in doubles})

    parts = [read(paths) for header, paths in sorted(_headers(spark, folder, suffix, ids).items()) if header]
    if not parts:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("recordingId", T.IntegerType())]) if numbered else schema)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_recording_meta(spark: SparkSession, folder: str, ids: Sequence[int] | None = None) -> DataFrame:
    return _csv(spark, RECORDING_META, folder, "recordingMeta", ids)


def read_tracks_meta(spark: SparkSession, folder: str, ids: Sequence[int] | None = None) -> DataFrame:
    return _csv(spark, TRACKS_META, folder, "tracksMeta", ids, numbered=True)


def read_tracks(spark: SparkSession, folder: str, ids: Sequence[int] | None = None) -> DataFrame:
    return _csv(spark, TRACKS, folder, "tracks", ids, numbered=True)


def read_raw(spark: SparkSession, folder: str, ids: Sequence[int] | None = None) -> RawTables:
    """All recordings of a folder, or the given ones; a missing file is an error."""
    return RawTables(
        read_recording_meta(spark, folder, ids),
        read_tracks_meta(spark, folder, ids),
        read_tracks(spark, folder, ids),
    )
