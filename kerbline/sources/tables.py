"""Stage tables and result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from kerbline.sources.raw import only_recordings
from kerbline.sources.versions import UNVERSIONED, VERSION, WHOLE, Versions


def write_recordings(df: DataFrame, path: str, ids: Sequence[int] | None = None, column: str = "recordingId") -> None:
    """Parquet partitioned by recording; replaces the recordings that are written and leaves the others.

    ``ids`` are the recordings that were asked for: their former rows go, also where there are no new ones. Without
    ``ids`` the table is replaced whole. The new rows are written to a folder of their own and take the place of the former ones at
    once (see ``versions``), so that a write that fails changes nothing and ``df`` may read the table itself. Rows are
    rebalanced by recording first: few files per recording, and a recording that holds a large share of all rows
    is split over several writers.
    """
    versions = Versions(df.sparkSession, path)
    number, parts = versions.current()
    parts = parts or versions.adopted(column)
    folder = versions.begin()
    df.hint("rebalance", column).write.partitionBy(column).parquet(f"{path}/{folder}")
    gone = parts if ids is None else {str(int(i)) for i in ids}
    kept = {part: place for part, place in parts.items() if part not in gone}
    versions.publish(kept | {part: folder for part in versions.parts_of(folder, column)} | {WHOLE: folder}, number)


def read_recordings(spark: SparkSession, path: str, schema: T.StructType | None = None,
                    ids: Sequence[int] | None = None, strict: bool = False,
                    columns: Sequence[str] | None = None, column: str = "recordingId") -> DataFrame:
    """Read a partitioned table: pruned to recordings and columns, in the schema's column order.

    A folder of recordings without versions, as other programs write it, is read as it is.
    """
    _, parts = Versions(spark, path).current()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if parts:
        # The last write's folder stands for a table without rows, so that its columns are known.
        table = None
        for versioned in (True, False):
            places = [f"{path}/{folder}/{column}={part}" for part, folder in sorted(parts.items())
                      if part != WHOLE and (folder != UNVERSIONED) == versioned]
            if places:
                read = reader.option("basePath", path).parquet(*places).drop(VERSION)
                table = read if table is None else table.unionByName(read)
        if table is None:
            table = reader.parquet(f"{path}/{parts[WHOLE]}")
    else:
        table = reader.parquet(path)
    df = only_recordings(table, ids, strict)
    if columns is not None:
        return df.select(*columns)
    return df if schema is None else df.select(*[f.name for f in schema.fields if f.name in df.columns])


def write_table(df: DataFrame, path: str) -> None:
    """A table as a whole, published at once (see ``versions``)."""
    versions = Versions(df.sparkSession, path)
    number, _ = versions.current()
    folder = versions.begin()
    df.write.parquet(f"{path}/{folder}")
    versions.publish({WHOLE: folder}, number)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    _, parts = Versions(spark, path).current()
    return spark.read.parquet(f"{path}/{parts[WHOLE]}" if parts else path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of CSV files with header, as many as the table has partitions."""
    df.write.mode(mode).option("header", True).csv(path)
