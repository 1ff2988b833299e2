"""Intermediate tables: written once to shared storage, read back with pruning, pushdown and known sizes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OWNER: ContextVar[str | None] = ContextVar("owner", default=None)
_OWNED: dict[tuple[str, str], list[str]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, or the context's checkpoint folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return configured.rstrip("/")


def delete_folder(spark: SparkSession, path: str) -> None:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder. What is written there goes when its owner starts anew, or with the session."""
    path = f"{scratch_dir(spark)}/kerbline-{label}-{uuid.uuid4().hex}"
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(location)
    if owner := _OWNER.get():
        _OWNED.setdefault((spark.sparkContext.applicationId, owner), []).append(path)
    return path


@contextmanager
def replacing(spark: SparkSession, owner: str) -> Iterator[None]:
    """Tables written inside belong to ``owner``; those of its last time are deleted first.

    So a query that is run again takes no more room, but a DataFrame it returned before can't be read any longer.
    """
    for path in _OWNED.pop((spark.sparkContext.applicationId, owner), []):
        delete_folder(spark, path)
    token = _OWNER.set(owner)
    try:
        yield
    finally:
        _OWNER.reset(token)


@contextmanager
def kept() -> Iterator[None]:
    """Tables written inside stay until the session ends, whoever asked for them."""
    token = _OWNER.set(None)
    try:
        yield
    finally:
        _OWNER.reset(token)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the scratch folder and return a reader of it; the lineage ends here."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
