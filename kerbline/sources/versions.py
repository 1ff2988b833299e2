"""Tables in versions: data goes to a new folder, and a manifest that is renamed into place makes it the table.

    <table>/v=<id>/...          data of one write
    <table>/_manifest-<number>  which folder holds each part; the greatest number counts

A write that fails leaves a folder that no manifest names. Readers see the table as it was before or as it is after; what the
manifest before the last one names stays until the next write, for readers that have already started. Two writes at
once: the second to publish finds its number taken and fails. The rename must be atomic, as it is on HDFS and local disks.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession

VERSION = "v"
WHOLE = ""
#: Partitions that lie in the table's own folder, as other programs write them.
UNVERSIONED = "."


class Versions:
    """The versions of the table at a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self.system = self._place(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _place(self, name: str):
        return self._fs.Path(name)

    def _names(self, folder: str) -> list[str]:
        place = self._place(folder)
        return [s.getPath().getName() for s in self.system.listStatus(place)] if self.system.exists(place) else []

    def _numbers(self) -> list[int]:
        return sorted(int(m[1]) for m in map(re.compile(r"_manifest-(\d+)").fullmatch, self._names(self.path)) if m)

    def _read(self, number: int) -> dict[str, str]:
        stream = self.system.open(self._place(f"{self.path}/_manifest-{number}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> tuple[int, dict[str, str]]:
        """Number and parts of the table; 0 and none where nothing has been published."""
        numbers = self._numbers()
        return (numbers[-1], self._read(numbers[-1])) if numbers else (0, {})

    def adopted(self, column: str) -> dict[str, str]:
        """The parts of a folder of partitions without versions."""
        return {part: UNVERSIONED for part in self.parts_of(UNVERSIONED, column)}

    def begin(self) -> str:
        """The name of a new folder for data."""
        return f"{VERSION}={uuid.uuid4().hex}"

    def parts_of(self, folder: str, column: str) -> list[str]:
        """The partitions that a write made."""
        return [n.partition("=")[2] for n in self._names(f"{self.path}/{folder}") if n.startswith(f"{column}=")]

    def publish(self, parts: dict[str, str], after: int) -> None:
        """Make ``parts`` the table, if ``after`` still is its number; then delete what only older versions name."""
        draft, final = (self._place(f"{self.path}/{n}") for n in (f"_draft-{uuid.uuid4().hex}", f"_manifest-{after + 1}"))
        stream = self.system.create(draft, False)
        stream.write(bytearray(json.dumps(parts, sort_keys=True).encode()))
        stream.close()
        context = self._fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self.system.getUri(),
                                                      self.spark._jsc.hadoopConfiguration())
        # Without options a rename fails where the target is there.
        context.rename(draft, final, self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 0))
        self._sweep(after + 1)

    def _sweep(self, number: int) -> None:
        used = {folder for n in (number, number - 1) if n in self._numbers() for folder in self._read(n).values()}
        for older in self._numbers():
            if older < number - 1:
                for folder in set(self._read(older).values()) - used - {UNVERSIONED}:
                    self.system.delete(self._place(f"{self.path}/{folder}"), True)
                self.system.delete(self._place(f"{self.path}/_manifest-{older}"), False)
