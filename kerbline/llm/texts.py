"""What the operators share: table reading, word splitting, and Python over slices of Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)
SLICE_ROWS = 128
OUT_ROWS = 2000
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of one of the given tables; no others are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is of the fold kept from learning: crc32 of the id as text, mod 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def map_rows(df: DataFrame, schema: str, start: Callable[[], Callable[[list[tuple]], Iterable[tuple]]]) -> DataFrame:
    """Rows through Python, a slice at a time.

    ``start`` is called once per task and returns the function that turns a slice of rows (tuples in the order of
    ``df``'s columns) into output rows. Memory is bounded by an Arrow batch and a slice, not by the partition.
    """
    target = to_arrow_schema(StructType.fromDDL(schema))

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[] for _ in target]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    def run(batches):
        handle = start()
        out: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                out.extend(handle(list(zip(*(c.to_pylist() for c in part.columns)))))
                if len(out) >= OUT_ROWS:
                    yield pack(out)
                    out = []
        if out:
            yield pack(out)

    return df.mapInArrow(run, schema)
