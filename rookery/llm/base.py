"""What the training-data operators share: reading tables, tables written for
reuse, the label sample and small Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared

#: ASCII white space, as in the pattern [^\x20\x09-\x0D]+ for a word. bytes.split() splits at the same six.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch, where the session has only Spark's default of 64 MB: a worker holds a batch, its copy as Python objects and its result.
BATCH_BYTES = "16m"


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a table in the shared folder and reread, in Arrow batches of bounded size."""
    small_batches(df.sparkSession)
    return shared.stage(df, name)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """crc32(doc_id as text) mod 3 is 1; null ids are never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def label_sample(labels: DataFrame, target: str, max_rows: int) -> DataFrame:
    """(doc_id, label) of at most `max_rows` rows that training may see, the
    same on every run: those with the smallest hash of their id. Rows with a
    null id or label, and those held out, are left out; of repeated ids the
    largest label stays."""
    seen = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out())
    one = seen.groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def binary(column: pa.Array) -> pa.Array:
    """A string column as bytes, without copying; nulls become empty."""
    return column.cast(pa.binary()).fill_null(b"")


def values(column: pa.Array, rows: int = 512) -> Iterator[bytes]:
    """The texts of a column as bytes, few at a time."""
    for at in range(0, len(column), rows):
        yield from binary(column.slice(at, rows)).to_pylist()


def by_bytes(values: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of `values` that hold about `limit` bytes each."""
    start = size = 0
    for i, v in enumerate(values):
        size += len(v) + 64
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(values):
        yield start, len(values)


def keep_rows(df: DataFrame, flags: Callable[[pa.RecordBatch, Callable[[str], int]], np.ndarray]) -> DataFrame:
    """The rows of `df` for which `flags` (of a batch, and a column's place by name) is true, all columns as they are."""
    at = df.columns.index

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(np.asarray(flags(batch, at), bool)))

    return df.mapInArrow(kept, df.schema)
