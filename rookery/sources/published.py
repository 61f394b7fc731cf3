"""Tables that readers see whole: a new version is written aside and then named at once.

A version is a folder that Spark's own committer fills; files are sized by bytes. What readers
follow is one small file that lists the folders of the current version, replaced by a rename as the
last step. A write that fails before it leaves the old version as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a file, about (as Spark sees them before compression).
FILE_BYTES = 128 << 20
_CURRENT = "current.json"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _parts(spark: SparkSession, path: str) -> list[str]:
    at, fs = _fs(spark, f"{path}/{_CURRENT}")
    return json.loads(spark.read.text(str(at)).first()[0]) if fs.exists(at) else []


def _name(spark: SparkSession, path: str, parts: list[str]) -> None:
    """Makes these folders the current version."""
    aside, fs = _fs(spark, f"{path}/_next-{uuid.uuid4().hex}")
    out = fs.create(aside)
    out.write(bytearray(json.dumps(parts).encode()))
    out.close()
    current, _ = _fs(spark, f"{path}/{_CURRENT}")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.toUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = rename
    context.rename(aside, current, options)


def _written(df: DataFrame, path: str, file_bytes: int) -> str:
    spark, part = df.sparkSession, f"part-{uuid.uuid4().hex}"
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(file_bytes))
    try:
        df.hint("rebalance").write.parquet(f"{path}/{part}")
    finally:
        spark.conf.set(name, before)
    return part


def publish(df: DataFrame, path: str, *, file_bytes: int = FILE_BYTES) -> None:
    """Replaces the table at `path` by `df`, which may be read from it."""
    old = _parts(df.sparkSession, path)
    _name(df.sparkSession, path, [_written(df, path, file_bytes)])
    for part in old:  # readers that began before hold the list of its files; on a busy table leave the old folders to a later sweep
        at, fs = _fs(df.sparkSession, f"{path}/{part}")
        fs.delete(at, True)


def add_chunk(df: DataFrame, path: str, *, file_bytes: int = FILE_BYTES) -> None:
    """Adds rows to the table at `path`; one writer at a time."""
    part = _written(df, path, file_bytes)
    _name(df.sparkSession, path, [*_parts(df.sparkSession, path), part])


def compact(spark: SparkSession, path: str, *, file_bytes: int = FILE_BYTES) -> None:
    """All chunks of a table in files of full size."""
    publish(published(spark, path), path, file_bytes=file_bytes)


def published(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table."""
    parts = _parts(spark, path)
    if not parts:
        raise ValueError(f"nothing is published at {path}")
    return spark.read.parquet(*(f"{path}/{p}" for p in parts))
