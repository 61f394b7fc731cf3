"""From raw documents to packed sequences: toxicity, quality, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns the columns of documents, but the last, which returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm.base import stage, table
from rookery.llm.minhash import near_duplicates
from rookery.llm.mixing import mix
from rookery.llm.packing import pack, token_pieces
from rookery.llm.quality_fm import drop_low_quality
from rookery.llm.toxicity import drop_toxic

TOKENIZER = "word_bpe_49k.json"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are predicted toxic."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are predicted low."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """`names`, longer where `docs` has a column of that name already."""
    taken = {c.lower() for c in docs.columns}
    while taken & {n.lower() for n in names}:
        names = tuple(f"{n}_" for n in names)
    return list(names)


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """`docs` with a number for each row, written: whoever reads it sees the same ones."""
    return stage(docs.withColumn(row, F.monotonically_increasing_id()), "rows")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id (of
    those without an id, or of one id, the first). Rows are told apart by a number of
    their own: ids may repeat or be null, and null texts are near nothing."""
    (row,) = fresh(docs, "row")
    rows = numbered(docs, row)
    ids = rows.select(F.col(row).alias("row"), F.col("doc_id").alias("id"))
    groups = near_duplicates(rows.select(F.col(row).alias("row"), "text"), id_column="row").select(F.col("doc_id").alias("row"), "component_id").join(ids, "row")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))["row"].alias(row))
    return rows.join(first.select(row), row, "left_semi").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    row, times, time = fresh(docs, "row", "times", "time")
    rows = numbered(docs, row)
    mixed = mix(rows.select(F.col(row).alias("row"), "text", "source"), id_column="row").select(F.col("doc_id").alias(row), F.col("copies").alias(times)).where(F.col(times) > 0)
    return rows.join(mixed, row).withColumn(time, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return pack(token_pieces(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Classifiers, sketches and random rounding aren't SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
