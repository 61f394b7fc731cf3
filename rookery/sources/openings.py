"""The dimension of openings: name, and the colour whose choice it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import last_mover, ply_count
from ..functions.board import legal_lines
from .published import publish, published


def read_openings(spark: SparkSession, path: str) -> DataFrame:
    """(eco, name, pgn) of tab-separated files with a header; lines with fewer fields are dropped."""
    return spark.read.csv(path, sep="\t", header=True, quote="", schema="eco string, name string, pgn string", mode="DROPMALFORMED")


def openings_dim(openings: DataFrame, *, replay: bool = True) -> DataFrame:
    """(name, color): of each name its shortest line, the first of equally short ones in order of
    code and line. Lines are replayed on a board, and those with a move that isn't legal are left out;
    without `replay` those with a token that isn't a move, by column expressions alone."""
    rows = legal_lines(openings.select("name", "eco", "pgn")) if replay else openings.select("name", "eco", "pgn", last_mover("pgn").alias("color"), ply_count("pgn").alias("plies")).where("color is not null")
    first = F.row_number().over(Window.partitionBy("name").orderBy("plies", "eco", "pgn"))
    return rows.withColumn("rn", first).where("rn = 1").select("name", "color")


def write_openings(dim: DataFrame, path: str) -> None:
    """The dimension at rest: readers see the old one or the new one."""
    publish(dim.select("name", "color"), path)


def stored_openings(spark: SparkSession, path: str) -> DataFrame:
    return published(spark, path)
