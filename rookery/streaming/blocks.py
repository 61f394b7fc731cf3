"""Family blocks kept up as games land: sums by player, colour and family add up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..operators.rankings import family_blocks


def game_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Games as their files land."""
    return spark.readStream.schema(schema.GAMES).option("maxFilesPerTrigger", max_files).parquet(path)


def start_blocks(games: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Adds each batch's blocks to the table `out`, under the batch's number: a batch
    that comes again replaces itself, so sums count every game once. `current_blocks` adds them up."""

    def add(batch: DataFrame, number: int) -> None:
        family_blocks(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return games.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_blocks(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("username", "color", "family").agg(F.sum("n").alias("n"), F.sum("sum_sd").alias("sum_sd"))


def compact(spark: SparkSession, out: str, to: str) -> None:
    """All batches as one table of blocks."""
    current_blocks(spark, out).write.mode("overwrite").parquet(f"{to}/batch=0")


def activity(games: DataFrame, late: str = "1 day", every: str = "1 day") -> DataFrame:
    """(window, speed, games, draws) by event time, closed once the watermark has passed."""
    timed = games.withColumn("ts", F.timestamp_millis("created_at")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", every), "speed").agg(F.count("*").alias("games"), F.count_if(F.col("result") == "draw").alias("draws"))
