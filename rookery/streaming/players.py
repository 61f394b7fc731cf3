"""Players' features kept up as games land: Spark's own state holds each player's sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.features import player_features


def start_features(games: DataFrame, out: str, checkpoint: str, min_games: int = 20) -> StreamingQuery:
    """Adds to the table `out`, under each batch's number, the features of the players that it changed. There
    is no watermark: a game that comes late counts like any other, and state is a row of sums a player. A
    batch that comes again replaces itself. `current_features` has each player's latest."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    changed = player_features(games, min_games).writeStream.outputMode("update")
    return changed.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_features(spark: SparkSession, out: str) -> DataFrame:
    """Each player's features as of the last batch that changed them: equal to `player_features` of all games so far."""
    rows = spark.read.parquet(out)
    columns = [c for c in rows.columns if c not in ("username", "batch")]
    latest = rows.groupBy("username").agg(F.max_by(F.struct(*columns), "batch").alias("f"))
    return latest.select("username", "f.*")
