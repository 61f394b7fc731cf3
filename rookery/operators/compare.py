"""Comparisons: players, clusters, labellings, samples; and the answers of a service."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stage
from .rankings import mutual_openings


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, feature, value)."""
    return df.select(*keys, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(list(keys), list(columns), "feature", "value")


def feature_delta(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, a, b, delta) of two one-row tables, the largest difference first."""
    left, right = (unpivot(x, [], columns).withColumnRenamed("value", n) for x, n in ((a, "a"), (b, "b")))
    return left.join(right, "feature").withColumn("delta", F.col("a") - F.col("b")).orderBy(F.abs("delta").desc(), "feature")


def delta_to_means(players: DataFrame, summary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(username, feature, user, cluster_mean, delta) of players (username, cluster, features) against a `cluster_summary`."""
    user = unpivot(players, ["username", "cluster"], columns).withColumnRenamed("value", "user")
    means = unpivot(summary, ["cluster"], columns).withColumnRenamed("value", "cluster_mean")
    return user.join(means, ["cluster", "feature"]).select("username", "feature", "user", "cluster_mean", (F.col("user") - F.col("cluster_mean")).alias("delta"))


def cluster_summary(clustered: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(cluster, size, the mean of each column)."""
    return clustered.groupBy("cluster").agg(F.count("*").alias("size"), *(F.avg(c).alias(c) for c in columns))


def z_scores(summary: DataFrame, columns: Sequence[str], key: str = "cluster") -> DataFrame:
    """Each column of a summary (a row a cluster) less its mean over clusters, by their sample deviation; null where that is 0."""
    over = Window.partitionBy()
    return summary.select(key, *(F.try_divide(F.col(c) - F.avg(c).over(over), F.stddev_samp(c).over(over)).alias(c) for c in columns))


def accuracy_by_cluster(clustered: DataFrame, min_analyzed: int = 3, band: tuple[float, float] | None = None) -> DataFrame:
    """(cluster, avg_acpl, avg_blunder_rate, n_players) of players with enough analysed games, and a rating within `band`."""
    rows = clustered.where(F.col("n_analyzed_games") >= min_analyzed)
    rows = rows if band is None else rows.where(F.col("avg_rating").between(*band))
    return rows.groupBy("cluster").agg(F.avg("acpl").alias("avg_acpl"), F.avg("blunder_rate").alias("avg_blunder_rate"), F.count("*").alias("n_players"))


def crosstab(left: DataFrame, right: DataFrame, key: str = "username") -> DataFrame:
    """(a, b, n) of left (key, a) and right (key, b)."""
    return left.select(key, "a").join(right.select(key, "b"), key).groupBy("a", "b").agg(F.count("*").alias("n"))


def row_shares(cross: DataFrame) -> DataFrame:
    """`crosstab` with share: n over its row's sum."""
    return cross.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("a")))


def purity(cross: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each row its dominant column and share (a, dominant, share); and the mean of shares (mean_purity)."""
    best = row_shares(cross).groupBy("a").agg(F.max(F.struct("share", F.col("b").alias("b"))).alias("m")).select("a", F.col("m.b").alias("dominant"), F.col("m.share").alias("share"))
    return best, best.agg(F.avg("share").alias("mean_purity"))


def overlap(a: DataFrame, b: DataFrame, key: str = "username") -> DataFrame:
    """One row: how many keys are in `a`, in `b` and in both."""
    keys = a.select(key).distinct().withColumn("in_a", F.lit(1)).join(b.select(key).distinct().withColumn("in_b", F.lit(1)), key, "full")
    return keys.agg(F.count("in_a").alias("a"), F.count("in_b").alias("b"), F.count(F.col("in_a") + F.col("in_b")).alias("both"))


def matched_summaries(mapping: DataFrame, a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a_cluster, b_cluster, feature, a, b) of two summaries along a mapping (a_cluster, b_cluster)."""
    left = unpivot(a, ["cluster"], columns).toDF("a_cluster", "feature", "a")
    right = unpivot(b, ["cluster"], columns).toDF("b_cluster", "feature", "b")
    return mapping.join(left, "a_cluster").join(right, ["b_cluster", "feature"]).select("a_cluster", "b_cluster", "feature", "a", "b")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, n, nulls, mean, std, min, q25, q50, q75, max)."""
    rows = unpivot(df, [], columns)
    told = quantiles(rows, (0.25, 0.5, 0.75))
    rows = rows.groupBy("feature")
    found = rows.agg(F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")).join(told, "feature", "left")
    return found.select("feature", "n", "nulls", "mean", "std", "min", *(F.col("q")[i].alias(f"q{n}") for i, n in enumerate((25, 50, 75))), "max")


def quantiles(rows: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(feature, q) of rows (feature, value): exact quantiles, interpolated between neighbouring ranks; nulls don't count.

    Values are counted, the counts go to ranges of (feature, value), and a range's total says
    which ranks lie in it. Only the ranges that hold a rank that is asked for are opened, each by itself:
    a feature is spread over as many tasks as its values fill, and a value that very many rows have is one count."""
    counted = rows.where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("c"))
    dealt = stage(counted.repartitionByRange("feature", "value").withColumn("part", F.spark_partition_id()), "ranges")
    ranges = dealt.groupBy("feature", "part").agg(F.sum("c").alias("n"))  # two a task, about
    along = Window.partitionBy("feature").orderBy("part")
    ends = ranges.withColumn("upto", F.sum("n").over(along)).withColumn("all", F.sum("n").over(Window.partitionBy("feature")))
    place = (F.col("all") - 1) * F.col("share")
    asked = ends.withColumn("share", F.explode(F.array(*map(F.lit, sorted(set(shares))))))
    asked = asked.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place))))).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    asked = asked.select("feature", "part", "share", "rank", (place - F.floor(place)).alias("between"), (F.col("upto") - F.col("n")).alias("before"))
    asked = stage(asked, "ranks")  # two rows a feature and share
    parts = [r["part"] for r in asked.select("part").distinct().collect()]
    opened = dealt.where(F.col("part").isin(parts)).join(F.broadcast(asked.select("feature", "part", "before").distinct()), ["feature", "part"])
    within = Window.partitionBy("feature", "part").orderBy("value")
    opened = opened.withColumn("upto", F.col("before") + F.sum("c").over(within))
    found = opened.join(F.broadcast(asked.drop("before")), ["feature", "part"]).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
    each = found.groupBy("feature", "share").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.max("between").alias("between"))
    each = each.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("share", F.col("low") + (F.col("high") - F.col("low")) * F.col("between")))).alias("q"))
    return each.select("feature", F.array(*(F.col("q")[F.lit(s)] for s in shares)).alias("q"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin from 1, low, high, n) over `bins` of equal width from the least to the largest value."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    placed = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(F.least(F.lit(bins), F.floor((F.col(column) - F.col("lo")) / width).cast("int") + 1))
    rows = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends))  # one row
    return rows.groupBy(placed.alias("bin"), "lo", "hi").agg(F.count("*").alias("n")).select("bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("low"), (F.col("lo") + F.col("bin") * width).alias("high"), "n")


def counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), by)


def at_least(df: DataFrame, by: str, thresholds: Sequence[int]) -> DataFrame:
    """(threshold, n): how many values of `by` have that many rows or more."""
    per = df.groupBy(by).agg(F.count("*").alias("c"))
    one = per.agg(*(F.count_if(F.col("c") >= t).alias(str(t)) for t in thresholds))
    return one.unpivot([], [str(t) for t in thresholds], "threshold", "n").withColumn("threshold", F.col("threshold").cast("int"))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


#: Games that an answer may be asked to rest on, at least and at most.
GAMES_ASKED = (20, 200)


def latest_games(games: DataFrame, asked: Column | int) -> DataFrame:
    """Of each player's games the latest, as many as `asked` (kept within GAMES_ASKED); ties by game."""
    order = Window.partitionBy("username").orderBy(F.col("created_at").desc_nulls_last(), "game_id")
    n = clamp(asked if isinstance(asked, Column) else F.lit(asked), *GAMES_ASKED)
    return games.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def recommend_answer(player: DataFrame, n_games: DataFrame, document: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(json) for a player (username, avg_rating, cluster, features), with n_games
    (username, n_games_used) and the recommendation document: the cluster's openings and how the player differs from it."""
    cluster = document.select(F.explode("clusters").alias("c")).select("c.*")
    rows = player.join(n_games, "username").join(cluster.withColumnRenamed("avg_rating", "c_rating"), F.col("cluster") == F.col("id"))
    compared = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("user"), F.col("feature_means")[c].alias("cluster_mean"), (F.col(c) - F.col("feature_means")[c]).alias("delta")) for c in columns))
    brief = F.struct("id", "name", "blurb", "size", F.col("c_rating").alias("avg_rating"), "accuracy")
    return rows.select(F.to_json(F.struct("username", F.lit("cluster").alias("mode"), "n_games_used", F.col("avg_rating").alias("user_rating"), brief.alias("cluster"), "top_openings", compared.alias("feature_comparison"))).alias("json"))


def knn_answer(player: DataFrame, neighbours: DataFrame, ranked: DataFrame) -> DataFrame:
    """(json) for a player (username, avg_rating, n_games_used), neighbours (username, avg_rating, dist) and their ranking."""
    near = neighbours.agg(F.count("*").alias("k"), F.min("avg_rating").alias("lo"), F.max("avg_rating").alias("hi"), F.avg("avg_rating").alias("mean"))
    item = F.struct("name", "n", "score_residual")
    tops = ranked.agg(*(F.transform(F.sort_array(F.collect_list(F.when(F.col("color") == c, F.struct("rank", item.alias("o"))))), lambda x: x["o"]).alias(c) for c in ("white", "black")))
    blurb = F.format_string("Openings of the %d players nearest in style (ratings %.0f to %.0f, mean %.0f).", "k", "lo", "hi", "mean")
    cluster = F.struct(F.lit(None).cast("int").alias("id"), F.lit("Your style neighbourhood").alias("name"), blurb.alias("blurb"), F.col("k").alias("size"), F.col("mean").alias("avg_rating"), F.lit(None).cast("string").alias("accuracy"))
    rows = player.crossJoin(F.broadcast(near)).crossJoin(F.broadcast(tops))  # a row each
    answer = F.struct("username", F.lit("knn").alias("mode"), "n_games_used", F.col("avg_rating").alias("user_rating"), cluster.alias("cluster"), F.struct("white", "black").alias("top_openings"), F.expr("cast(array() as array<string>)").alias("feature_comparison"))
    return rows.select(F.to_json(answer, {"ignoreNullFields": "false"}).alias("json"))


def versus(a: DataFrame, b: DataFrame, table: DataFrame, columns: Sequence[str], top_n: int = 6) -> DataFrame:
    """(json) comparing two players (one row each: username, avg_rating, n_games,
    cluster, name, blurb, features): features by difference, and the families that suit
    both, each way round, from a `residual_table` of clusters."""

    def brief(p: str) -> Column:
        return F.struct(*(F.col(f"{p}_{c}").alias(n) for c, n in (("username", "username"), ("avg_rating", "rating"), ("n_games", "n_games"))), F.struct(*(F.col(f"{p}_{c}").alias(n) for c, n in (("cluster", "id"), ("name", "name"), ("blurb", "blurb")))).alias("cluster"))

    left, right = (x.select(*(F.col(c).alias(f"{p}_{c}") for c in x.columns)) for x, p in ((a, "a"), (b, "b")))
    row = left.crossJoin(F.broadcast(right))  # a row each
    ways = {"a_white_b_black": ("a", "b"), "b_white_a_black": ("b", "a")}
    for name, (w, k) in ways.items():
        pair = row.select(F.col(f"{w}_cluster").alias("white_cohort"), F.col(f"{k}_cluster").alias("black_cohort"))
        item = F.struct("family", "white_rel", "black_rel", "combined", "both_positive")
        best = mutual_openings(table, pair, top_n).agg(F.sort_array(F.collect_list(F.struct("rank", item.alias("o")))).alias("o"))
        row = row.crossJoin(F.broadcast(best.select(F.transform("o", lambda x: x["o"]).alias(name))))
    deltas = F.array(*(F.struct((-F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))).alias("by"), F.lit(c).alias("feature"), F.col(f"a_{c}").cast("double").alias("a"), F.col(f"b_{c}").cast("double").alias("b"), (F.col(f"a_{c}") - F.col(f"b_{c}")).alias("delta")) for c in columns))
    compared = F.transform(F.sort_array(deltas), lambda x: F.struct(x["feature"].alias("feature"), x["a"].alias("a"), x["b"].alias("b"), x["delta"].alias("delta")))
    return row.select(F.to_json(F.struct(brief("a").alias("player_a"), brief("b").alias("player_b"), compared.alias("feature_comparison"), F.struct(*ways).alias("matchups"))).alias("json"))
