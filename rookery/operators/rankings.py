"""Openings of cohorts: families ranked by shrunken residual, for all cohorts in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fallback_color, family, residual, round_binary, shrink


def with_owner(games: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """Games with `family` and `owner` (whose choice the opening is): by family,
    else by full name in `dim` (name, color), else by words of the name."""
    rows = games.withColumn("family", family())
    if dim is None:
        return rows.withColumn("owner", fallback_color())
    by_family, by_name = F.broadcast(dim.toDF("family", "_by_family")), F.broadcast(dim.toDF("opening_name", "_by_name"))  # some thousand names; a shuffle by few families would be uneven
    rows = rows.join(by_family, "family", "left").join(by_name, "opening_name", "left")
    return rows.withColumn("owner", F.coalesce("_by_family", "_by_name", fallback_color())).drop("_by_family", "_by_name")


def family_blocks(games: DataFrame, members: DataFrame | None = None, dim: DataFrame | None = None) -> DataFrame:
    """(username, color, family, n, sum_sd): sums that any cohort's ranking is pooled
    from. Only games in openings of the player's own choice, with ratings on both sides."""
    rows = games if members is None else games.join(members.select("username").distinct(), "username", "left_semi")
    rows = with_owner(rows.where("opening_name is not null and opening_eco is not null"), dim).where("color = owner")
    rows = rows.select("username", "color", "family", residual().alias("sd")).where("sd is not null").repartition("username")
    return rows.groupBy("username", "color", "family").agg(F.count("*").alias("n"), F.sum("sd").alias("sum_sd"))


def _ranked(pooled: DataFrame, keys: list[str], min_games: int, top_n: int | None, k: float) -> DataFrame:
    """Of (keys, color, family, n, raw): shrunken, and the best of each (keys, color), ties by name."""
    rows = pooled.where(F.col("n") >= min_games).withColumn("score_residual", shrink(F.col("n"), F.col("raw"), k))
    order = Window.partitionBy(*keys, "color").orderBy(F.col("score_residual").desc(), "family")
    rows = rows.withColumn("rank", F.row_number().over(order))
    rows = rows if top_n is None else rows.where(F.col("rank") <= top_n)
    return rows.select(*keys, "color", "rank", F.col("family").alias("name"), "n", "score_residual")


def rank_openings(games: DataFrame, members: DataFrame, *, dim: DataFrame | None = None, min_games: int = 1000, top_n: int = 5, shrinkage_k: float = 30_000, owned: bool = True) -> DataFrame:
    """(cohort, color, rank, name, n, score_residual) for members (username, cohort): games are read once for all cohorts."""
    rows = games.where("opening_name is not null and opening_eco is not null")
    rows = with_owner(rows, dim).where("color = owner") if owned else rows.withColumn("family", family())
    rows = rows.select("username", "color", "family", residual().alias("sd"))  # no more goes to the members
    pooled = rows.join(members.select("username", "cohort").distinct(), "username").groupBy("cohort", "color", "family").agg(F.count("*").alias("n"), F.avg("sd").alias("raw"))
    return _ranked(pooled, ["cohort"], min_games, top_n, shrinkage_k)


def pool_blocks(blocks: DataFrame, members: DataFrame, *, min_games: int = 100, top_n: int = 5, shrinkage_k: float = 2000) -> DataFrame:
    """The same from `family_blocks`, for members (username, cohort): no game is read."""
    pooled = blocks.join(members.select("username", "cohort").distinct(), "username").groupBy("cohort", "color", "family")
    pooled = pooled.agg(F.sum("n").alias("n"), F.sum("sum_sd").alias("s")).withColumn("raw", F.col("s") / F.col("n"))
    return _ranked(pooled, ["cohort"], min_games, top_n, shrinkage_k)


def residual_table(games: DataFrame, members: DataFrame, *, min_games: int = 800, shrinkage_k: float = 30_000) -> DataFrame:
    """(cohort, color, family, n, resid) of all families, whoever chose them."""
    rows = games.where("opening_name is not null").select("username", "color", family().alias("family"), residual().alias("sd"))
    pooled = rows.join(members.select("username", "cohort").distinct(), "username").groupBy("cohort", "color", "family").agg(F.count("*").alias("n"), F.avg("sd").alias("raw"))
    return pooled.where(F.col("n") >= min_games).select("cohort", "color", "family", "n", shrink(F.col("n"), F.col("raw"), shrinkage_k).alias("resid"))


def centred(table: DataFrame) -> DataFrame:
    """`residual_table` with rel: the residual less the mean over the cohort's families of that colour."""
    return table.withColumn("rel", F.col("resid") - F.avg("resid").over(Window.partitionBy("cohort", "color")))


def mutual_openings(table: DataFrame, pairs: DataFrame | None = None, top_n: int = 6) -> DataFrame:
    """For pairs (white_cohort, black_cohort), or else all that share a family: the families that suit both, best together first."""
    rel = centred(table)
    white = rel.where("color = 'white'").select(F.col("cohort").alias("white_cohort"), "family", F.col("rel").alias("white_rel"))
    black = rel.where("color = 'black'").select(F.col("cohort").alias("black_cohort"), "family", F.col("rel").alias("black_rel"))
    if pairs is None:
        both = white.join(black, "family")
    else:
        both = pairs.select("white_cohort", "black_cohort").distinct().join(white, "white_cohort").join(black, ["black_cohort", "family"])
    both = both.withColumn("combined", F.col("white_rel") + F.col("black_rel")).withColumn("both_positive", (F.col("white_rel") > 0) & (F.col("black_rel") > 0))
    order = Window.partitionBy("white_cohort", "black_cohort").orderBy(F.col("combined").desc(), "family")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n).select("white_cohort", "black_cohort", "rank", "family", "white_rel", "black_rel", "combined", "both_positive")


def _openings(ranked: DataFrame, color: str) -> DataFrame:
    item = F.struct("name", "n", "score_residual")
    rows = ranked.where(F.col("color") == color).groupBy("cohort").agg(F.sort_array(F.collect_list(F.struct("rank", item.alias("o")))).alias("o"))  # `top_n` at most
    return rows.select("cohort", F.transform("o", lambda x: x["o"]).alias(color))


def recommendation_document(games: DataFrame, clustered: DataFrame, feature_columns: list[str], *, dim: DataFrame | None = None, profiles: DataFrame | None = None, top_n: int = 5, min_opening_games: int = 5000, vs_min_games: int = 800, shrinkage_k: float = 30_000, min_analyzed: int = 3) -> DataFrame:
    """One row, the document that serving reads: k, feature_columns, clusters[]. For
    `clustered` (features and cluster), and `profiles` (cluster, name, blurb) if there
    are any. All clusters come from one pass over the games for rankings and one for residuals."""
    members = clustered.select("username", F.col("cluster").alias("cohort"))
    ranked = rank_openings(games, members, dim=dim, min_games=min_opening_games, top_n=top_n, shrinkage_k=shrinkage_k)
    table = residual_table(games, members, min_games=vs_min_games, shrinkage_k=shrinkage_k)

    def residuals(color: str) -> Column:
        return F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("color") == color, F.struct("family", round_binary("resid", 4).alias("r"))))))

    maps = table.groupBy("cohort").agg(F.struct(residuals("white").alias("white"), residuals("black").alias("black")).alias("family_residuals"))
    enough = F.col("n_analyzed_games") >= min_analyzed
    accuracy = F.when(F.count_if(enough) > 0, F.struct(F.avg(F.when(enough, F.col("acpl"))).alias("avg_acpl"), F.avg(F.when(enough, F.col("blunder_rate"))).alias("avg_blunder_rate"), F.count_if(enough).alias("n_players")))
    means = F.map_from_arrays(F.array(*map(F.lit, feature_columns)), F.array(*map(F.avg, feature_columns)))
    rows = clustered.groupBy(F.col("cluster").alias("cohort")).agg(F.count("*").alias("size"), F.avg("avg_rating").alias("avg_rating"), accuracy.alias("accuracy"), means.alias("feature_means"))
    for more in (maps, _openings(ranked, "white"), _openings(ranked, "black")):
        rows = rows.join(more, "cohort", "left")
    if profiles is not None:
        rows = rows.join(profiles.toDF("cohort", "_name", "_blurb"), "cohort", "left")
    name = F.concat(F.lit("Cluster "), F.col("cohort").cast("string"))
    none = F.expr("cast(array() as array<struct<name: string, n: bigint, score_residual: double>>)")
    empty = F.expr("cast(map() as map<string, double>)")
    cluster = F.struct(
        F.col("cohort").alias("id"),
        (F.coalesce("_name", name) if profiles is not None else name).alias("name"),
        (F.coalesce("_blurb", F.lit("")) if profiles is not None else F.lit("")).alias("blurb"),
        "size", "avg_rating", "accuracy",
        F.struct(F.coalesce("family_residuals.white", empty).alias("white"), F.coalesce("family_residuals.black", empty).alias("black")).alias("family_residuals"),
        "feature_means",
        F.struct(F.coalesce("white", none).alias("white"), F.coalesce("black", none).alias("black")).alias("top_openings"),
    )
    # One element a cluster.
    listed = F.array_sort(F.collect_list(cluster), lambda x, y: F.when(x["id"] < y["id"], -1).when(x["id"] > y["id"], 1).otherwise(0))
    return rows.agg(F.count("*").alias("k"), F.array(*map(F.lit, feature_columns)).alias("feature_columns"), listed.alias("clusters"))


def write_document(document: DataFrame, path: str) -> None:
    """A recommendation document at rest: one file of JSON, nulls written too."""
    document.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """The document as `write_document` left it, with the schema that answers read."""
    item = "array<struct<name: string, n: bigint, score_residual: double>>"
    cluster = f"""id: int, name: string, blurb: string, size: bigint, avg_rating: double, accuracy: struct<avg_acpl: double, avg_blunder_rate: double, n_players: bigint>,
family_residuals: struct<white: map<string, double>, black: map<string, double>>, feature_means: map<string, double>, top_openings: struct<white: {item}, black: {item}>"""
    return spark.read.schema(f"k bigint, feature_columns array<string>, clusters array<struct<{cluster}>>").json(path)
