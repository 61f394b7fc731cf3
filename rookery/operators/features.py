"""One row a player, from one pass over the games."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import eco_letter, eco_number, residual
from ..functions.board import with_board_features
from ..plans import models
from ..shared import stage

#: Plies from which a game is long, and under which it is short.
LONG, SHORT = 80, 40
#: What a player lacks is the mean of all players, or for these residuals the player's own.
FROM_OWN = ["white_score_residual", "black_score_residual", "long_game_residual"]
FROM_ALL = ["pct_e4_as_white", "pct_d4_as_white", "pct_sicilian_as_black", "pct_carokann_as_black", "pct_french_as_black", "pct_e5_as_black", "avg_castle_move", "pct_queenside_castle", "avg_queens_off_move"]


def annotate(games: DataFrame) -> DataFrame:
    """Games with score_diff, eco letter and number, and the player's side of the move features
    (from `mf`, or else `moves` replayed on a board, unless castle_ply is there)."""
    rows = games.withColumn("score_diff", residual()).withColumn("eco_letter", eco_letter()).withColumn("eco_num", eco_number())
    if "castle_ply" in games.columns:
        return rows
    rows = rows if "mf" in games.columns else with_board_features(rows)
    white = F.col("color") == "white"
    own = {name: F.when(white, F.col(f"mf.white_{name}")).otherwise(F.col(f"mf.black_{name}")) for name in ("castle_ply", "castle_qside", "early_pawn")}
    return rows.withColumns(own).withColumn("queens_off_ply", F.col("mf.queens_off_ply")).drop("mf")


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(F.count_if(part & whole), F.nullif(F.count_if(whole), F.lit(0)))


def player_features(games: DataFrame, min_games: int = 20) -> DataFrame:
    """Features of every player with `min_games` games or more, nulls where a
    player has no such game. One aggregation; nothing is read twice. Games, narrowed to what is needed, go to their
    players' tasks first: a game is far smaller than the many sums of a player who has met a task a few times only."""
    told = {"white": F.col("color") == "white", "black": F.col("color") == "black", "draw": F.col("result") == "draw"} | {s: F.col("status") == s for s in ("mate", "outoftime", "resign")}
    kept = ["user_rating", "score_diff", "n_moves", "opening_eco", "has_eval", "acpl", "n_eval_moves", "blunders", "castle_ply", "castle_qside", "queens_off_ply", "early_pawn"]
    g = annotate(games).select("username", *(c.alias(n) for n, c in told.items()), *kept).repartition("username")
    white, black = F.col("white"), F.col("black")
    letter, number = eco_letter(), eco_number()
    e4, d4 = letter.isin("B", "C"), letter.isin("D", "E")
    met_e4, analysed = black & e4, F.coalesce("has_eval", F.lit(False))
    castled, no_queens = F.col("castle_ply").isNotNull(), F.col("queens_off_ply").isNotNull()
    evals = F.sum(F.when(analysed, F.col("n_eval_moves")))

    def rate(p: Column) -> Column:
        return F.avg(p.cast("double"))

    def mean(name: str, p: Column) -> Column:
        return F.avg(F.when(p, F.col(name)))

    found = g.groupBy("username").agg(
        F.count("*").alias("n_games"),
        F.avg("user_rating").alias("avg_rating"),
        F.count_if(analysed).alias("n_analyzed_games"),
        F.try_divide(F.sum(F.when(analysed, F.col("acpl") * F.col("n_eval_moves"))), evals).alias("acpl"),
        F.try_divide(F.sum(F.when(analysed, F.col("blunders"))), evals).alias("blunder_rate"),
        F.avg("score_diff").alias("score_residual"),
        mean("score_diff", white).alias("white_score_residual"),
        mean("score_diff", black).alias("black_score_residual"),
        mean("score_diff", F.col("n_moves") >= LONG).alias("long_game_residual"),
        rate(F.col("draw")).alias("draw_rate"),
        rate(F.col("mate")).alias("mate_rate"),
        rate(F.col("outoftime")).alias("timeout_rate"),
        rate(F.col("resign")).alias("resign_rate"),
        (F.avg("n_moves") / 2.0).alias("avg_moves"),
        rate(F.col("n_moves") < SHORT).alias("short_game_rate"),
        # A code that is null is a code of its own.
        ((F.size(F.collect_set("opening_eco")) + F.max(F.col("opening_eco").isNull().cast("int"))) / F.count("*")).alias("opening_diversity"),
        _share(e4, white).alias("pct_e4_as_white"),
        _share(d4, white).alias("pct_d4_as_white"),
        _share((letter == "B") & (number >= 20), met_e4).alias("pct_sicilian_as_black"),
        _share((letter == "C") & (number <= 19), met_e4).alias("pct_french_as_black"),
        _share((letter == "B") & number.between(10, 19), met_e4).alias("pct_carokann_as_black"),
        _share((letter == "C") & (number >= 20), met_e4).alias("pct_e5_as_black"),
        mean("castle_ply", castled).alias("avg_castle_move"),
        F.avg(F.when(castled, F.col("castle_qside").cast("double"))).alias("pct_queenside_castle"),
        mean("queens_off_ply", no_queens).alias("avg_queens_off_move"),
        F.avg("early_pawn").alias("early_pawn_pushes"),
    )
    return found.where(F.col("n_games") >= min_games)


def impute(features: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """Nulls filled: residuals from the player's own, others from the mean over
    players, of `features` or of the stored one-row `means` (for a player who comes later)."""
    if means is None:
        features = stage(features, "features")  # read for the means and for the rows
        means = imputation_means(features)
    filled = features.crossJoin(F.broadcast(means.limit(1)))  # one row
    out = {c: F.coalesce(c, "score_residual") for c in FROM_OWN} | {c: F.coalesce(c, f"mean_{c}") for c in FROM_ALL}
    return filled.withColumns(out).select(features.columns)


def live_profile(games: DataFrame, model: dict) -> DataFrame:
    """A live user's games as one row: features, filled by the training players' means,
    with cluster and dist by a stored `model` (`models.load_model`): the order of features, scaler, centres and means."""
    features = player_features(games, 1)
    means = features.sparkSession.createDataFrame([tuple(model["means"].get(f"mean_{c}") for c in FROM_ALL)], ", ".join(f"mean_{c} double" for c in FROM_ALL))
    filled = impute(features, means)
    scaled = models.scale(models.vectors(filled, "username", model["columns"]), model["scaler"])
    placed = models.assign(scaled, model["centres"]).select(F.col("id").alias("username"), "cluster", "dist")
    return filled.join(placed, "username")


def imputation_means(features: DataFrame) -> DataFrame:
    """What `impute` needs of the training players, to be stored with a model."""
    return features.agg(*(F.avg(c).alias(f"mean_{c}") for c in FROM_ALL))
