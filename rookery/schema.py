"""Schemas of the tables at rest, and the lists of features a model is trained on."""

from __future__ import annotations

from pyspark.sql import types as T

#: The columns of games at rest.
GAMES = T.StructType(
    [
        T.StructField("username", T.StringType()),
        T.StructField("game_id", T.StringType()),
        T.StructField("created_at", T.LongType()),  # milliseconds since 1970, UTC
        T.StructField("color", T.StringType()),
        T.StructField("result", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("n_moves", T.IntegerType()),  # plies
        T.StructField("moves", T.StringType()),
        T.StructField("opening_eco", T.StringType()),
        T.StructField("opening_name", T.StringType()),
        T.StructField("speed", T.StringType()),
        T.StructField("rated", T.BooleanType()),
        T.StructField("variant", T.StringType()),
        T.StructField("user_rating", T.IntegerType()),
        T.StructField("opponent_username", T.StringType()),
        T.StructField("opponent_rating", T.IntegerType()),
        T.StructField("has_eval", T.BooleanType()),
        T.StructField("acpl", T.DoubleType()),
        T.StructField("blunders", T.IntegerType()),
        T.StructField("n_eval_moves", T.IntegerType()),
    ]
)

_PLAYER = "struct<user: struct<name: string>, rating: int>"
#: A game of the JSON feed.
FEED = f"""id string, createdAt bigint, rated boolean, variant string, speed string, status string, winner string, moves string,
opening struct<eco: string, name: string>, clock struct<initial: int, increment: int>, players struct<white: {_PLAYER}, black: {_PLAYER}>"""

#: The features of a player, in the order of the models; the first preset leaves the three black replies out.
V2_21 = [
    "score_residual", "white_score_residual", "black_score_residual", "long_game_residual",
    "draw_rate", "mate_rate", "timeout_rate", "resign_rate", "avg_moves", "short_game_rate",
    "opening_diversity", "pct_e4_as_white", "pct_d4_as_white", "pct_sicilian_as_black",
    "pct_french_as_black", "pct_carokann_as_black", "pct_e5_as_black",
    "avg_castle_move", "pct_queenside_castle", "avg_queens_off_move", "early_pawn_pushes",
]
V1_18 = [f for f in V2_21 if f not in ("pct_french_as_black", "pct_carokann_as_black", "pct_e5_as_black")]
