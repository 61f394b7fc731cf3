"""Openings: families, and whose choice an opening is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .games import col

#: Names that tell of Black's choice, where the dimension doesn't know an opening.
BLACK_NAMES = [
    "defense", "defence", "indian", "marshall attack", "schliemann",
    "albin counter", "benoni", "benko", "grünfeld", "grunfeld",
]


def family(name: Column | str = "opening_name") -> Column:
    """The name before its first colon, without white space around it."""
    return F.regexp_replace(F.split_part(col(name), F.lit(":"), F.lit(1)), r"(?U)^\s+|\s+$", "")


def fallback_color(name: Column | str = "opening_name") -> Column:
    return F.when(F.rlike(col(name), F.lit("(?iu)" + "|".join(BLACK_NAMES))), "black").otherwise("white")


def _plies(pgn: Column | str) -> Column:
    return F.filter(F.split(col(pgn), r"\s+"), lambda t: (t != "") & ~F.contains(t, F.lit(".")))


def ply_count(pgn: Column | str) -> Column:
    """Moves of an opening's text; numbers such as `1.` don't count."""
    return F.size(_plies(pgn))


#: A move in algebraic notation.
SAN = r"^(O-O(-O)?|[KQRBN]?[a-h]?[1-8]?x?[a-h][1-8](=[QRBN])?)[+#]?[!?]*$"


def last_mover(pgn: Column | str) -> Column:
    """Who made the last move; Black for none, null if a token isn't a move."""
    plies = _plies(pgn)
    return F.when(F.forall(plies, lambda t: F.rlike(t, F.lit(SAN))), F.when(F.size(plies) % 2 == 1, "white").otherwise("black"))
