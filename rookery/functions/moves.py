"""What a game's moves and engine evaluations say, as folds over arrays: as column
expressions, and game by game for the stage that reads transcripts in Python anyway."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .games import col

#: The loss of a move counts to CP_CAP centipawns, is a blunder from BLUNDER; before the first evaluation White stands INITIAL better.
CP_CAP, BLUNDER, INITIAL = 1000, 200, 20
#: Plies in which pawn moves are early.
EARLY = 20


def tokens(moves: Column | str) -> Column:
    return F.filter(F.split(F.coalesce(col(moves), F.lit("")), r"\s+"), lambda t: t != "")


def _at(parity: int, f):
    """`f` of the elements of one side; null for the other's."""
    return lambda x, i: F.when(i % 2 == parity, f(x))


def _first_castle(played: Column, parity: int) -> Column:
    at = F.transform(played, lambda t, i: F.when(F.startswith(t, F.lit("O-O")) & (i % 2 == parity), i + 1))
    return F.get(F.filter(at, lambda i: i.isNotNull()), F.lit(0))


def _queens_off(played: Column) -> Column:
    """The first ply after which no queen is on the board, from the squares where
    queens stand: a queen moves, is taken, or comes from a pawn. Of several queens
    of a side the one moves that its token names; else the latest."""

    def step(s: Column, t: Column) -> Column:
        to = F.regexp_extract(t, r"([a-h][1-8])(?:=[QRBN])?[+#]?[!?]*$", 1)
        origin = F.regexp_extract(t, r"^Q([a-h]?[1-8]?)x?[a-h][1-8]", 1)
        ply = s["ply"] + 1
        white = ply % 2 == 1
        own, other = F.when(white, s["w"]).otherwise(s["b"]), F.when(white, s["b"]).otherwise(s["w"])
        other = F.when(F.contains(t, F.lit("x")), F.array_remove(other, to)).otherwise(other)
        named = F.filter(own, lambda q: F.contains(q, origin))
        leaves = F.coalesce(F.get(named, F.size(named) - 1), F.lit(""))
        own = F.when(F.startswith(t, F.lit("Q")), F.concat(F.array_remove(own, leaves), F.array(to))).when(F.contains(t, F.lit("=Q")), F.concat(own, F.array(to))).otherwise(own)
        off = F.when((s["off"] == 0) & (F.size(own) + F.size(other) == 0), ply).otherwise(s["off"])
        return F.struct(ply.alias("ply"), F.when(white, own).otherwise(other).alias("w"), F.when(white, other).otherwise(own).alias("b"), off.alias("off"))

    start = F.struct(F.lit(0).alias("ply"), F.array(F.lit("d1")).alias("w"), F.array(F.lit("d8")).alias("b"), F.lit(0).alias("off"))
    return F.aggregate(played, start, step, lambda s: F.nullif(s["off"], F.lit(0)))


def move_features(moves: Column | str = "moves") -> Column:
    """white/black_castle_ply, white/black_castle_qside, queens_off_ply, white/black_early_pawn."""
    played = tokens(moves)
    early = F.slice(played, 1, EARLY)
    fields = []
    for parity, side in enumerate(("white", "black")):
        ply = _first_castle(played, parity)
        fields.append(ply.alias(f"{side}_castle_ply"))
        fields.append(F.coalesce(F.startswith(F.get(played, ply - 1), F.lit("O-O-O")), F.lit(False)).alias(f"{side}_castle_qside"))
        pawns = F.transform(early, _at(parity, lambda t: F.rlike(t, F.lit("^[a-z]"))))
        fields.append(F.size(F.filter(pawns, lambda x: x)).alias(f"{side}_early_pawn"))
    return F.struct(*fields, _queens_off(played).alias("queens_off_ply"))


def centipawns(comment: Column) -> Column:
    """White's view of `[%eval 0.25]` or `[%eval #-3]`; null without one."""
    raw = F.regexp_extract(comment, r"\[%eval\s+([#+\-\d.]+)", 1)
    mate = F.regexp_extract(raw, r"#([+\-]?\d+)", 1).try_cast("int")
    pawns = F.round(raw.try_cast("double") * 100).cast("int")
    return F.when(F.startswith(raw, F.lit("#")), F.when((mate > 0) | (~F.startswith(raw, F.lit("#-")) & (mate == 0)), 10000 - mate).otherwise(-10000 - mate)).otherwise(pawns)


def accuracy(evals: Column | str) -> Column:
    """white/black_acpl, _blunders, _n_eval from White's centipawns after each ply (nulls where there are none); null if there are none at all."""
    evals = col(evals)
    loss = F.transform(
        evals,
        lambda e, i: F.greatest(F.lit(0), F.least(F.lit(CP_CAP), F.when(i % 2 == 0, 1).otherwise(-1) * (F.coalesce(F.when(i > 0, F.get(evals, F.greatest(i - 1, F.lit(0)))), F.lit(INITIAL)) - e))) + e * 0,
    )
    fields = []
    for parity, side in enumerate(("white", "black")):
        own = F.filter(F.transform(loss, _at(parity, lambda x: x)), lambda x: x.isNotNull())
        n = F.size(own)
        fields += [
            F.when(n > 0, F.aggregate(own, F.lit(0).cast("double"), lambda s, x: s + x) / n).alias(f"{side}_acpl"),
            F.size(F.filter(own, lambda x: x >= BLUNDER)).alias(f"{side}_blunders"),
            n.alias(f"{side}_n_eval"),
        ]
    return F.when(F.exists(evals, lambda e: e.isNotNull()), F.struct(*fields))


#: Types of `move_features` and `accuracy`.
FEATURES = "struct<white_castle_ply: int, white_castle_qside: boolean, white_early_pawn: int, black_castle_ply: int, black_castle_qside: boolean, black_early_pawn: int, queens_off_ply: int>"
ACCURACY = "struct<white_acpl: double, white_blunders: int, white_n_eval: int, black_acpl: double, black_blunders: int, black_n_eval: int>"

_TO = re.compile(r"([a-h][1-8])(?:=[QRBN])?[+#]?[!?]*$")
_FROM = re.compile(r"^Q([a-h]?[1-8]?)x?[a-h][1-8]")


@lru_cache(1 << 16)
def _told(move: str) -> tuple[bool, bool, tuple[bool, bool, str, str] | None]:
    """Whether a move castles, and moves a pawn; and what it may do to queens (takes, by a queen, to, from). Games have few different moves, so they are read once."""
    queen, takes = move.startswith("Q"), "x" in move
    does = None
    if queen or takes or "=Q" in move:
        does = (takes, queen, t[1] if (t := _TO.search(move)) else "", t[1] if queen and (t := _FROM.search(move)) else "")
    return move.startswith("O-O"), move[:1].islower() and move[:1].isascii(), does


def features_of(moves: Sequence[str]) -> dict:
    """`move_features` of one game."""
    out: dict = {}
    told = list(map(_told, moves))
    for parity, side in enumerate(("white", "black")):
        castle = next((i for i in range(parity, len(told), 2) if told[i][0]), None)
        out[f"{side}_castle_ply"] = None if castle is None else castle + 1
        out[f"{side}_castle_qside"] = castle is not None and moves[castle].startswith("O-O-O")
        out[f"{side}_early_pawn"] = [pawn for _, pawn, _ in told[parity:EARLY:2]].count(True)
    queens, off = (["d1"], ["d8"]), None
    for ply, (_, _, does) in enumerate(told, 1):
        if does is None:
            continue
        own, other = queens if ply % 2 else queens[::-1]
        takes, queen, to, origin = does
        if takes and to in other:
            other[:] = [q for q in other if q != to]
        if queen:
            named = [q for q in own if origin in q]
            own[:] = [*(q for q in own if not named or q != named[-1]), to]
        elif "=Q" in moves[ply - 1]:
            own.append(to)
        if off is None and not own and not other:
            off = ply
    out["queens_off_ply"] = off
    return out


def accuracy_of(evals: Sequence[int | None]) -> dict | None:
    """`accuracy` of one game."""
    if all(e is None for e in evals):
        return None
    losses: tuple[list[int], list[int]] = ([], [])
    before: int | None = INITIAL
    for i, e in enumerate(evals):
        if e is not None:
            losses[i % 2].append(min(CP_CAP, max(0, (1 if i % 2 == 0 else -1) * ((INITIAL if before is None else before) - e))))
        before = e
    out: dict = {}
    for side, own in zip(("white", "black"), losses, strict=True):
        out |= {f"{side}_acpl": sum(own) / len(own) if own else None, f"{side}_blunders": sum(x >= BLUNDER for x in own), f"{side}_n_eval": len(own)}
    return out
