"""Scores, ratings, clocks and outcomes of a game."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def actual_score(result: Column | str = "result") -> Column:
    """1 for a win, 0.5 for a draw, else 0 (also without a result)."""
    return F.when(col(result) == "win", 1.0).when(col(result) == "draw", 0.5).otherwise(0.0)


def expected_score(user: Column | str = "user_rating", opponent: Column | str = "opponent_rating") -> Column:
    """Elo's expectation."""
    return 1.0 / (1.0 + F.pow(F.lit(10.0), (col(opponent) - col(user)) / 400.0))


def residual(result: Column | str = "result", user: Column | str = "user_rating", opponent: Column | str = "opponent_rating") -> Column:
    """What a player scored above expectation; null without ratings."""
    return actual_score(result) - expected_score(user, opponent)


def shrink(n: Column, mean: Column, k: float) -> Column:
    """A mean over n drawn towards 0 as if k more had given 0."""
    return n / (n + F.lit(float(k))) * mean


def round_binary(x: Column | str, digits: int) -> Column:
    """`x` (double) rounded to some places by its exact binary value: 0.00015, which lies below what it is
    written as, gives 0.0001 (`F.round` goes by the shortest decimal and gives 0.0002). True ties go to the even figure.

    The product with 10^digits and what rounding it lost are both exact (the factor has few bits),
    so the part after the point, and where it is a half the sign of the loss, decide."""
    if not 0 <= digits <= 7:
        raise ValueError("0 to 7 places")
    value = col(x).cast("double")
    size, ten = F.abs(value), float(10**digits)
    high = size * 134217729.0 - (size * 134217729.0 - size)  # the upper 26 bits
    product = size * ten
    lost = (high * ten - product) + (size - high) * ten
    whole = F.floor(product).cast("double")
    rest = product - whole
    up = (rest > 0.5) | ((rest == 0.5) & ((lost > 0) | ((lost == 0) & (whole % 2 == 1))))
    rounded = (whole + up.cast("double")) / ten * F.when(value < 0, -1.0).otherwise(1.0)
    return F.when(F.isnan(value) | (product >= 2.0**52), value).otherwise(rounded)


def eco_letter(eco: Column | str = "opening_eco") -> Column:
    return F.substring(col(eco), 1, 1)


def eco_number(eco: Column | str = "opening_eco") -> Column:
    """The two figures of the code; null if they aren't."""
    return F.substring(col(eco), 2, 2).try_cast("tinyint")


def speed_bucket(time_control: Column | str) -> Column:
    """'600+5' (seconds, increment) by the length of 40 moves; null if it isn't that. The site's bounds in seconds."""
    initial = F.split_part(col(time_control), F.lit("+"), F.lit(1)).try_cast("bigint")
    increment = F.when(F.contains(col(time_control), F.lit("+")), F.regexp_replace(col(time_control), r"^[^+]*\+", "")).try_cast("bigint")
    seconds = initial + 40 * increment
    return F.when(seconds < 30, "ultraBullet").when(seconds < 180, "bullet").when(seconds < 480, "blitz").when(seconds < 1500, "rapid").when(seconds.isNotNull(), "classical")


def status(termination: Column | str, result: Column | str, moves: Column | str) -> Column:
    """How a game ended, from its termination, result and last move."""
    last = F.regexp_replace(F.element_at(F.split(F.concat(F.lit(" "), F.regexp_replace(col(moves), r"\s+$", "")), r"\s+"), -1), r"(1-0|0-1|1/2-1/2)$", "")
    return (
        F.when(col(termination) == "Time forfeit", "outoftime")
        .when(col(termination) == "Abandoned", "noStart")
        .when(col(result) == "1/2-1/2", "draw")
        .when(F.endswith(last, F.lit("#")), "mate")
        .otherwise("resign")
    )


#: Fixed value: the site's address of a game.
SITE = r"https?://lichess\.org/(\w+)"


def game_id(site: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(site), SITE, 1), F.lit(""))


def epoch_ms(date: Column | str, time: Column | str) -> Column:
    """'2026.04.15', '13:42:01' (UTC) as milliseconds since 1970; null if they aren't that. Holds for a session in UTC."""
    return F.unix_millis(F.try_to_timestamp(F.concat_ws(" ", col(date), col(time)), F.lit("yyyy.MM.dd HH:mm:ss")))


def iso_date(ms: Column | str) -> Column:
    """Milliseconds since 1970 as the day in UTC, '2026-04-15'. Holds for a session in UTC."""
    return F.date_format(F.timestamp_millis(col(ms)), "yyyy-MM-dd")


#: Units of a size, each 1,024 of the one before.
UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def byte_label(size: Column | str) -> Column:
    """A size in the largest unit that leaves 1 or more before the point, to one place: '28.0 GB'."""
    n, label = col(size).cast("double"), None
    for k, unit in enumerate(UNITS):
        told = F.concat(F.format_string("%.1f", round_binary(n / float(1024**k), 1)), F.lit(f" {unit}"))
        small = (n < float(1024 ** (k + 1))) | F.lit(k + 1 == len(UNITS))
        label = F.when(small, told) if label is None else label.when(small, told)
    return F.when(n.isNotNull(), label)


def clock_label(initial: Column | str, increment: Column | str) -> Column:
    return F.concat(F.floor(col(initial) / 60).cast("string"), F.lit("+"), col(increment).cast("string"))


def display_result(winner: Column | str, played_white: Column) -> Column:
    """win, loss or ½, from the feed's winner."""
    return F.when(col(winner).isNull(), "½").when((col(winner) == "white") == played_white, "win").otherwise("loss")
