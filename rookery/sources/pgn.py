"""Game transcripts: records of a text, their tags and moves, and the rows of the two players.

A compressed dump is one task's to read, so `read_records` is best written once
as many files of records (`write_records`), from which all else runs in parallel.
"""

from __future__ import annotations

import io
import math
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from .. import schema
from ..functions import accuracy, epoch_ms, game_id, speed_bucket, status
from ..functions.board import board_features_of, replayed
from ..functions.moves import ACCURACY, FEATURES, accuracy_of, centipawns, features_of

#: Default filters of a dump: speeds, and ratings of both sides.
SPEEDS, MIN_ELO, MAX_ELO, MIN_PLIES = ("blitz", "rapid", "classical"), 800, 3500, 4
_TAGS = ["Variant", "Rated", "White", "Black", "WhiteElo", "BlackElo", "Result", "ECO", "Opening", "TimeControl", "Termination", "Site", "UTCDate", "UTCTime"]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """`record`: a game's text, with any line ends. A line that begins with `[Event `
    begins a record. Reads plain, .gz, .bz2 and .zst files; for zstd windows that Spark can't hold, `transcode` first."""
    raw = spark.read.option("lineSep", "\n[Event ").text(path)
    text = F.regexp_replace("value", "\r", "")
    text = F.regexp_replace(text, r"\s+$", "")
    return raw.select(F.when(F.startswith(text, F.lit("[Event ")) | (text == ""), text).otherwise(F.concat(F.lit("[Event "), text)).alias("record")).where("record <> ''")


def write_records(spark: SparkSession, path: str, out: str, files: int | None = None) -> None:
    """Spreads the records of a dump over `files` files, or over as many as its bytes fill (spark.sql.adaptive.advisoryPartitionSizeInBytes each)."""
    records = read_records(spark, path)
    (records.hint("rebalance") if files is None else records.repartition(files)).write.mode("overwrite").parquet(out)


def transcode(spark: SparkSession, path: str, out: str) -> None:
    """A .zst file with a window of up to 2 GB as plain text, streamed through one task; both paths are local to it or mounted."""

    def copy(paths):
        import zstandard

        for p in paths:
            with open(p, "rb") as f, open(out, "wb") as g:
                zstandard.ZstdDecompressor(max_window_size=2**31).copy_stream(io.BufferedReader(f), g)
            yield p

    spark.sparkContext.parallelize([path], 1).mapPartitions(copy).count()


#: A tag pair.
_TAG = r'(?m)^\[(\w+)\s+"((?:[^"\\]|\\.)*)"\]'
#: A move, and the comment that follows it.
_MOVE = r"((?:O-O(?:-O)?|[KQRBN]?[a-h]?[1-8]?x?[a-h][1-8](?:=[QRBN])?)[+#]?)[!?]*\s*(?:\$\d+\s*)*(?:\{([^}]*)\}\s*(?:\{[^}]*\}\s*)*)?"


def parsed(records: DataFrame) -> DataFrame:
    """Tags, moves (array), evals (array, White's centipawns) of each record."""
    block, body = F.split_part("record", F.lit("\n\n"), F.lit(1)), F.split_part("record", F.lit("\n\n"), F.lit(2))
    for _ in range(2):  # variations, and those within them
        body = F.when(F.contains(body, F.lit("(")), F.regexp_replace(body, r"\([^()]*\)", " ")).otherwise(body)
    body = F.when(F.startswith(body, F.lit("{")), F.regexp_replace(body, r"^(\s*\{[^}]*\})+", "")).otherwise(body)
    rows = records.select(block.alias("block"), body.alias("body"))
    rows = rows.select(F.regexp_extract_all("block", F.lit(_TAG), F.lit(1)).alias("names"), F.regexp_extract_all("block", F.lit(_TAG), F.lit(2)).alias("told"), F.regexp_extract_all("body", F.lit(_MOVE), F.lit(1)).alias("moves"), F.regexp_extract_all("body", F.lit(_MOVE), F.lit(2)).alias("comments"))
    found = {t: F.get("told", F.array_position("names", t).cast("int") - 1) for t in _TAGS}
    tags = [F.when(F.contains(c, F.lit("\\")), F.regexp_replace(c, r"\\(.)", "$1")).otherwise(c).alias(t) for t, c in found.items()]
    return rows.select(*tags, "moves", F.transform("comments", centipawns).alias("evals"))


_EVAL = re.compile(r"\[%eval\s+([#+\-\d.]+)")
_TAG_RE, _MOVE_RE, _BRACKETS, _LEADING, _ESCAPED = re.compile(_TAG), re.compile(_MOVE), re.compile(r"\([^()]*\)"), re.compile(r"^(\s*\{[^}]*\})+"), re.compile(r"\\(.)")


def _centipawns(comment: str) -> int | None:
    """`centipawns` of one comment."""
    return _worth(found[1]) if (found := _EVAL.search(comment)) else None


@lru_cache(1 << 16)
def _worth(raw: str) -> int | None:
    """Centipawns of an evaluation as it is written."""
    try:
        if not raw.startswith("#"):
            return int(math.copysign(math.floor(abs(float(raw) * 100) + 0.5), float(raw)))
        mate = int(raw[1:])
    except ValueError:
        return None
    return 10000 - mate if mate > 0 or (mate == 0 and not raw.startswith("#-")) else -10000 - mate


def _read(record: str) -> tuple[dict[str, str], list[str], list[int | None]]:
    """Tags (the first of each name), moves and evaluations of a record."""
    block, _, body = record.partition("\n\n")
    tags: dict[str, str] = {}
    for name, value in reversed(_TAG_RE.findall(block)):
        tags[name] = _ESCAPED.sub(r"\1", value) if "\\" in value else value
    body = body.partition("\n\n")[0]
    for _ in range(2):
        body = _BRACKETS.sub(" ", body) if "(" in body else body
    if body.startswith("{"):
        body = _LEADING.sub("", body)
    pairs = _MOVE_RE.findall(body)
    return tags, [m for m, _ in pairs], [_centipawns(c) if c else None for _, c in pairs]


class EncodingError(ValueError):
    """Bytes of a record weren't text."""


class TagError(ValueError):
    """A line before the moves isn't a tag pair."""


class CommentError(ValueError):
    """A comment doesn't end."""


_TAG_LINE, _COMMENT = re.compile(_TAG.removeprefix("(?m)") + r"\s*"), re.compile(r"\{[^}]*\}")
_INT = range(-(2**31), 2**31)


def _whole(record: str) -> None:
    """Raises what is wrong with a record's text."""
    if "\ufffd" in record:
        raise EncodingError
    block, _, body = record.partition("\n\n")
    for line in block.split("\n"):
        if line.strip() and not _TAG_LINE.fullmatch(line):
            raise TagError
    if "{" in body and "{" in _COMMENT.sub("", body):
        raise CommentError


def _converted(tags: dict[str, str], moves: list[str], evals: list[int | None], board: bool) -> tuple:
    """A record's columns; on a board moves end before the first that isn't legal."""
    if board:
        n, features = replayed(moves)
        if n < len(moves):
            moves, evals = moves[:n], evals[:n]
            features = board_features_of(moves)
    else:
        features = features_of(moves)
    return (*(tags.get(t) for t in _TAGS), moves, evals, accuracy_of(evals), features)


_NOTHING = (*(None for _ in _TAGS), [], [], None, None)


def _tried(record: str | None, board: bool) -> tuple:
    """`_converted`, why it can't be done, and then the text."""
    if record is None or not record.strip():
        return (*_NOTHING, "null", record)
    try:
        _whole(record)
        read = _read(record)
    except Exception as e:  # whatever it is: the record goes on, with its reason
        return (*_NOTHING, f"parse:{type(e).__name__}", record)
    try:
        for n in (*read[2], *(int(x) for t in ("WhiteElo", "BlackElo") if re.fullmatch(r"[+-]?\d+", x := read[0].get(t, "")))):
            if n is not None and n not in _INT:
                raise OverflowError
        return (*_converted(*read, board), None, None)
    except Exception as e:
        return (*_NOTHING, f"convert:{type(e).__name__}", record)


def quarantined(records: DataFrame, *, board: bool = False) -> DataFrame:
    """`extracted` for damaged dumps: a row for every record, none is lost. `error` says why one
    can't be read (`parse:...`), doesn't fit its columns (`convert:...`) or is blank (`null`), with its text in
    `record`; both are null for the others. `judged` takes the error for its reason, `set_aside` gives such records."""
    return _extracted(records, board, True)


def set_aside(judged_games: DataFrame) -> DataFrame:
    """(reason, record) of the records that `quarantined` couldn't use."""
    return judged_games.where("error is not null").select(F.col("error").alias("reason"), "record")


def extracted(records: DataFrame, *, board: bool = False) -> DataFrame:
    """`parsed`, and `acc` and `mf` (`accuracy` and `move_features`), in one pass of Arrow
    batches: of a long game's text this takes a fraction of what the expressions do. What comes out is the
    same, unless moves are replayed on a `board`: then a game ends before its first move that isn't legal."""
    return _extracted(records, board, False)


def _extracted(records: DataFrame, board: bool, strict: bool) -> DataFrame:
    schema_ = ", ".join(f"{t} string" for t in _TAGS) + f", moves array<string>, evals array<int>, acc {ACCURACY}, mf {FEATURES}" + (", error string, record string" if strict else "")
    kinds = to_arrow_schema(DataType.fromDDL(schema_))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                some = batch.column(0).slice(at, 1024).to_pylist()
                games = [_tried(r, board) if strict else _converted(*_read(r or ""), board) for r in some]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*games, strict=True), kinds, strict=True)], schema=kinds)

    return records.select("record").mapInArrow(read, schema_)


def _player(name: Column) -> Column:
    return F.coalesce((name != "") & ~F.upper(name).isin("?", "BOT"), F.lit(False))


def judged(games: DataFrame, *, speeds: Sequence[str] = SPEEDS, min_elo: int = MIN_ELO, max_elo: int = MAX_ELO) -> DataFrame:
    """`parsed`, `extracted` or `quarantined` games with speed, ratings and `reject`: why a game is left out, or null."""
    white, black = F.col("WhiteElo").try_cast("int"), F.col("BlackElo").try_cast("int")
    rows = games.withColumn("speed", speed_bucket(F.coalesce("TimeControl", F.lit("")))).withColumn("white_rating", white).withColumn("black_rating", black)
    sound = (
        (F.coalesce("Variant", F.lit("Standard")) == "Standard")
        & (F.lower(F.coalesce("Rated", F.lit(""))) != "false")
        & _player(F.col("White")) & _player(F.col("Black"))
        & F.col("white_rating").isNotNull() & F.col("black_rating").isNotNull()
        & F.coalesce(F.col("Result").isin("1-0", "0-1", "1/2-1/2"), F.lit(False))
        & (F.coalesce("ECO", F.lit("")) != "") & (F.coalesce("Opening", F.lit("")) != "")
        & F.col("speed").isNotNull() & (F.size("moves") >= MIN_PLIES)
    )
    rated = F.col("white_rating").between(min_elo, max_elo) & F.col("black_rating").between(min_elo, max_elo)
    error = F.col("error") if "error" in games.columns else F.lit(None).cast("string")
    return rows.withColumn("reject", F.when(error.isNotNull(), error).when(~sound, "filtered").when(~F.col("speed").isin(*speeds), "filtered_speed").when(~rated, "filtered_rating"))


def reject_counts(judged_games: DataFrame) -> DataFrame:
    """How many games were kept, and left out for each reason."""
    return judged_games.groupBy(F.coalesce("reject", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def games_of(judged_games: DataFrame) -> DataFrame:
    """Two rows for each game that is kept, one as each player sees it (`schema.GAMES`; of `extracted` games with `mf` too)."""
    kept = judged_games.where("reject is null").withColumn("text", F.array_join("moves", " "))
    kept = kept if "acc" in kept.columns else kept.withColumn("acc", accuracy("evals"))

    def side(own: str, other: str, wins: str) -> Column:
        lower = own.lower()
        result = F.when(F.col("Result") == "1/2-1/2", "draw").when(F.col("Result") == wins, "win").otherwise("loss")
        return F.struct(
            F.col(own).alias("username"), F.lit(lower).alias("color"), result.alias("result"), F.col(f"{lower}_rating").alias("user_rating"), F.col(other).alias("opponent_username"), F.col(f"{other.lower()}_rating").alias("opponent_rating"),
            F.col(f"acc.{lower}_acpl").alias("acpl"), F.col(f"acc.{lower}_blunders").alias("blunders"), F.col(f"acc.{lower}_n_eval").alias("n_eval_moves"),
        )

    both = kept.withColumn("me", F.explode(F.array(side("White", "Black", "1-0"), side("Black", "White", "0-1"))))
    made = {
        "game_id": game_id("Site"), "created_at": epoch_ms("UTCDate", "UTCTime"), "status": status(F.coalesce("Termination", F.lit("Normal")), "Result", "text"),
        "n_moves": F.size("moves"), "moves": F.col("text"), "opening_eco": F.col("ECO"), "opening_name": F.col("Opening"), "speed": F.col("speed"),
        "rated": F.lit(True), "variant": F.lit("standard"), "has_eval": F.col("acc").isNotNull(),
    }
    more = ["mf"] if "mf" in kept.columns else []
    return both.select(*more, *(made.get(f.name, F.col(f"me.{f.name}")).cast(f.dataType).alias(f.name) for f in schema.GAMES))


def sample_games(judged_games: DataFrame, n: int, *, seed: int = 0, skip: int = 0) -> DataFrame:
    """`n` games by the hash of their address, after the first `skip`: with another skip a disjoint sample, the same on every run."""
    order = [F.xxhash64("Site", F.lit(seed)), "Site"]
    return judged_games.orderBy(*order).offset(skip).limit(n)
