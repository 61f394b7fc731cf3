"""The JSON feed of games: reading, flattening to one user's view, fetching, choosing players."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .. import schema


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON, a game each."""
    return spark.read.schema(schema.FEED).json(path)


def flatten_feed(games: DataFrame, user: str | None = None) -> DataFrame:
    """Rows of `schema.GAMES` as `user` (or the column `target`) sees each game; games without that player are left out.

    Names are matched without regard to case; the row keeps the spelling asked for."""
    target = F.lit(user) if user is not None else F.col("target")
    white, black = (F.lower(F.coalesce(f"players.{s}.user.name", F.lit(""))) == F.lower(target) for s in ("white", "black"))
    side = F.when(white, "white").otherwise("black")
    own, other = F.when(white, F.col("players.white")).otherwise(F.col("players.black")), F.when(white, F.col("players.black")).otherwise(F.col("players.white"))
    result = F.when(F.col("winner").isNull(), "draw").when(F.col("winner") == side, "win").otherwise("loss")
    moves = F.coalesce("moves", F.lit(""))
    made = {
        "username": target, "game_id": F.col("id"), "created_at": F.col("createdAt"), "color": side, "result": result, "status": F.col("status"),
        "n_moves": F.size(F.filter(F.split(moves, r"\s+"), lambda t: t != "")), "moves": moves, "opening_eco": F.col("opening.eco"), "opening_name": F.col("opening.name"),
        "speed": F.col("speed"), "rated": F.coalesce("rated", F.lit(False)), "variant": F.col("variant"), "user_rating": own["rating"],
        "opponent_username": other["user"]["name"], "opponent_rating": other["rating"], "has_eval": F.lit(False), "acpl": F.lit(None), "blunders": F.lit(None), "n_eval_moves": F.lit(None),
    }
    return games.where(white | black).select(*(made[f.name].cast(f.dataType).alias(f.name) for f in schema.GAMES))


def diverse_players(games: DataFrame, known: DataFrame, n: int, *, below: int = 2200, seed: int = 42) -> DataFrame:
    """(name, rating): `n` opponents rated under `below` who aren't in `known` (name), chosen by hash; a name's best rating counts."""
    pool = games.where(F.col("opponent_username").isNotNull() & (F.col("opponent_username") != "") & (F.col("opponent_rating") < below) & (F.col("opponent_rating") != 0))
    best = pool.groupBy(F.lower("opponent_username").alias("name")).agg(F.max("opponent_rating").alias("rating"))
    fresh = best.join(known.select(F.lower("name").alias("name")).distinct(), "name", "left_anti")
    return fresh.orderBy(F.xxhash64("name", F.lit(seed)), "name").limit(n)


class _Users(InputPartition):
    def __init__(self, users: Sequence[str]):
        self.users = list(users)


class FeedReader(DataSource):
    """`spark.dataSource.register(FeedReader)`, then format("games_feed") with the
    options users (comma-separated), url (with {user}), max, perf, pause (seconds
    between users) and retries: rows (target, line, error). Users go one after
    another in one partition, so the service's rate limit holds; a user who fails gives a row with the error."""

    @classmethod
    def name(cls) -> str:
        return "games_feed"

    def schema(self) -> str:
        return "target string, line string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Users([u for u in self.options.get("users", "").split(",") if u])]

    def read(self, partition: _Users) -> Iterator[tuple]:
        import urllib.error
        import urllib.parse
        import urllib.request

        o, retries = self.options, int(self.options.get("retries", 4))
        asked = {"max": o.get("max", "100"), "opening": "true", "moves": "true", "rated": "true", "perfType": o.get("perf", "")}
        for user in partition.users:
            url = o["url"].format(user=urllib.parse.quote(user))
            if "://" in url and url.startswith("http"):
                url += "?" + urllib.parse.urlencode({k: v for k, v in asked.items() if v})
            request = urllib.request.Request(url, headers={"Accept": "application/x-ndjson"})
            for attempt in range(retries + 1):
                try:
                    with urllib.request.urlopen(request, timeout=30) as answer:
                        lines = [line for line in answer if line.strip()]  # `max` games at most; only a whole answer counts
                    yield from (_checked(user, line) for line in lines)
                    break
                except OSError as e:
                    code = getattr(e, "code", None)
                    if attempt < retries and (code is None or code == 429 or code >= 500):
                        time.sleep(float((getattr(e, "headers", None) or {}).get("Retry-After", 2.0 * 2**attempt)) if float(o.get("pause", 1)) else 0)
                        continue
                    yield user, None, f"{type(e).__name__}: {e}"
                    break
            time.sleep(float(o.get("pause", 1)))


class _StreamReader(DataSourceStreamReader):
    """A stream of the same rows. Its offset is a place in `users_file`, a name a line, to which names are
    added at the end: a batch is the users since the one before, and one that fails is asked for again. `tasks`
    (1) share the rate: each waits that many times `pause` between users. A last line without its end isn't read yet."""

    def __init__(self, options: dict):
        self.reader, self.path = _Reader(options), options["users_file"].removeprefix("file://")
        self.tasks = int(options.get("tasks", 1))

    def _users(self) -> list[str]:
        with open(self.path, encoding="utf-8") as f:
            return [line.strip() for line in f if line.endswith("\n")]

    def initialOffset(self) -> dict:
        return {"users": 0}

    def latestOffset(self) -> dict:
        return {"users": len(self._users())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        users = self._users()[start["users"] : end["users"]]
        return [_Users([u for u in users[k :: self.tasks] if u]) for k in range(min(self.tasks, len(users)))]

    def read(self, partition: _Users) -> Iterator[tuple]:
        shared = {**self.reader.options, "pause": str(float(self.reader.options.get("pause", 1)) * self.tasks)}
        yield from _Reader(shared).read(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept for a batch that is done."""

    def stop(self) -> None:
        """Nothing is open between batches."""


def feed_stream(spark: SparkSession, users_file: str, url: str, **options: str) -> DataFrame:
    """Rows (target, line, error) of the users that a file names, as it grows; options as of FeedReader, and `tasks`."""
    spark.dataSource.register(FeedReader)
    return spark.readStream.format("games_feed").options(users_file=users_file, url=url, **options).load()


def _checked(user: str, line: bytes) -> tuple:
    """A row with the line, or with the error if it isn't JSON."""
    try:
        json.loads(line)
    except ValueError as e:
        return user, None, f"{type(e).__name__}: {e}"
    return user, line.decode(), None


def read_leaderboard(answer: DataFrame) -> DataFrame:
    """(rank, name, rating, title) of a leaderboard's answer (column `value`: JSON
    `{"users": [{"username", "title", "perfs": {<speed>: {"rating"}}}]}`), best first as it is listed."""
    users = "users array<struct<username: string, title: string, perfs: map<string, struct<rating: int>>>>"
    rows = answer.select(F.posexplode(F.from_json("value", users)["users"]).alias("at", "u"))
    return rows.select((F.col("at") + 1).alias("rank"), F.col("u.username").alias("name"), F.map_values("u.perfs")[0]["rating"].alias("rating"), F.col("u.title").alias("title"))


def fetch_leaderboard(spark: SparkSession, url: str, speed: str, **options: str) -> DataFrame:
    """`read_leaderboard` of a service's answer for a speed: `url` has {user} in the speed's place. A
    service that doesn't answer is an error; options as of FeedReader (retries, pause)."""
    spark.dataSource.register(FeedReader)
    told = spark.read.format("games_feed").options(**({"pause": "0"} | options), users=speed, url=url).load()
    # One row; the error is raised where the answer would be read.
    return read_leaderboard(told.select(F.when(F.col("error").isNull(), F.col("line")).otherwise(F.raise_error(F.concat(F.lit("no leaderboard: "), "error"))).alias("value")))


def collected(top: DataFrame, first: DataFrame, n: int, fetch: Callable[[DataFrame], DataFrame], *, below: int = 2200, seed: int = 42) -> DataFrame:
    """The two stages of a collection: games (`schema.GAMES`) of the players of a
    leaderboard (`top`: name), and those that `fetch` gets for `n` of their weaker opponents. A game
    that both stages have counts once for each player; games without an id all stay."""
    both = first.unionByName(fetch(diverse_players(first, top, n, below=below, seed=seed)))
    named = F.col("game_id").isNotNull()
    return both.where(named).dropDuplicates(["username", "game_id"]).unionByName(both.where(~named))


def user_games(fetched: DataFrame, user: str) -> DataFrame:
    """One user's games; an error if there are none, as nothing can be said of that user."""
    games = fetched_games(fetched.where(F.col("target") == user))[0]
    if not games.limit(1).count():
        why = fetched.where((F.col("target") == user) & F.col("error").isNotNull()).select("error").first()
        raise ValueError(f"no games of {user}" + (f": {why[0]}" if why else ""))
    return games


def fetched_games(fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of games (`flatten_feed`) and (target, error) of what FeedReader gave."""
    lines = fetched.where("line is not null").select("target", F.from_json("line", schema.FEED).alias("g")).select("target", "g.*")
    return flatten_feed(lines), fetched.where("error is not null").select("target", "error")
