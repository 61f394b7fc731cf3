import json

import pytest
from pyspark.sql import functions as F

from rookery import schema
from rookery.queries import GAME
from rookery.sources import FeedReader, collected, diverse_players, flatten_feed, games_of, openings_dim, parsed, pgn, read_feed, read_leaderboard, read_records, reject_counts, user_games
from rookery.sources.feed import fetched_games
from rookery.sources.openings import read_openings


@pytest.fixture
def dump(tmp_path):
    empty = GAME.split("\n\n")[0].replace("abcd1234", "nomoves1") + "\n\n1-0"
    bot, slow = GAME.replace('"bob"', '"BOT"'), GAME.replace("300+3", "10+0").replace("abcd1234", "slow")
    weak, variation = GAME.replace('"1600"', '"700"'), GAME.replace("abcd1234", "var").replace("2. d3", "(1... c5 { x } 2. Nf3) 2. d3 $1")
    path = tmp_path / "dump.pgn"
    path.write_text("\n\n".join([GAME, empty, bot, slow, weak, variation]) + "\n\n")
    return path


@pytest.mark.parametrize("kind", ["", ".zst"])
def test_dump_to_rows(spark, dump, kind):
    if kind:
        import zstandard

        packed = dump.with_suffix(".pgn.zst")
        packed.write_bytes(zstandard.ZstdCompressor().compress(dump.read_bytes()))
        dump = packed
    judged = pgn.judged(parsed(read_records(spark, str(dump))))
    assert {r.reason: r.n for r in reject_counts(judged).collect()} == {"kept": 2, "filtered": 2, "filtered_speed": 1, "filtered_rating": 1}
    rows = games_of(judged)
    assert rows.schema.simpleString() == schema.GAMES.simpleString()
    got = {(r.game_id, r.color): r for r in rows.collect()}
    assert len(got) == 4 and got["var", "white"].moves == got["abcd1234", "white"].moves == "e4 e5 d3 Nf6 Qh5"
    w, b = got["abcd1234", "white"], got["abcd1234", "black"]
    assert (w.username, w.result, w.user_rating, w.opponent_username, w.n_moves, w.status, w.speed, w.created_at) == ("ann", "win", 1500, "bob", 5, "resign", "blitz", 1776260521000)
    assert (b.username, b.result, b.opponent_rating, b.acpl, b.n_eval_moves, w.acpl, w.blunders) == ("bob", "loss", 1500, 10.0, 1, 180.0, 2)


def test_line_ends_of_any_kind(spark, dump):
    plain = [r.record for r in read_records(spark, str(dump)).collect()]
    other = dump.parent / "crlf.pgn"
    other.write_bytes(dump.read_bytes().replace(b"\n", b"\r\n"))
    assert [r.record for r in read_records(spark, str(other)).collect()] == plain and len(plain) == 6


def test_wide_windows_are_transcoded(spark, dump, tmp_path):
    import zstandard

    packed, out = tmp_path / "w.zst", tmp_path / "w.pgn"
    packed.write_bytes(zstandard.ZstdCompressor().compress(dump.read_bytes()))
    pgn.transcode(spark, str(packed), str(out))
    assert out.read_bytes() == dump.read_bytes()
    pgn.write_records(spark, str(out), str(tmp_path / "records"), files=3)
    assert spark.read.parquet(str(tmp_path / "records")).count() == 6


def test_samples_are_disjoint(spark, dump):
    judged = pgn.judged(parsed(read_records(spark, str(dump))))
    a, b = pgn.sample_games(judged, 3), pgn.sample_games(judged, 3, skip=3)
    assert a.count() == b.count() == 3 and a.exceptAll(a.intersectAll(b)).count() == 3 - a.intersectAll(b).count()


@pytest.fixture
def feed(tmp_path):
    def game(i, w, b, winner, rating):
        return {"id": f"g{i}", "createdAt": i, "speed": "blitz", "status": "mate", "moves": "e4 e5" if i else "", "winner": winner, "opening": {"eco": "C20", "name": "King's Pawn"} if i else None, "players": {"white": {"user": {"name": w}, "rating": 1500}, "black": {"user": {"name": b} if b else None, "rating": rating}}}

    path = tmp_path / "games.ndjson"
    path.write_text("\n".join(json.dumps(g) for g in [game(0, "Ann", "bob", "white", 1400), game(1, "cid", "ANN", None, 1700), game(2, "dee", "eve", "black", 1), game(3, "ann", None, "black", 1000)]) + "\n")
    return path


def test_feed_from_one_users_side(spark, feed):
    got = {r.game_id: r for r in flatten_feed(read_feed(spark, str(feed)), "aNN").collect()}
    assert set(got) == {"g0", "g1", "g3"}
    assert [(r.username, r.color, r.result, r.n_moves, r.opponent_username, r.opponent_rating, r.rated) for r in (got["g0"], got["g1"], got["g3"])] == [("aNN", "white", "win", 0, "bob", 1400, False), ("aNN", "black", "draw", 2, "cid", 1500, False), ("aNN", "white", "loss", 2, None, 1000, False)]
    pool = flatten_feed(read_feed(spark, str(feed)), "ann")
    known = spark.createDataFrame([("CID",)], "name string")
    assert [tuple(r) for r in diverse_players(pool, known, 5).collect()] == [("bob", 1400)]


def test_feed_reader(spark, feed):
    spark.dataSource.register(FeedReader)
    options = {"users": "ann,nobody", "url": f"file://{feed.parent}/{{user}}.ndjson", "pause": "0", "retries": "1"}
    feed.rename(feed.parent / "ann.ndjson")
    games, errors = fetched_games(spark.read.format("games_feed").options(**options).load())
    assert games.count() == 3 and [r.target for r in errors.collect()] == ["nobody"]


def test_a_bad_line_is_one_error_and_no_line_comes_twice(spark, feed):
    lines = feed.read_text().splitlines()
    (feed.parent / "ann.ndjson").write_text("\n".join([lines[0], "{not json", lines[1]]) + "\n")
    spark.dataSource.register(FeedReader)
    options = {"users": "ann", "url": f"file://{feed.parent}/{{user}}.ndjson", "pause": "0", "retries": "3"}
    got = spark.read.format("games_feed").options(**options).load().collect()
    assert [r.error is None for r in got] == [True, False, True]
    fetched = spark.read.format("games_feed").options(**options).load()
    assert user_games(fetched, "ann").count() == 2
    with pytest.raises(ValueError, match="no games of nobody"):
        user_games(fetched, "nobody")


def test_leaderboard_and_two_stages(spark, feed):
    told = json.dumps({"users": [{"username": "Ann", "title": "GM", "perfs": {"blitz": {"rating": 2900}}}, {"username": "cid", "perfs": {"blitz": {"rating": 2800}}}]})
    top = read_leaderboard(spark.createDataFrame([(told,)], "value string"))
    assert [tuple(r) for r in top.orderBy("rank").collect()] == [(1, "Ann", 2900, "GM"), (2, "cid", 2800, None)]
    first = flatten_feed(read_feed(spark, str(feed)), "ann")
    asked = []

    def fetch(players):
        asked.extend(r.name for r in players.collect())
        return flatten_feed(read_feed(spark, str(feed)), "bob")

    games = collected(top, first, 5, fetch)
    assert asked == ["bob"] and sorted((r.username, r.game_id) for r in games.collect()) == [("ann", "g0"), ("ann", "g1"), ("ann", "g3"), ("bob", "g0")]


def test_openings_dim(spark, tmp_path):
    path = tmp_path / "a.tsv"
    path.write_text("eco\tname\tpgn\nB01\tScandinavian Defense\t1. e4 d5 2. b3\nB01\tScandinavian Defense\t1. e4 d5\nA00\tBad\t1. zz\nshort\nA04\tReti \"x\"\t1. Nf3\n")
    assert {r.name: r.color for r in openings_dim(read_openings(spark, str(path))).collect()} == {"Scandinavian Defense": "black", 'Reti "x"': "white"}


def test_download_resumes(tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from rookery.sources import download as d

    data, asked, told = bytes(range(256)) * 100, [], [True]

    class Server(BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.send_response(200)
            if told[0]:
                self.send_header("Content-Length", str(len(data)))
            self.end_headers()

        def do_GET(self):
            at = int((self.headers.get("Range") or "bytes=0-")[6:-1])
            asked.append(at)
            if at >= len(data):
                self.send_response(416)
                self.send_header("Content-Range", f"bytes */{len(data)}")
                self.end_headers()
                return
            self.send_response(206 if at else 200)
            self.end_headers()
            self.wfile.write(data[at:])

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, out = f"http://127.0.0.1:{server.server_port}/x", tmp_path / "dump" / "x"
    out.parent.mkdir()
    out.write_bytes(data[:1000])
    for force in (False, False, True):
        d(url, str(out), force)
        assert out.read_bytes() == data
    assert asked == [1000, 0]
    told[0] = False  # no size: whole (refused), longer (all anew)
    for there, want in ((data, [len(data)]), (data + b"more", [len(data) + 4, 0])):
        asked.clear()
        out.write_bytes(there)
        d(url, str(out))
        assert out.read_bytes() == data and asked == want
    told[0] = True
    out.write_bytes(data + b"more")
    d(url, str(out))
    assert out.read_bytes() == data
    server.shutdown()


def test_one_pass_in_python_says_what_the_expressions_say(spark):
    import random

    from rookery.functions import accuracy, move_features

    rnd = random.Random(6)
    tokens = "e4 d5 Nf3 Qd3 Qxd5 exd5 O-O O-O-O+ Bxd8 a8=Q Qd1xd8 Qh7# Q3d4 Qdxd4 bxa8=Q+ axb8=N Kxd8 Qxd1".split()
    comments = ["", "", "", "{ [%eval 0.25] }", "{ [%eval -1.15] [%clk 0:01:00] }", "{ [%eval #-3] } { more }", "{ [%eval #4] }", "{ [%eval #0] }", "{ good move }", "{ [%eval 12.345] }", "{ [%eval 1-2] }"]
    records = [GAME, GAME.split("\n\n")[0], GAME.replace("2. d3", "(1... c5 (2. b3) { x } 2. Nf3) 2. d3 $1"), GAME.replace("\n\n1. e4", "\n\n{ before } 1. e4").replace('"ann"', '"a\\"nn"'), "", None]
    for k in range(120):
        body = " ".join(f"{i // 2 + 1}. {rnd.choice(tokens)} {rnd.choice(comments if k % 2 else [''])}" for i in range(rnd.randint(0, 40)))
        records.append(GAME.split("\n\n")[0] + "\n\n" + body + " 1-0")
    rows = spark.createDataFrame([(r,) for r in records], "record string")
    want = parsed(rows).withColumn("acc", accuracy("evals")).withColumn("mf", move_features(F.array_join("moves", " ")))
    columns = [c for c in want.columns if c not in ("acc", "mf")] + ["acc.white_acpl", "acc.white_blunders", "acc.black_acpl", "acc.black_n_eval", *(f"mf.{s}_{x}" for s in ("white", "black") for x in ("castle_ply", "castle_qside", "early_pawn")), "mf.queens_off_ply"]
    sides = [sorted(map(repr, df.where("moves is not null").select(*(F.col(c).alias(c.replace(".", "_")) for c in columns)).collect())) for df in (want, pgn.extracted(rows.where("record is not null")))]
    assert sides[0] == sides[1]
    assert pgn.extracted(rows).count() == len(records)


def test_games_without_an_id_all_stay(spark):
    blank = {f.name: None for f in schema.GAMES}
    made = lambda *ids: spark.createDataFrame([tuple((blank | {"username": "a", "game_id": i, "opponent_username": "x", "opponent_rating": 1500}).values()) for i in ids], schema.GAMES)
    top = spark.createDataFrame([("a",)], "name string")
    both = collected(top, made("1", None, None), 5, lambda names: made("1", "2", None))
    assert sorted((r.game_id or "") for r in both.collect()) == ["", "", "", "1", "2"]


def test_frames_by_many_tasks(tmp_path):
    """Wherever frames and tasks begin, also within a record's first line, each record comes once."""
    import random

    import zstandard

    from rookery.sources import frames

    rnd = random.Random(1)
    texts = [f'[Event "game {i}"]\n[White "w{i}"]\n\n1. e4 {{ not\r\n [Event }} ' + "x" * rnd.randint(0, 60) for i in range(40)]
    whole = ("\n\n".join(texts) + "\n").encode()
    pack = zstandard.ZstdCompressor(write_checksum=True).compress
    for trial in range(150):
        cuts = sorted({0, len(whole), *(rnd.randrange(len(whole)) for _ in range(rnd.randint(0, 60)))})
        if trial % 3 == 0:  # at first lines, and within them
            starts = [m + rnd.randint(0, 9) for m in range(len(whole)) if whole.startswith(b"\n[Event ", m)]
            cuts = sorted({0, len(whole), *(s for s in starts if s < len(whole))})
        path = tmp_path / f"{trial}.zst"
        skip = b"\x50\x2a\x4d\x18\x03\x00\x00\x00abc"
        path.write_bytes(skip + b"".join(pack(whole[a:b]) + skip * (rnd.random() < 0.1) for a, b in zip(cuts, cuts[1:], strict=False)))
        found = frames.find_frames(str(path))
        assert len(found) == len(cuts) - 1
        bounds = sorted({0, len(found), *(rnd.randrange(len(found)) for _ in range(9))}) if trial % 2 else list(range(len(found) + 1))
        got = [r.decode().rstrip() for a, b in zip(bounds, bounds[1:], strict=False) for r in frames.records_of(frames._Frames(str(path), found, a, b))]
        assert got == [t.rstrip() for t in texts], trial
    for bad in (b"plain text", pack(whole)[:-9]):
        path.write_bytes(bad)
        with pytest.raises(ValueError):
            frames.find_frames(str(path))


def test_frames_as_rows(spark, dump, tmp_path):
    import zstandard

    from rookery.sources import frames

    plain = sorted(r.record for r in read_records(spark, str(dump)).collect())
    at = frames.write_frames(read_records(spark, str(dump)).repartition(2), str(tmp_path / "out"), frame_records=2)
    rows = frames.read_frames(spark, at, task_bytes=1)
    assert sorted(r.record for r in rows.collect()) == plain and rows.rdd.getNumPartitions() >= 4
    one = tmp_path / "one.zst"
    one.write_bytes(zstandard.ZstdCompressor().compress(dump.read_bytes().replace(b"\n", b"\r\n")))
    rows = frames.read_frames(spark, str(one))
    assert sorted(r.record for r in rows.collect()) == plain and rows.rdd.getNumPartitions() == 1


def test_damaged_records_are_set_aside(spark):
    harm = {
        "null": "  \n", "parse:EncodingError": GAME + "�", "parse:TagError": GAME.replace('[White "', "[White "), "parse:CommentError": GAME.replace(" }", ""),
        "convert:OverflowError": GAME.replace("-2.5]", "#99999999999]"), "filtered": GAME.replace("1600", "many"),
    }
    records = spark.createDataFrame([(t,) for t in [GAME, None, *harm.values()]], "record string")
    judged = pgn.judged(pgn.quarantined(records))
    assert {r.reason: r.n for r in reject_counts(judged).collect()} == dict.fromkeys(harm, 1) | {"kept": 1, "null": 2}
    aside = {(r.reason, r.record) for r in pgn.set_aside(judged).collect()}
    assert aside == {(k, v) for k, v in harm.items() if k != "filtered"} | {("null", None)}
    assert games_of(judged).count() == 2
    legal = pgn.extracted(spark.createDataFrame([(GAME.replace("3. Qh5", "3. Qh7"),)], "record string"), board=True).first()
    assert legal.moves == ["e4", "e5", "d3", "Nf6"] and len(legal.evals) == 4 and legal.mf.white_early_pawn == 2


def test_a_table_changes_at_once_or_not_at_all(spark, tmp_path):
    from rookery.sources import published as p

    at = str(tmp_path / "t")
    with pytest.raises(ValueError, match="nothing"):
        p.published(spark, at)
    p.publish(spark.range(10), at)
    broken = spark.range(100).select(F.when(F.col("id") == 99, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("id")).alias("id"))
    for write in (p.publish, p.add_chunk):
        with pytest.raises(Exception, match="lost"):
            write(broken, at)
        assert sorted(r.id for r in p.published(spark, at).collect()) == list(range(10))
    for k in range(1, 4):
        p.add_chunk(spark.range(10 * k, 10 * k + 10), at)
    assert p.published(spark, at).count() == 40 and len(p._parts(spark, at)) == 4
    p.compact(spark, at)
    assert sorted(r.id for r in p.published(spark, at).collect()) == list(range(40)) and len(p._parts(spark, at)) == 1
    p.publish(spark.range(1000).repartition(50), at, file_bytes=64 << 20)
    assert len(p.published(spark, at).inputFiles()) == 1


def test_a_killed_feed_goes_on(spark, tmp_path):
    """Users are added as the stream runs; a batch fails midway, and is asked for again: no user is lost or comes twice."""
    from rookery.sources.feed import feed_stream

    names = tmp_path / "names"
    for u in "abcdef":
        (tmp_path / f"{u}.ndjson").write_text("".join(json.dumps({"id": f"{u}{k}"}) + "\n" for k in range(3)))
    out, failing = {}, [True]

    def put(batch, number):
        rows = batch.collect()
        if number == 1 and failing.pop():
            raise RuntimeError("killed")
        out[number] = [(r.target, json.loads(r.line)["id"]) for r in rows if r.error is None]

    def run():
        stream = feed_stream(spark, str(names), f"file://{tmp_path}/{{user}}.ndjson", pause="0", tasks="2")
        stream.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()

    failing[:] = [False, True]
    names.write_text("a\nb\n")
    run()
    names.write_text("a\nb\nc\nd\n")
    with pytest.raises(Exception, match="killed"):
        run()
    names.write_text("a\nb\nc\nd\ne\nf")  # the last name isn't whole yet
    run()
    names.write_text("a\nb\nc\nd\ne\nf\n")
    run()
    got = [x for rows in out.values() for x in rows]
    assert sorted(got) == [(u, f"{u}{k}") for u in "abcdef" for k in range(3)] and sorted(x for x, _ in out[1]) == list("cccddd")


def test_leaderboard_is_fetched(spark, tmp_path):
    from rookery.sources.feed import fetch_leaderboard

    (tmp_path / "blitz").write_text(json.dumps({"users": [{"username": "Ann", "perfs": {"blitz": {"rating": 2900}}}]}))
    url = f"file://{tmp_path}/{{user}}"
    assert [tuple(r) for r in fetch_leaderboard(spark, url, "blitz").collect()] == [(1, "Ann", 2900, None)]
    with pytest.raises(Exception, match="no leaderboard"):
        fetch_leaderboard(spark, url, "rapid", retries="0").collect()
