import pytest
from pyspark.sql import functions as F

from rookery import functions as f
from rookery.functions.moves import centipawns


def one(spark, **columns):
    kinds = ", ".join(f"{n} {k}" for n, (_, k) in columns.items())
    return spark.createDataFrame([tuple(v for v, _ in columns.values())], kinds)


def test_scores(spark):
    row = one(spark, result=("win", "string"), user_rating=(1500, "int"), opponent_rating=(1600, "int"))
    assert row.select(f.expected_score()).first()[0] == pytest.approx(0.359935000197)
    assert row.select(f.residual()).first()[0] == pytest.approx(0.640064999803)
    assert row.select(f.actual_score(F.lit(None).cast("string"))).first()[0] == 0.0
    assert row.select(f.shrink(F.lit(30000), F.lit(0.04), 30000)).first()[0] == pytest.approx(0.02)


@pytest.mark.parametrize("clock, speed", [("600+0", "rapid"), ("179+0", "bullet"), ("180+0", "blitz"), ("300+5", "rapid"), ("1500+0", "classical"), ("15+0", "ultraBullet"), ("-", None), ("a+b", None), ("", None), ("300", None), ("300+3+1", None)])
def test_speed(spark, clock, speed):
    assert one(spark, c=(clock, "string")).select(f.speed_bucket("c")).first()[0] == speed


@pytest.mark.parametrize("end, result, moves, want", [("Time forfeit", "1/2-1/2", "", "outoftime"), ("Abandoned", "1-0", "", "noStart"), ("Normal", "1/2-1/2", "e4", "draw"), ("Normal", "1-0", "e4 Qh7#", "mate"), ("Normal", "1-0", "e4 Qh7#1-0 ", "mate"), ("Normal", "0-1", "e4 Kf8", "resign"), ("Rules infraction", "1-0", "Kf8", "resign"), ("Normal", "1-0", "", "resign")])
def test_status(spark, end, result, moves, want):
    row = one(spark, t=(end, "string"), r=(result, "string"), m=(moves, "string"))
    assert row.select(f.status("t", "r", "m")).first()[0] == want


@pytest.mark.parametrize(
    "moves, want",
    [
        ("e4 e5 Nf3", (None, None, False, None, 1, 1)),
        ("e4 d5 exd5 Qxd5 Qf3 Qxf3 Nxf3", (None, None, False, 7, 2, 1)),
        ("e4 d5 exd5 Qxd5 Nc3 Qxd2+ Qxd2", (None, None, False, None, 2, 1)),
        ("e4 e5 Nf3 Nc6 Bc4 Bc5 O-O Nf6", (7, None, False, None, 1, 1)),
        ("d4 d5 Nc3 Nc6 Bf4 Bf5 Qd2 Qd7 O-O-O O-O-O", (9, 10, True, None, 1, 1)),
        ("a4 b5 axb5 a6 bxa6 Nc6 a7 Nb8 axb8=Q Rxa1 Qxc8 Qxc8", (None, None, False, 12, 5, 2)),
        ("", (None, None, False, None, 0, 0)),
        (None, (None, None, False, None, 0, 0)),
    ],
)
def test_moves(spark, moves, want):
    m = one(spark, moves=(moves, "string")).select(f.move_features().alias("m")).select("m.*").first()
    got = (m.white_castle_ply, m.black_castle_ply, m.white_castle_qside, m.queens_off_ply, m.white_early_pawn, m.black_early_pawn)
    # In the sixth line White's queen from a pawn is taken, but the first one stays: queens aren't off.
    assert got == (want if not moves or not moves.startswith("a4") else (*want[:3], None, *want[4:]))


def test_accuracy(spark):
    a = one(spark, e=([20, 30, -250, None, -240], "array<int>")).select(f.accuracy("e").alias("a")).select("a.*").first()
    assert (a.white_acpl, a.white_blunders, a.white_n_eval, a.black_acpl, a.black_blunders, a.black_n_eval) == (180.0, 2, 3, 10.0, 0, 1)
    assert one(spark, e=([None, None], "array<int>")).select(f.accuracy("e")).first()[0] is None
    b = one(spark, e=([None, 5000], "array<int>")).select(f.accuracy("e").alias("a")).select("a.*").first()
    assert b.white_acpl is None and b.black_acpl == 1000.0 and b.black_blunders == 1


@pytest.mark.parametrize("text, cp", [("[%eval 0.17] [%clk 0:01]", 17), ("[%eval -2.5]", -250), ("[%eval #3]", 9997), ("[%eval #-3]", -9997), ("none", None), ("", None)])
def test_evaluations(spark, text, cp):
    assert one(spark, c=(text, "string")).select(centipawns(F.col("c"))).first()[0] == cp


def test_openings(spark):
    names = {"Sicilian Defense: Najdorf Variation": ("Sicilian Defense", "black"), "\t Italian Game ": ("Italian Game", "white"), "GRÜNFELD": ("GRÜNFELD", "black"), "Foo Indian: Bar": ("Foo Indian", "black")}
    for name, want in names.items():
        assert tuple(one(spark, n=(name, "string")).select(f.family("n"), f.fallback_color("n")).first()) == want
    for pgn, who, n in (("1. e4 c5", "black", 2), ("1. e4", "white", 1), ("", "black", 0), ("1. e4 zz", None, 2)):
        assert tuple(one(spark, p=(pgn, "string")).select(f.last_mover("p"), f.ply_count("p")).first()) == (who, n)


def test_dates_and_labels(spark):
    row = one(spark, d=("2026.04.15", "string"), t=("13:42:01", "string"), s=("https://lichess.org/abc/white", "string"))
    assert row.select(f.epoch_ms("d", "t")).first()[0] == 1776260521000
    assert row.select(f.epoch_ms("t", "d")).first()[0] is None
    assert row.select(f.game_id("s"), f.game_id("d")).first()[:] == ("abc", None)
    assert row.select(f.clock_label(F.lit(300), F.lit(3))).first()[0] == "5+3"
    assert row.select(f.iso_date(F.lit(1776260521000)), f.iso_date(F.lit(None).cast("bigint"))).first()[:] == ("2026-04-15", None)
    assert row.select(f.display_result(F.lit(None).cast("string"), F.lit(True)), f.display_result(F.lit("black"), F.lit(False))).first()[:] == ("½", "win")
    assert row.select(f.eco_letter(F.lit("B07")), f.eco_number(F.lit("B07")), f.eco_number(F.lit("Bxx"))).first()[:] == ("B", 7, None)


def test_rounding_by_the_binary_value(spark):
    import random

    from rookery.functions import round_binary

    rnd = random.Random(2)
    values = [0.00015, 0.00025, -0.00015, 2.675, 0.5, 1.5, 0.0, -0.0, 1e300, float("inf"), float("nan"), 0.12345, 0.99995, 123456.00005, None]
    values += [rnd.randrange(-10**6, 10**6) / 20000 for _ in range(3000)] + [rnd.uniform(-1, 1) for _ in range(1000)] + [rnd.randrange(1, 1 << 20) / (1 << 12) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 2, 4):
        for r in df.select("x", round_binary("x", digits).alias("r")).collect():
            want = r.x if r.x is None or r.x != r.x or abs(r.x) == float("inf") else round(r.x, digits)
            assert r.r == want or (want is not None and want != want and r.r != r.r), (r.x, digits, r.r)


def test_sizes(spark):
    from rookery.functions import byte_label

    sizes = {0: "0.0 B", 1023: "1023.0 B", 1024: "1.0 KB", 1280: "1.2 KB", 1792: "1.8 KB", 30 * 1024**3: "30.0 GB", 5 * 1024**6: "5120.0 PB"}
    df = spark.createDataFrame([(n,) for n in [*sizes, None]], "n long")
    assert {r.n: r.label for r in df.select("n", byte_label("n").alias("label")).collect()} == sizes | {None: None}
