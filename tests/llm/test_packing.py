import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from rookery.llm.packing import numbered, pack, plan, token_pieces

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_plan(histogram, room, **options):
    steps, n = plan(histogram, room, **options)
    seen = {length: np.zeros(c, int) for length, c in histogram.items()}
    sequences = defaultdict(list)
    for length, a, b, first, offset in steps:
        seen[length][a:b] += 1
        for i in range(b - a):
            sequences[first + i].append((offset, length))
    assert all((x == 1).all() for x in seen.values()) and set(sequences) == set(range(n))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= room
    return n


def test_plans_are_gapless_and_complete():
    rnd = np.random.default_rng(5)
    for _ in range(120):
        h = {int(k): int(c) for k, c in zip(rnd.integers(1, 51, rnd.integers(0, 20)), rnd.integers(1, 60, 20), strict=False)}
        check_plan(h, 50, groups=int(rnd.integers(1, 10)))


def best_fit(histogram, room):
    """Sequences of best fit decreasing, a piece at a time."""
    left = []
    for length in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        i = bisect_left(left, length)
        if i == len(left):
            insort(left, room - length)
        else:
            insort(left, left.pop(i) - length)
    return len(left)


def test_never_more_than_best_fit_decreasing():
    rnd = np.random.default_rng(6)
    n = 3000
    mixes = {
        "uniform": rnd.integers(1, 2049, n), "spike": np.clip(rnd.normal(683, 30, n), 1, 2048), "lognormal": np.clip(np.exp(rnd.normal(6, 1, n)) + 1, 1, 2048),
        "two kinds": np.where(rnd.random(n) < 0.5, rnd.integers(1000, 1100, n), rnd.integers(300, 400, n)), "equal": np.full(n, 700), "small": rnd.integers(1, 40, n),
    }
    found = {}
    for name, lengths in mixes.items():
        h = dict(Counter(lengths.astype(int).tolist()))
        found[name] = check_plan(h, 2048), best_fit(h, 2048)
        assert found[name][0] <= found[name][1], name
    assert found["spike"][0] < 0.97 * found["spike"][1]  # where configurations help
    for _ in range(60):
        h = {int(k): int(c) for k, c in zip(rnd.integers(1, 51, 12), rnd.integers(1, 60, 12), strict=True)}
        assert check_plan(h, 50, groups=int(rnd.integers(1, 10))) <= best_fit(h, 50)


def test_null_ids_are_spread(spark):
    rows = [(None, 0, 0, 7, k) for k in range(4000)]
    got = pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), room=20)
    assert got.count() == 4000 and got.select("sequence_id").distinct().count() == 2000
    dealt = numbered(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, row long"))[0]
    assert sorted(r.n for r in dealt.collect()) == list(range(4000))


def test_scans_that_are_split_otherwise(spark):
    """The histogram is read with one split of the files, the pieces with another, as when executors come or go."""
    rnd = random.Random(8)
    rows = [(i, 0, 0, rnd.choice([3, 5, 8, 13]), i) for i in range(5000)]
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "4k")
        got = pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(7), room=21)
        spark.conf.set(name, "64m")
        found = got.collect()
    finally:
        spark.conf.set(name, before)
    ends = defaultdict(int)
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert len(found) == len(rows) and max(ends.values()) <= 21


def test_rows(spark):
    rnd = random.Random(7)
    rows = [(i, " ".join(rnd.choice(["red", "tree", "running", "é"]) for _ in range(rnd.randint(0, 400))), "s") for i in range(60)] + [(60, "w " * 9000, None), (61, None, "x"), (61, None, "x"), (None, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = pack(token_pieces(docs, PATH, room=256), room=256).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for i, text, _ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i or -1, k, at, len(ids[at : at + 256]), zlib.crc32(ids[at : at + 256].tobytes())) for k, at in enumerate(range(0, len(ids), 256))]
    assert sorted((-1 if r.doc_id is None else r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    ends = defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 256 and len(ends) <= -(-sum(r.length for r in got) // 256) + 2
    assert pack(token_pieces(docs.limit(0), PATH)).count() == 0
