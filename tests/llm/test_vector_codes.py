import math
import random

import numpy as np

from rookery.llm import vector_codes


def brute(rows, parts, entries, rounds, scale=4096):
    """With Python's own integers, one vector and entry after another."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    m = len(kept[0][1]) // parts
    cut = lambda q: [tuple(q[p * m : p * m + m]) for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    book = [[cut(q)[p] for _, q, _ in first] for p in range(parts)]
    near = lambda x, centres: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        for p in range(parts):
            mine = [[] for _ in book[p]]
            for _, q, _ in kept:
                mine[near(cut(q)[p], book[p])[1]].append(cut(q)[p])
            book[p] = [tuple(sum(c) // len(x) for c in zip(*x, strict=True)) if x else old for x, old in zip(mine, book[p], strict=True)]
    out = []
    for i, q, label in kept:
        found = [near(x, book[p]) for p, x in enumerate(cut(q))]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    sums = {}
    for _, _, e, label in out:
        sums[label] = sums.get(label, 0) + e
    return sorted(((i, c, e, sums[label]) for i, c, e, label in out), key=str), book


def test_as_brute_force(spark):
    rnd = random.Random(7)
    rows = [(i, [rnd.choice([-1, 1]) * rnd.random() ** 3 for _ in range(12)], rnd.choice([None, 1, 2])) for i in range(5, 150)]
    rows += [(200 + i, [0.25, -0.25] * 6, 1) for i in range(20)] + [(None, [0.5] * 12, 3), (5, [0.125] * 12, 3)]
    bad = [(1, None, 1), (2, [], 1), (3, [None] + [0.0] * 11, 1), (4, [float("nan")] + [0.0] * 11, 1), (500, [float("inf")] * 12, 2)]
    df = spark.createDataFrame([(*r, "clash") for r in rows + bad], "vec_id long, embedding array<double>, label int, code string")
    for entries in (1, 7, 16):
        want, book = brute(rows + bad, 4, entries, 3)
        got = vector_codes.code_table(df, parts=4, entries=entries, rounds=3).collect()
        assert sorted((tuple(r)[:4] for r in got), key=str) == want
        assert {r.codebooks_sha256 for r in got} == {vector_codes.book_digest(np.array(book))}


def test_unusual_tables(spark):
    kinds = "vec_id long, embedding array<float>, label string"
    assert vector_codes.code_table(spark.createDataFrame([], kinds)).count() == 0
    assert vector_codes.code_table(spark.createDataFrame([(1, None, "a")], kinds)).count() == 0
    rows = [(1, [0.5] * 10, "a"), (2, [1.0] * 10, None), (3, [0.5] * 9, "a"), (4, [1e30] * 10, "a"), (5, [-1.0] * 10, "b")]
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in vector_codes.code_table(spark.createDataFrame(rows, kinds)).collect()}
    assert got == {1: ("00" * 8, 0, 0), 2: ("01" * 5 + "00" * 3, 0, 0), 4: (None, None, 0), 5: ("02" * 5 + "00" * 3, 0, 0)}


def test_distances_are_exact():
    rnd = np.random.default_rng(8)
    x, book = rnd.integers(-(1 << 27), 1 << 27, (50, 2, 8)), rnd.integers(-(1 << 27), 1 << 27, (2, 5, 8))
    entry, far = vector_codes.nearest(x, book)
    for i in range(50):
        for p in range(2):
            d = [sum((int(a) - int(b)) ** 2 for a, b in zip(x[i, p], c, strict=True)) for c in book[p]]
            assert (entry[i, p], far[i, p]) == (d.index(min(d)), min(d))
