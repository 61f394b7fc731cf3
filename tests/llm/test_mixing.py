import numpy as np
from pyspark.sql import functions as F

from rookery.llm.mixing import mix, round_block, targets


def fill(sizes):
    """Targets by sharing the excess until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, out, open_ = float(sum(sizes.values())), {}, set(names)
    while open_:
        share = {s: (total - sum(out.values())) * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        out |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    return out


def test_targets_as_by_sharing(spark):
    rnd = np.random.default_rng(4)
    for _ in range(8):
        sizes = {("é" if i == 2 else f"s{i}") if i else None: int(x) for i, x in enumerate(np.exp(rnd.normal(5, 2, rnd.integers(1, 12))))}
        got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert got.keys() == sizes.keys() and all(abs(got[s] - t) < 1e-6 * max(1, t) for s, t in fill(sizes).items())


def test_rounding_keeps_sums_and_means():
    rnd = np.random.default_rng(5)
    sizes, p = rnd.integers(1, 500, 40), rnd.random(40)
    runs = np.array([round_block(p, sizes, seed, True) for seed in range(3000)])
    assert set(np.unique(runs)) == {0.0, 1.0}
    assert (abs(runs @ sizes - p @ sizes) <= sizes.max()).all()
    open_ = round_block(p, sizes, 1, False)
    assert ((open_ > 0) & (open_ < 1)).sum() <= 1 and abs(open_ @ sizes - p @ sizes) < 1e-6
    assert abs(runs.mean(axis=0) - p).max() < 0.12


def test_mix(spark):
    rnd = np.random.default_rng(6)
    rows = [(i, "w " * int(rnd.integers(0, 40)), ["a", "b", "c", None][min(3, int(rnd.integers(0, 8)))], "x") for i in range(3000)] + [(5000, None, "a", "x"), (None, "one two", "b", "x"), (7, "w", "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = mix(docs, block=64, fan_in=4).cache()
    assert got.count() == len(rows)
    by = {r.source: r for r in got.groupBy("source").agg(F.sum("size").alias("size"), F.first("source_size").alias("s"), F.first("target").alias("t"), F.sum("taken").alias("taken"), F.max("size").alias("m")).collect()}
    want = fill({s: r["size"] for s, r in by.items()})
    for s, r in by.items():
        assert r.s == r["size"] and abs(r.t - want[s]) < 1e-6 and abs(r.taken - r.t) <= r.m
    assert got.where("taken > 3 * size or taken % nullif(size, 0) <> 0").count() == 0
    again = mix(docs, block=64, fan_in=4)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    assert mix(docs.limit(0)).count() == 0
    assert [tuple(r) for r in mix(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).select("size", "taken", "target").collect()] == [(0, 0, 0.0)]


def test_rows_of_one_id_are_dealt_to_many_blocks(spark):
    docs = spark.createDataFrame([(None, "w " * (k % 7 + 1), "ab"[k % 2]) for k in range(4000)], "doc_id long, text string, source string")
    got = mix(docs, block=128, fan_in=4)
    by = {r.source: r for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("t")).collect()}
    assert got.count() == 4000 and all(abs(r.taken - r.t) <= 7 for r in by.values())


def test_many_sources(spark):
    sizes = {f"host{i:05d}": 1 + i % 50 for i in range(3000)}
    got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)).collect()}
    want = fill(sizes)
    assert all(abs(got[s] - t) < 1e-6 * max(1, t) for s, t in want.items())
