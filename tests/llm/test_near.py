import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rookery.llm import cover_tree, minhash
from rookery.llm.base import stage
from rookery.llm.links import components


def reach(nodes, links):
    at = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(at[a], at[b])
            if at[a] != low or at[b] != low:
                at[a] = at[b] = low
                changed = True
    return at


def test_components(spark):
    rnd = np.random.default_rng(7)
    links = [(int(a), int(b)) for a, b in rnd.integers(0, 400, (250, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5)]
    want = reach({n for link in links for n in link}, links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got.get(n, n) == c for n, c in want.items())
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_sketches_estimate_probability_jaccard():
    rnd = np.random.default_rng(8)
    a, b = rnd.integers(1, 1 << 62, 60).astype(np.uint64), rnd.integers(1, 1 << 62, 30).astype(np.uint64)
    x = dict.fromkeys(a.tolist(), 1.0)
    y = {k: 1.0 + (i % 3) for i, k in enumerate(a[:45].tolist())} | dict.fromkeys(b.tolist(), 2.0)
    exact = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())
    owner = np.repeat([0, 1], [len(x), len(y)])
    keys, weight = np.array([*x, *y], np.uint64), np.array([*x.values(), *y.values()])
    held = minhash.prob_minhash(owner, keys, weight, 2, 4096)
    assert abs((held[0] == held[1]).mean() - exact) < 0.03


def brute(rows, size=5, similarity=0.8):
    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    texts = [(i, t, shingles(t)) for i, t in rows if t is not None]
    links = [(a, b) for (a, t, x), (b, u, y) in itertools.combinations(texts, 2) if t == u or (x and y and len(x & y) >= similarity * len(x | y))]
    return reach({i for i, _ in rows}, links)


def variants(rnd, base, n, rate):
    return [" ".join(w if rnd.random() > rate else f"x{rnd.integers(1 << 30)}" for w in base) for _ in range(n)]


@pytest.mark.parametrize("rate, block", [(0.01, 256), (0.03, 8)])
def test_near_duplicates_as_brute_force(spark, rate, block):
    rnd = np.random.default_rng(9)
    word = lambda: f"w{rnd.integers(3000)}"
    texts = ["", "", " \n", None, None, "one two", "one two", "one  two", "one two three"]
    for _ in range(25):
        texts.append(" ".join(word() for _ in range(int(rnd.integers(1, 120)))))
    texts += variants(rnd, [word() for _ in range(120)], 90, rate) + [texts[-1]] * 30
    rows = [(int(i), t) for i, t in zip(rnd.permutation(len(texts)), texts, strict=True)]
    docs = spark.createDataFrame(rows, "id long, body string").select(F.col("id").alias("doc_id"), F.col("body").alias("text"), F.lit("clash").alias("component_id"))
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, block=block).collect()}
    assert {i: r.component_id for i, r in got.items()} == brute(rows)
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_copies_that_repeat_a_passage(spark):
    rnd = np.random.default_rng(13)
    rows = []
    for k in range(40):  # the second of a pair has 30 of its 100 words 200 times
        words = [f"p{k}w{rnd.integers(1 << 30)}" for _ in range(100)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:30] * 200 + words[30:90] + [f"n{k}x{j}" for j in range(6)]))]
    want = brute(rows)
    assert want == {i: i - i % 2 for i, _ in rows}
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_very_long_texts(spark):
    rnd = np.random.default_rng(12)
    base = [f"w{k}" for k in rnd.integers(0, 5000, 60_000)]
    one, two = variants(rnd, base, 2, 0.005)
    far = " ".join(w if rnd.random() > 0.05 else "other" for w in base)
    line = "x" * 1_000_000
    rows = [(1, one), (2, two), (3, far), (4, " ".join(reversed(base))), (5, line), (6, line), (7, line[1:]), (8, "y " * 300_000), (9, "y " * 299_000), (10, "y y y y y")]
    want = brute(rows)
    assert want[2] == 1 and want[3] == 3 and want[7] == 7 and want[9] == 8
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_ids_that_are_null_or_repeat(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "q r s t u v"), (9, "q r s t u v"), (2, "a b c d e f"), (7, None)], "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == {None: (None, True), 2: (2, True), 5: (2, False), 9: (2, False), 7: (7, True)}
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_dual_traversal_finds_all_pairs():
    rnd = np.random.default_rng(10)
    centres = rnd.normal(size=(20, 16))
    x = np.repeat(centres, 30, axis=0) + rnd.normal(size=(600, 16)) * rnd.choice([0.05, 0.3], (600, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for cosine in (0.7, 0.93, 0.99):
        want = {(i, j) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= cosine, 1)), strict=True)}
        got = [(i, j) for a, b in cover_tree.near_pairs(x, None, cosine) for i, j in zip(a, b, strict=True)]
        assert len(got) == len(set(got)) and {(min(p), max(p)) for p in got} == want
        across = {(i, j) for a, b in cover_tree.near_pairs(x[:250], x[250:], cosine) for i, j in zip(a, b, strict=True)}
        assert across == {(i, j - 250) for i, j in want if i < 250 <= j}


def covering(node, points):
    assert cover_tree.distances(points[node.members], points[[node.centre]]).max() <= node.radius + 1e-9
    for c in node.children:
        assert c.radius <= node.radius / 2 + 1e-9
        covering(c, points)
    if node.children:
        assert sorted(np.concatenate([c.members for c in node.children])) == sorted(node.members)


def test_radii_cover_and_halve():
    x = np.random.default_rng(11).normal(size=(500, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    covering(cover_tree.tree(x), x)


def test_embeddings_as_brute_force(spark):
    rnd = np.random.default_rng(12)
    base = rnd.normal(size=(12, 8))
    rows = [(i, (base[rnd.integers(12)] + rnd.normal(size=8) * 0.15).tolist(), int(rnd.integers(2))) for i in range(150)]
    rows += [(200 + i, [1.0] * 8, 1) for i in range(12)] + [(300, [2.0] * 8, 1), (301, [2.0] * 8, None), (302, None, 1), (303, [0.0] * 8, 1), (304, [float("nan")] + [1.0] * 7, 1), (305, [None] + [1.0] * 7, 1), (306, [float("inf")] * 8, 1), (307, [1.0] * 7, 1), (308, [], 1), (309, [1e300] * 8, 1), (None, [1.0] * 8, 1)]
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    unit = {i: np.array(v) / max(map(abs, v)) for i, v, _ in ok}
    links = [(a[0], b[0]) for a, b in itertools.combinations(ok, 2) if a[2] == b[2] and len(a[1]) == len(b[1]) and unit[a[0]] @ unit[b[0]] / np.sqrt((unit[a[0]] ** 2).sum() * (unit[b[0]] ** 2).sum()) >= 0.93]
    want = reach([r[0] for r in rows if r[0] is not None], links)
    n = dict.fromkeys(want, 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit("clash"))
    for block, sample, centres in ((2048, 2048, 64), (8, 40, 4), (8, 0, 64)):
        got = {r.vec_id: r for r in cover_tree.near_embeddings(df, block=block, sample=sample, centres=centres).collect()}
        assert {i: r.component_id for i, r in got.items() if i is not None} == want
        assert {i: r.n_links for i, r in got.items() if i is not None} == n and got[None].kept and got[None].n_links == 0
    assert cover_tree.near_embeddings(df.limit(0)).count() == 0


def test_pairs_of_nodes_grow_in_proportion(spark):
    """Tight groups far apart, none smaller than a task's node: node pairs are dropped before vectors move, and those that are left grow with the vectors."""
    rnd = np.random.default_rng(14)
    reach, left = float(np.sqrt(2 - 2 * 0.93)), {}
    for groups in (40, 160):
        centres = rnd.normal(size=(groups, 16))
        x = np.repeat(centres, 50, axis=0) + rnd.normal(size=(groups * 50, 16)) * 0.01
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        rows = spark.createDataFrame([("a", 16, i, i, 1, p.tolist()) for i, p in enumerate(x)], "label string, dim int, id long, lead long, copies long, unit array<double>")
        placed, nodes, pairs = cover_tree._trees(stage(rows, "x"), reach, 40, 512, 16, 16)
        sizes = {r.path: r.n for r in nodes.collect()}
        at = {r.id: r.path for r in placed.select("id", "path").collect()}
        met = {(r.path, r.path2) for r in pairs.collect()}
        assert len(at) == len(x) and sum(sizes.values()) == len(x)
        near = np.argwhere(np.triu(x @ x.T >= 0.93, 1))
        assert all((at[i], at[j]) in met or (at[j], at[i]) in met for i, j in near[:: max(1, len(near) // 2000)].tolist())
        left[groups] = sum(sizes[a] + sizes[b] * (a != b) for a, b in met)
    assert left[160] < 8 * left[40], left  # all pairs would be 16 times as many


@pytest.mark.parametrize("spread", [0.0015, 0.012, 0.036, 0.05])
def test_dense_clusters_take_no_step_a_pair(spread):
    """2,048 vectors that all link, most or in part: links, groups and pairs are those of one product of matrices."""
    rnd = np.random.default_rng(15)
    x = rnd.normal(size=(1, 64)) / 8 + rnd.normal(size=(2048, 64)) * spread
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    copies = rnd.integers(1, 4, len(x))
    began = time.process_time()
    links, label = cover_tree.links_of(x, None, 0.93, copies)
    took = time.process_time() - began
    assert (links == near @ copies).all() and took < 8, took
    want = np.arange(len(x))
    for i in range(len(x)):
        if want[i] == i:
            group, new = np.zeros(len(x), bool), np.arange(len(x)) == i
            while new.any():
                group |= new
                new = near[new].any(axis=0) & ~group
            want[group] = i
    assert (label == want).all()
    across, label = cover_tree.links_of(x[:900], x[900:], 0.93, copies)
    assert (across == np.concatenate([near[:900, 900:] @ copies[900:], near[900:, :900] @ copies[:900]])).all()


def test_nodes_that_are_near_as_wholes(spark):
    rnd = np.random.default_rng(16)
    base = rnd.normal(size=(6, 8))
    rows = [(int(i), (base[i % 6] + rnd.normal(size=8) * 0.02).tolist(), int(i % 2)) for i in rnd.permutation(240)] + [(300 + i, base[0].tolist(), 0) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows]))
    np.fill_diagonal(near, False)
    ids = [r[0] for r in rows]
    want = reach(ids, [(ids[i], ids[j]) for i, j in np.argwhere(near)])
    got = {r.vec_id: r for r in cover_tree.near_embeddings(df, block=8, sample=60, centres=6).collect()}
    assert {i: (r.component_id, r.n_links) for i, r in got.items()} == {i: (want[i], int(n)) for i, n in zip(ids, near.sum(axis=1), strict=True)}
