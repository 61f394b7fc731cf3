import itertools
import json
import os
import subprocess
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from rookery import queries, schema
from rookery.operators import compare, features, rankings, sampling
from rookery.plans import density, models, neighbours
from rookery.shared import stage
from rookery.streaming import blocks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def key(rows):
    return sorted((tuple(None if v is None or v != v else v for v in r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert key(map(tuple, df.select(names).collect())) == key(want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() >= 0 and set(entry.oracle_sql()) <= set(entry.queries())


def row(name, color="white", **more):
    base = {f.name: None for f in schema.GAMES} | {"username": name, "color": color, "result": "win", "status": "mate", "n_moves": 30, "moves": "e4 e5", "opening_eco": "B20", "opening_name": "Sicilian Defense: X", "user_rating": 1500, "opponent_rating": 1500, "has_eval": False}
    return tuple((base | more)[f.name] for f in schema.GAMES)


def test_features_of_few_games(spark):
    games = spark.createDataFrame([row("a"), row("a", opening_eco=None, has_eval=True, acpl=50.0, n_eval_moves=10, blunders=1), row("a", has_eval=True, n_eval_moves=0), row("b", "black", moves="e4 c5 O-O", opening_eco="B1x")], schema.GAMES)
    got = {r.username: r for r in features.player_features(games, 1).collect()}
    assert (got["a"].n_games, got["a"].opening_diversity, got["a"].acpl, got["a"].blunder_rate, got["a"].black_score_residual) == (3, pytest.approx(2 / 3), 50.0, 0.1, None)
    assert got["b"].pct_sicilian_as_black == 0.0 and got["b"].pct_e4_as_white is None and got["b"].acpl is None
    filled = {r.username: r for r in features.impute(features.player_features(games, 1)).collect()}
    assert filled["a"].black_score_residual == filled["a"].score_residual and filled["b"].pct_e4_as_white == got["a"].pct_e4_as_white
    stored = features.imputation_means(features.player_features(games, 1))
    assert features.impute(features.player_features(games.where("username = 'b'"), 1), stored).first().pct_e4_as_white == got["a"].pct_e4_as_white
    assert set(schema.V2_21) <= set(features.player_features(games, 1).columns) and len(schema.V1_18) == 18


def test_owner_by_family_first(spark):
    names = ["Sicilian Defense: Najdorf, English Attack", "Italian Game: Two Knights Defense", "Foo Indian: Bar", "Foo Opening", "Odd: Full"]
    games = spark.createDataFrame([row("a", opening_name=n) for n in names], schema.GAMES)
    dim = spark.createDataFrame([("Sicilian Defense", "black"), ("Italian Game", "white"), ("Odd: Full", "black")], "name string, color string")
    assert {r.opening_name: r.owner for r in rankings.with_owner(games, dim).collect()} == dict(zip(names, ["black", "white", "black", "white", "black"], strict=True))


def test_document_and_answers(spark):
    document = queries.q_recommendation_document(spark, SF).first()
    assert document.k == 5 == len(document.clusters) and document.feature_columns == schema.V2_21
    assert [c.id for c in document.clusters] == sorted(c.id for c in document.clusters) and document.clusters[0].name == "Cluster 0"
    answers = [json.loads(r.json) for r in queries.q_recommend_answer(spark, SF).collect()]
    assert answers and all(a["mode"] == "cluster" and len(a["feature_comparison"]) == 21 for a in answers)
    v = json.loads(queries.q_versus(spark, SF).first().json)
    deltas = [abs(x["delta"]) for x in v["feature_comparison"]]
    assert deltas == sorted(deltas, reverse=True) and set(v["matchups"]) == {"a_white_b_black", "b_white_a_black"}


def test_knn_from_games_and_blocks(spark):
    d = SF
    from rookery.view import games, openings

    g, dim = games(spark, d), openings(spark, d)
    filled = features.impute(features.player_features(g, 20))
    rows = models.vectors(filled, "username", schema.V1_18)
    rows = models.scale(rows, models.fit_scaler(rows))
    q = F.array(*map(F.lit, rows.orderBy("id").first().features))
    args = {"min_games": 20, "top_n": 5, "shrinkage_k": 100}
    a = neighbours.recommend_from_games(rows, q, g, k=30, exclude="C1", dim=dim, **args)
    b = neighbours.recommend_from_blocks(rows, q, rankings.family_blocks(g, dim=dim), k=30, exclude="C1", **args)
    assert [(r.color, r.name, r.n, round(r.score_residual, 9)) for r in a.orderBy("color", "rank").collect()] == [(r.color, r.name, r.n, round(r.score_residual, 9)) for r in b.orderBy("color", "rank").collect()]
    near = neighbours.nearest(rows, q, 30).join(filled.select(F.col("username").alias("id"), "avg_rating"), "id")
    player = spark.createDataFrame([("C1", 1500.0, 40)], "username string, avg_rating double, n_games_used int")
    answer = json.loads(compare.knn_answer(player, near, a).first().json)
    assert answer["cluster"]["id"] is None and answer["cluster"]["size"] == 30 and answer["feature_comparison"] == []
    assert neighbours.neighbour_ratings(near).first().k == 30


def blobs(spark, n=60, seed=0):
    rnd = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0], [8, 0, 0], [0, 8, 8]])
    return spark.createDataFrame([(i, (centres[i % 3] + rnd.normal(size=3) * 0.4).tolist()) for i in range(3 * n)], "id long, features array<double>")


def test_models(spark, tmp_path):
    rows = blobs(spark)
    scaled = models.scale(rows, models.fit_scaler(rows))
    stats = models.fit_scaler(scaled)
    assert all(abs(m) < 1e-9 and abs(s - 1) < 1e-9 for m, s in stats)
    centres = models.fit_kmeans(rows, 3, restarts=3)
    told = models.assign(rows, centres)
    assert sorted(r["count"] for r in told.groupBy("cluster").count().collect()) == [60, 60, 60]
    for r in models.lloyd_step(told).collect():
        assert np.allclose(r.centre, centres[r.cluster], atol=1e-3)
    sweep = {r.k: r for r in models.k_sweep(rows, 2, 4, restarts=2).collect()}
    assert sweep[3].silhouette == max(r.silhouette for r in sweep.values()) and sweep[2].inertia > sweep[3].inertia
    bic = {r.k: r for r in models.gmm_sweep(rows, 2, 4, restarts=2).collect()}
    assert min(bic, key=lambda k: bic[k].bic) == 3 and bic[3].mean_max_responsibility > 0.99 and bic[3].entropy < 0.05
    pcs, shares, running = models.pca(rows, 2)
    assert 0.9 < running[-1] <= 1 and abs(pcs.select(F.avg(F.col("pcs")[0])).first()[0]) < 1e-9
    again = [centres[i] for i in (2, 0, 1)]
    assert models.match_clusters(centres, again) == [(0, 1), (1, 2), (2, 0)]
    models.save_model(spark, str(tmp_path / "m"), ["a", "b", "c"], stats, centres)
    assert models.load_model(spark, str(tmp_path / "m"))["columns"] == ["a", "b", "c"]
    with pytest.raises(ValueError, match="missing"):
        models.vectors(rows, "id", ["nope"])


def test_queries_in_blocks(spark):
    rows = blobs(spark, 10)
    one, many = (sorted(map(tuple, neighbours.nearest_many(rows, rows, 2, block=b).collect())) for b in (4096, 12))
    assert one == many and len(many) == 60


def test_silhouette_of_all_rows(spark):
    rows = blobs(spark, 10).withColumn("cluster", F.when(F.col("id") == 0, 9).otherwise((F.col("id") % 2).cast("int")))
    assert models.silhouette(rows, block=7).first()[0] == pytest.approx(models.silhouette(rows).first()[0], abs=1e-9)
    large = spark.range(10_100).select("id", F.array((F.col("id") % 7).cast("double")).alias("features"), (F.col("id") % 2).cast("int").alias("cluster"))
    x, c = np.arange(10_100) % 7, np.arange(10_100) % 2
    n = np.array([[((x == v) & (c == k)).sum() for v in range(7)] for k in (0, 1)])
    near = np.abs(np.arange(7)[:, None] - np.arange(7)[None]) @ n.T
    a, b = near[x, c] / (n.sum(axis=1)[c] - 1), near[x, 1 - c] / n.sum(axis=1)[1 - c]
    assert models.silhouette(large).first()[0] == pytest.approx(((b - a) / np.maximum(a, b)).mean(), abs=1e-12)


def test_silhouette_by_products(spark, monkeypatch):
    """Distances by one product of matrices, exact for copies and far from the origin; blocks meet rows that are spread over tasks."""
    rnd = np.random.default_rng(4)
    y = rnd.normal(size=(4000, 64))
    y[:9] = y[0]
    x = y[:64]
    exact = np.sqrt(sum((x[:, k, None] - y[None, :, k]) ** 2 for k in range(64)))
    assert (models.between(x, y)[:9, :9] == 0).all() and np.allclose(models.between(x, y), exact, rtol=1e-8, atol=0)
    assert np.allclose(models.between(x + 1e4, y + 1e4), exact, rtol=1e-7, atol=1e-9)
    assert models.between(x, y[:0]).shape == (64, 0)
    codes = np.arange(4000) % 3
    assert np.allclose(models.cluster_sums(x, y, codes, 3), np.stack([exact[:, codes == c].sum(axis=1) for c in range(3)], axis=1))
    monkeypatch.setattr(models, "TASK_ROWS", 10)
    rows = blobs(spark, 40).withColumn("cluster", (F.col("id") % 3).cast("int")).coalesce(1)
    spark.sparkContext.setJobGroup("spread", "spread")
    found = models.silhouette(rows, block=100).first()[0]
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(i) for j in tracker.getJobIdsForGroup("spread") for i in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) >= 12
    assert found == pytest.approx(models.silhouette(rows).first()[0], abs=1e-12)


def test_sums_of_pairs_both_ways(monkeypatch):
    """Each distance is worked out once for both rows, over pieces of either side; copies are 0 apart."""
    monkeypatch.setattr(models, "SIDES", (16, 24))
    rnd = np.random.default_rng(5)
    a, b = rnd.normal(size=(50, 6)) + 1e4, rnd.normal(size=(70, 6)) + 1e4
    b[:9] = a[3]
    shares = rnd.integers(0, 4, size=(50, 3)).astype(float), rnd.integers(0, 4, size=(70, 5)).astype(float)
    exact = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    there, back = models.pair_sums(a, b, *shares)
    assert np.allclose(there, exact @ shares[1], rtol=1e-9) and np.allclose(back, exact.T @ shares[0], rtol=1e-9)
    assert models.pair_sums(a[3:4], b[:9], None, np.ones((9, 1)))[0][0, 0] == 0 and models.pair_sums(a[:0], b, None, shares[1])[0].shape == (0, 5)


def test_silhouettes_of_several_columns(spark):
    """Of the same distances, in blocks and with copies met as one, as by brute force; a row of no cluster counts 0."""
    rnd = np.random.default_rng(6)
    x = rnd.integers(0, 3, size=(60, 2)).astype(float)
    labels = [[None if i == 7 else i % 3 for i in range(60)], ["alone" if i == 11 else f"c{i % 2}" for i in range(60)]]
    rows = spark.createDataFrame([(i, x[i].tolist(), labels[0][i], labels[1][i]) for i in range(60)], "id long, features array<double>, u int, v string")

    def plain(own):
        far, out = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), []
        for i, c in enumerate(own):
            of = {k: [far[i, j] for j in range(60) if own[j] == k and (j != i)] for k in set(own) - {None}}
            if c is None or not of[c]:
                out.append(0.0)
                continue
            p, q = np.mean(of[c]), min(np.mean(v) for k, v in of.items() if k != c)
            out.append((q - p) / max(p, q) if max(p, q) else 0.0)
        return np.mean(out)

    for block in (models.BLOCK, 7):
        assert tuple(models.silhouettes(rows, ["u", "v"], block=block).first()) == pytest.approx([plain(own) for own in labels], abs=1e-12)
    assert models.silhouettes(rows.where("id < 0"), ["u"]).first().u is None


def test_runs_of_kmeans_share_their_rounds(spark, monkeypatch):
    """All runs of a sweep pass over the rows together, from tasks of all cores, and end where MLlib's do."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rnd = np.random.default_rng(7)
    rows = spark.createDataFrame([(i, (rnd.normal(size=3) + 4 * (i % 3)).tolist()) for i in range(200)], "id long, features array<double>").coalesce(1)
    monkeypatch.setattr(models, "TASK_ROWS", 10)
    data = models.spread(rows).persist()
    vectors = data.select(array_to_vector("features").alias("features"))
    mine, longest = models.fit_runs(data, [2, 3], restarts=2), 0
    for k, centres in zip([2, 3], mine, strict=True):
        runs = [KMeans(k=k, seed=models.SEED + r, maxIter=models.MAX_ITER, tol=models.TOLERANCE).fit(vectors) for r in range(2)]
        best = min(runs, key=lambda m: m.summary.trainingCost)
        assert np.allclose(centres, np.array(best.clusterCenters()), atol=1e-9)
        longest = max(longest, *(m.summary.numIter for m in runs))
    data.unpersist()
    rounds = []
    monkeypatch.setattr(models, "_round", lambda data, runs, plain=models._round: rounds.append(len(runs)) or plain(data, runs))
    spark.sparkContext.setJobGroup("sweep", "sweep")
    sweep = models.k_sweep(rows, 2, 4, restarts=2).collect()
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(i) for j in tracker.getJobIdsForGroup("sweep") for i in tracker.getJobInfo(j).stageIds]
    assert rounds[0] == 6 and longest <= len(rounds) <= models.MAX_ITER and rounds == sorted(rounds, reverse=True)
    assert max(s.numTasks for s in stages if s) >= 15
    assert [r.k for r in sweep] == [2, 3, 4] and sweep[0].inertia > sweep[1].inertia > sweep[2].inertia
    told = models.assign(rows, models.fit_kmeans(rows, 4, restarts=2))
    assert sweep[2].silhouette == pytest.approx(models.silhouette(told).first()[0], abs=1e-12) and sweep[2].inertia == pytest.approx(models.inertia(told).first()[0])


def test_games_go_to_players_as_narrow_rows(spark):
    """Features are summed where a player's games are; names of openings and ratings don't go to members."""
    view = queries.games(spark, SF)
    plan = features.player_features(view, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("RepartitionByExpression") and "opening_name" not in plan.split("RepartitionByExpression")[0]
    members = view.select("username", F.lit(1).alias("cohort")).distinct()
    for df in (rankings.rank_openings(view, members, min_games=1), rankings.residual_table(view, members, min_games=1)):
        above = df._jdf.queryExecution().optimizedPlan().toString().split("Join Inner, (username")[0]
        assert "opponent_rating" not in above and "family" in above


def test_each_different_move_is_read_once():
    from rookery.functions import moves

    moves._told.cache_clear()
    game = ["e4", "d5", "exd5", "Qxd5", "Nc3", "Qd8"] * 50
    told = moves.features_of(game)
    assert moves._told.cache_info().misses == 6 and told["white_early_pawn"] == 7 and told["queens_off_ply"] is None


def test_density(spark):
    rnd = np.random.default_rng(1)
    noise = spark.createDataFrame([(1000 + i, x.tolist()) for i, x in enumerate(rnd.uniform(-30, 30, (20, 3)))], "id long, features array<double>")
    got = density.density_sweep(blobs(spark).unionByName(noise), (15,)).first()
    assert got.clusters == 3 and 0.03 < got.noise < 0.25 and 0.25 < got.biggest < 0.4
    edges, n = density.spanning_tree(blobs(spark, 20), 5)
    assert n == 60 and len(edges) == 59
    assert density.density_sweep(blobs(spark).limit(1), (15,)).first().clusters == 0


def test_streamed_blocks_count_once(spark, tmp_path):
    games = spark.createDataFrame([row(f"p{i % 5}", opening_name="Italian Game", result="win" if i % 2 else "loss") for i in range(100)], schema.GAMES)
    landed, out, check = (str(tmp_path / x) for x in ("landed", "out", "check"))
    games.limit(60).repartition(3).write.parquet(landed)
    for _ in range(2):
        blocks.start_blocks(blocks.game_stream(spark, landed), out, check).awaitTermination()
    assert blocks.current_blocks(spark, out).agg(F.sum("n")).first()[0] == 60
    games.limit(40).write.mode("append").parquet(landed)
    blocks.start_blocks(blocks.game_stream(spark, landed), out, check).awaitTermination()
    assert blocks.current_blocks(spark, out).agg(F.sum("n")).first()[0] == 100
    blocks.compact(spark, out, str(tmp_path / "one"))
    assert blocks.current_blocks(spark, str(tmp_path / "one")).agg(F.sum("n")).first()[0] == 100
    q = blocks.activity(blocks.game_stream(spark, landed)).writeStream.outputMode("append").format("memory").queryName("activity").trigger(availableNow=True).start()
    q.awaitTermination()


def test_comparisons(spark):
    a, b = (spark.createDataFrame([("x", 1.0, 2), ("y", 3.0, 5)], "username string, cluster double, f int").withColumn("cluster", F.lit(c)) for c in (0, 1))
    s = compare.cluster_summary(a.unionByName(b), ["f"])
    assert compare.matched_summaries(spark.createDataFrame([(0, 1)], "a_cluster int, b_cluster int"), s, s, ["f"]).first().a == 3.5
    assert [r.delta for r in compare.delta_to_means(a, s, ["f"]).orderBy("username").collect()] == [-1.5, 1.5]
    assert compare.z_scores(s, ["f"]).first().f is None
    assert spark.range(1).select(compare.clamp(F.lit(500), *compare.GAMES_ASKED)).first()[0] == 200
    assert sampling.exact_sample(spark.range(100), "id", 10).count() == 10


def test_nearest_of_ties_and_of_vectors_far_from_the_origin(spark):
    from rookery.plans import neighbours

    ties = spark.createDataFrame([(i, [1.0, 0.0]) for i in (9, 8, 7, 3, 2, 1)] + [(0, [0.0, 0.0])], "id long, features array<double>")
    got = neighbours.nearest_many(ties, ties.where("id = 0"), 3).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 2, 3]
    rnd = np.random.default_rng(3)
    points = 1000 + rnd.normal(size=(2000, 8)) * 1e-6
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, features array<double>")
    got = {(r.query, r["rank"]): (r.id, r.dist) for r in neighbours.nearest_many(rows, rows.where("id < 40"), 3).collect()}
    for q in range(40):
        d = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(2000), d))[:3]
        assert [got[q, k + 1][0] for k in range(3)] == want.tolist() and got[q, 1][1] == pytest.approx(d[want[0]], rel=1e-9)


def test_document_store_and_live_profile(spark, tmp_path):
    from rookery import queries as q
    from rookery.operators import compare, features, rankings
    from rookery.schema import V2_21

    d = "/root/testdata/sf0.001"
    document = stage(q.q_recommendation_document(spark, d), "document")
    rankings.write_document(document, str(tmp_path / "doc"))
    again = rankings.read_document(spark, str(tmp_path / "doc"))
    assert again.first() == document.first()
    filled = features.impute(features.player_features(q.games(spark, d), 1))
    means = features.imputation_means(features.player_features(q.games(spark, d), 1)).first().asDict()
    rows = models.vectors(filled, "username", V2_21)
    scaler = models.fit_scaler(rows)
    centres = models.fit_kmeans(models.scale(rows, scaler), 3, restarts=1)
    models.save_model(spark, str(tmp_path / "m"), V2_21, scaler, centres, means)
    one = filled.agg({"username": "min"}).first()[0]
    live = features.live_profile(q.games(spark, d).where(f"username = '{one}'"), models.load_model(spark, str(tmp_path / "m"))).first()
    want = models.assign(models.scale(rows, scaler), centres).where(f"id = '{one}'").first()
    assert live.username == one and live.cluster == want.cluster and live.dist == pytest.approx(want.dist)
    games = spark.createDataFrame([("a", f"g{i:03d}", i) for i in range(300)], "username string, game_id string, created_at long")
    assert [compare.latest_games(games, n).count() for n in (5, 100, 1000)] == [20, 100, 200]
    assert compare.latest_games(games, 20).agg({"created_at": "min"}).first()[0] == 280


def test_assignment_as_brute_force():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        n, m = sorted(rnd.integers(1, 7, 2).tolist())
        cost = rnd.integers(0, 9, (n, m)).astype(float) if rnd.random() < 0.5 else rnd.random((n, m))
        found = models.assignment(cost)
        assert len(set(found.tolist())) == n
        assert np.isclose(cost[np.arange(n), found].sum(), min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n)))
    a = rnd.normal(size=(200, 5))
    order = rnd.permutation(200)
    assert models.match_clusters(a, a[order]) == [(int(i), int(j)) for i, j in enumerate(np.argsort(order))]
    assert models.match_clusters(a[:3], a[[2, 0]]) == [(0, 1), (2, 0)] and models.match_clusters(a[[2, 0]], a[:3]) == [(0, 2), (1, 0)] and models.match_clusters([], a) == []


def test_quantiles_by_ranges(spark):
    rnd = np.random.default_rng(4)
    columns = {"few": [float(x) for x in rnd.integers(0, 3, 900)], "many": rnd.normal(size=900).tolist(), "hot": [7.0] * 600 + rnd.random(300).tolist(), "gaps": [None if x < 0.5 else float(x) for x in rnd.random(900)], "none": [None] * 900}
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns))
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {r.feature: r.q for r in compare.quantiles(compare.unpivot(df, [], list(columns)), shares).collect()}
    assert got.keys() == columns.keys() - {"none"}
    for name, q in got.items():
        assert np.allclose(q, np.quantile([x for x in columns[name] if x is not None], shares))
    told = {r.feature: r for r in compare.describe(df, list(columns)).collect()}
    assert (told["none"].n, told["none"].nulls, told["none"].q50) == (0, 900, None)


def test_no_task_sees_a_features_values(spark, tmp_path):
    """What is partitioned by feature alone, or not at all, are totals of ranges: of 20,000 values none but a range's go to one task."""
    spark.range(20_000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y")).write.parquet(str(tmp_path / "v"))
    df = spark.read.parquet(str(tmp_path / "v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = compare.quantiles(compare.unpivot(df, [], ["x", "y"]), [0.5])
        plan = found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.feature: r.q for r in found.collect()} == {"x": [9999.5], "y": [3.0]}
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert windows and all("part" in line.split("], [")[1] for line in windows), plan


def test_mutual_openings_of_all_cohorts(spark):
    rows = [(c, color, f, 9, float(i * j % 7)) for i, c in enumerate("abc") for color in ("white", "black") for j, f in enumerate("xyz", 2)]
    t = spark.createDataFrame(rows, "cohort string, color string, family string, n long, resid double")
    pairs = spark.createDataFrame([(x, y) for x in "abc" for y in "abc"], "white_cohort string, black_cohort string")
    assert key(map(tuple, rankings.mutual_openings(t).collect())) == key(map(tuple, rankings.mutual_openings(t, pairs).collect()))


@pytest.mark.parametrize("gone", ["corpus_pipeline", "rookery.llm", "public_tokenizers"])
def test_entry_without_what_is_optional(gone):
    """Whichever is missing, the engine's queries are there, and no other."""
    code = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == {gone!r}:
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as entry
from rookery import queries
assert entry.queries() == queries.QUERIES and entry.oracle_sql() == queries.ORACLE_SQL
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(entry.__file__)))
