"""Scaling, K-Means, mixtures, PCA and what is measured on them.

Rows are (id, features array<double>) in the order of a feature list that is kept
with the model; labels always travel with their row's id.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import stage

SEED, RESTARTS, MAX_ITER = 42, 10, 300
#: Rows of one block of a silhouette, about, and bytes of its numbers: a task holds two blocks.
BLOCK, BLOCK_BYTES = 50_000, 1 << 25
#: Rows that are worth a task of their own, about.
TASK_ROWS = 2048
#: A run of K-Means ends when no centre moves farther.
TOLERANCE = 1e-6


def vectors(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(id, features); a missing column is an error, a null too."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"features are missing: {', '.join(missing)}")
    whole = F.array(*(F.coalesce(F.col(c).cast("double"), F.raise_error(F.lit(f"{c} is null"))) for c in columns))
    return df.select(F.col(key).alias("id"), whole.alias("features"))


def fit_scaler(rows: DataFrame) -> list[tuple[float, float]]:
    """(mean, population deviation) of each feature, from one aggregation."""
    size = rows.select(F.size("features")).first()
    if size is None:
        return []
    d = size[0]
    found = rows.agg(*(f(F.col("features")[i]).alias(f"{n}{i}") for i in range(d) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return [(found[f"m{i}"], found[f"s{i}"]) for i in range(d)]


def scale(rows: DataFrame, scaler: Sequence[tuple[float, float]]) -> DataFrame:
    """Features less their means, by their deviations; 0 where a feature doesn't vary."""
    scaled = F.array(*((F.col("features")[i] - F.lit(m)) / F.lit(s if s else 1.0) for i, (m, s) in enumerate(scaler)))
    return rows.withColumn("features", scaled)


#: Squared distances under this share of the squared lengths are worked out from differences.
NEAR, PAIRS = 1e-6, 1 << 15
#: Rows of either side whose distances are worked out at once: their matrix stays in a core's cache.
SIDES = 256, 1024


def _mend(out: np.ndarray, a: np.ndarray, b: np.ndarray, limits: np.ndarray) -> None:
    """Squared distances `out` of the rows of `a` to those of `b`, by exact differences where they aren't over their row's limit, some pairs at once."""
    low = np.flatnonzero(~(out.min(axis=1) > limits))
    if not len(low):
        return
    i, j = np.nonzero(~(out[low] > limits[low][:, None]))
    i = low[i]
    for at in range(0, len(i), PAIRS):
        gap = a[i[at : at + PAIRS]] - b[j[at : at + PAIRS]]
        out[i[at : at + PAIRS], j[at : at + PAIRS]] = (gap * gap).sum(axis=1)


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of `a` to those of `b`: by one product of matrices, and where rounding
    would show in it (pairs that nearly coincide, as copies do) by exact differences."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    mid = b.mean(axis=0)
    x, y = a - mid, b - mid
    lengths = (x * x).sum(axis=1), (y * y).sum(axis=1)
    out = x @ y.T
    out *= -2.0
    out += lengths[0][:, None]
    out += lengths[1]
    _mend(out, a, b, NEAR * (lengths[0] + lengths[1].max()))
    return np.sqrt(out, out=out)


def pair_sums(a: np.ndarray, b: np.ndarray, a_shares: np.ndarray | None, b_shares: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Each row of `a`'s distances to the rows of `b`, times their shares of each cluster, summed; and the other way round,
    if shares are given for `a` too. Each distance is worked out once, as in `between`; the lengths come in by two columns more."""
    there = np.zeros((len(a), b_shares.shape[1]))
    back = None if a_shares is None else np.zeros((len(b), a_shares.shape[1]))
    if not len(a) or not len(b):
        return there, back
    mid = b.mean(axis=0)
    x, y = a - mid, b - mid
    lengths = (x * x).sum(axis=1), (y * y).sum(axis=1)
    limits = NEAR * (lengths[0] + lengths[1].max())
    x = np.column_stack([-2.0 * x, lengths[0], np.ones(len(a))])
    y = np.column_stack([y, np.ones(len(b)), lengths[1]])
    for i in range(0, len(a), SIDES[0]):
        some = slice(i, i + SIDES[0])
        for j in range(0, len(b), SIDES[1]):
            other = slice(j, j + SIDES[1])
            out = x[some] @ y[other].T
            _mend(out, a[some], b[other], limits[some])
            np.sqrt(out, out=out)
            there[some] += out @ b_shares[other]
            if back is not None:
                back[other] += out.T @ a_shares[some]
    return there, back


def cluster_sums(x: np.ndarray, points: np.ndarray, codes: np.ndarray, k: int) -> np.ndarray:
    """Summed distances of each row of `x` to the points of each of `k` clusters."""
    return pair_sums(x, points, None, np.eye(k)[codes])[0]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of arrays of one length, as rows."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([chunk.flatten().to_numpy(zero_copy_only=False) for chunk in chunks]).reshape(len(column), -1)


def _arrays(rows: np.ndarray) -> pa.Array:
    """Rows, as a column of arrays."""
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1]), rows.ravel())


def distance(a: Column, b: Column) -> Column:
    """Euclidean, of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def spread(rows: DataFrame) -> DataFrame:
    """(id, features) over tasks of a like number of rows, in the order of their ids: a file of few row groups would leave them to few tasks."""
    cores, count = rows.sparkSession.sparkContext.defaultParallelism, rows.count()
    tasks = max(min(cores, -(-count // TASK_ROWS)), -(-count // (4 * BLOCK)), 1)  # one a core, as rounds over them are many and short
    return rows.select("id", "features").repartition(tasks, "id").sortWithinPartitions("id")


def fit_kmeans(rows: DataFrame, k: int, *, seed: int = SEED, restarts: int = RESTARTS, max_iter: int = MAX_ITER) -> list[list[float]]:
    """Centres of the best of `restarts` runs, by cost."""
    data = spread(rows).persist()
    try:
        return fit_runs(data, [k], seed=seed, restarts=restarts, max_iter=max_iter)[0]
    finally:
        data.unpersist()


def fit_runs(data: DataFrame, ks: Sequence[int], *, seed: int = SEED, restarts: int = RESTARTS, max_iter: int = MAX_ITER) -> list[list[list[float]]]:
    """For each number of clusters the centres of the best of `restarts` runs, by cost. MLlib gives the starts (k-means||); then a round of
    all runs that still move is one pass over `data`, which should be persisted: rounds are as many as the longest run's, not the sum."""
    start = KMeans(maxIter=0)
    each = [{start.k: k, start.seed: seed + r} for k in ks for r in range(restarts)]
    runs: list[np.ndarray] = [np.zeros((0, 0))] * len(each)
    for i, model in start.fitMultiple(data.select(array_to_vector("features").alias("features")), each):
        runs[i] = np.array(model.clusterCenters())
    costs, moving = [math.inf] * len(runs), list(range(len(runs)))
    for _ in range(max_iter):
        if not moving:
            break
        found = _round(data, [runs[i] for i in moving])
        still = []
        for i, (sizes, sums, cost) in zip(moving, found, strict=True):
            new = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], runs[i])  # a centre that no row is nearest to stays
            if (((new - runs[i]) ** 2).sum(axis=1) > TOLERANCE**2).any():
                still.append(i)
            runs[i], costs[i] = new, cost
        moving = still
    best = [min(range(at, at + restarts), key=costs.__getitem__) for at in range(0, len(runs), restarts)]
    return [runs[i].tolist() for i in best]


def _round(data: DataFrame, runs: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each run's centres how many rows are nearest to each, their sum, and the run's cost. A task gives a row a centre, so what comes to the driver doesn't grow with the rows."""
    ends = np.cumsum([0, *map(len, runs)])
    centres = np.concatenate(runs)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, sums, costs = np.zeros(len(centres)), np.zeros(centres.shape), np.zeros(len(centres))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("features"))
            far = between(x, centres)
            row, mine = np.arange(len(x)), np.zeros(far.shape)
            for lo, hi in itertools.pairwise(ends):
                mine[row, lo + far[:, lo:hi].argmin(axis=1)] = 1.0
            sizes += mine.sum(axis=0)
            sums += mine.T @ x
            costs += (mine * far * far).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres), dtype=np.int32)), pa.array(sizes), _arrays(sums), pa.array(costs)], ["centre", "size", "total", "cost"])

    told = data.select("features").mapInArrow(nearest, "centre int, size double, total array<double>, cost double").toArrow()
    at = told["centre"].to_numpy()
    sizes, sums, costs = np.zeros(len(centres)), np.zeros(centres.shape), np.zeros(len(centres))
    np.add.at(sizes, at, told["size"].to_numpy())
    np.add.at(sums, at, _matrix(told["total"]))
    np.add.at(costs, at, told["cost"].to_numpy())
    return [(sizes[lo:hi], sums[lo:hi], float(costs[lo:hi].sum())) for lo, hi in itertools.pairwise(ends)]


def assign(rows: DataFrame, centres: Sequence[Sequence[float]]) -> DataFrame:
    """`rows` with cluster (the nearest centre, the first of equals) and dist."""
    options = F.array(*(F.struct(distance(F.col("features"), F.array(*map(F.lit, map(float, c)))).alias("d"), F.lit(i).alias("k")) for i, c in enumerate(centres)))
    return rows.withColumn("_best", F.array_min(options)).select(*rows.columns, F.col("_best.k").alias("cluster"), F.col("_best.d").alias("dist"))


def lloyd_step(assigned: DataFrame) -> DataFrame:
    """(cluster, size, centre): the means of an assignment."""
    each = assigned.select("cluster", F.posexplode("features").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return each.groupBy("cluster").agg(F.max("n").alias("size"), F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centre"))


def refine(rows: DataFrame, centres: Sequence[Sequence[float]], rounds: int) -> list[list[float]]:
    """Centres after so many rounds of assigning and averaging from given ones (those of an earlier model, say); a centre that no row is nearest to stays."""
    now = [list(map(float, c)) for c in centres]
    for _ in range(rounds):
        for r in lloyd_step(assign(rows, now)).collect():  # a row a cluster
            now[r["cluster"]] = list(r["centre"])
    return now


def inertia(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum(F.col("dist") * F.col("dist")).alias("inertia"))


def k_sweep(rows: DataFrame, low: int = 2, high: int = 10, *, sample_size: int | None = None, restarts: int = RESTARTS, seed: int = SEED) -> DataFrame:
    """(k, inertia, silhouette) for each number of clusters. All are fitted by the same passes, and their silhouettes are of the same distances."""
    ks = range(low, high + 1)
    data = spread(rows).persist()
    try:
        told = data
        for k, centres in zip(ks, fit_runs(data, ks, seed=seed, restarts=restarts), strict=True):
            told = assign(told, centres).withColumnsRenamed({"cluster": f"cluster{k}", "dist": f"dist{k}"})
        inertias = told.agg(*(F.sum(F.col(f"dist{k}") * F.col(f"dist{k}")) for k in ks)).first()
        widths = silhouettes(told, [f"cluster{k}" for k in ks], sample_size=sample_size, seed=seed).first()
    finally:
        data.unpersist()
    return rows.sparkSession.createDataFrame(list(zip(ks, inertias, widths, strict=True)), "k int, inertia double, silhouette double")


def silhouette(assigned: DataFrame, *, sample_size: int | None = None, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """One row, the mean silhouette by Euclidean distance, a cluster of one row
    counting 0: over all rows, or over a sample of `sample_size` (by hash)."""
    return silhouettes(assigned, ["cluster"], sample_size=sample_size, seed=seed, block=block).toDF("silhouette")


def silhouettes(assigned: DataFrame, columns: Sequence[str], *, sample_size: int | None = None, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """One row, the silhouette for each of some columns of clusters. Rows that are alike in all meet as one that counts so often. The
    rows are dealt into blocks of `block` at most, about; a task has two blocks' distances, each once for both rows and all columns."""
    spark = assigned.sparkSession
    rows = assigned.select("id", "features", *columns)
    if sample_size is not None:
        rows = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample_size)
    rows = rows.groupBy("features", *columns).agg(F.count("*").alias("n"))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "silhouette_rows")
    count, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("features")), F.lit(0))).first()
    sizes = [dict(sorted(map(tuple, rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.sum("n")).collect()))) for c in columns]
    starts = np.cumsum([0, *map(len, sizes)]).tolist()
    total = starts[-1]
    if not total:
        return rows.agg(*((F.sum(F.col("n") * 0.0) / F.sum("n")).alias(c) for c in columns))
    most = max(min(block, BLOCK_BYTES // (8 * (width + total + 1))), 1)
    cores = spark.sparkContext.defaultParallelism
    parts = max(-(-count // most), min(math.ceil(math.sqrt(8 * cores)), -(-count // TASK_ROWS)), 1)  # some pairs of blocks a core

    codes = [F.coalesce(F.array_position(F.array(*map(F.lit, own)), F.col(c)) - 1, F.lit(-1)).cast("int") if own else F.lit(-1) for c, own in zip(columns, sizes, strict=True)]
    dealt = rows.select("row", "n", F.array(*codes).alias("own"), "features", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    dealt = dealt.select("row", "n", "own", "features", "part", "i", "j", (F.col("j") * (F.col("j") + 1) / 2 + F.col("i")).cast("int").alias("pair"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if not some:
            return
        table = pa.Table.from_batches(some)
        x, own = _matrix(table["features"]), _matrix(table["own"])
        n, part, i, j, pair = (table[c].to_numpy() for c in ("n", "part", "i", "j", "pair"))
        shares, sums = np.zeros((len(x), total)), np.zeros((len(x), total))
        for m, start in enumerate(starts[:-1]):
            known = np.flatnonzero(own[:, m] >= 0)
            shares[known, start + own[known, m]] = n[known]
        for p in np.unique(pair):  # one, as pairs are dealt out
            a, b = np.flatnonzero((pair == p) & (part == i)), np.flatnonzero((pair == p) & (part != i))
            if i[pair == p][0] == j[pair == p][0]:
                sums[a] = pair_sums(x[a], x[a], None, shares[a])[0]
            else:
                sums[a], sums[b] = pair_sums(x[a], x[b], shares[a], shares[b])
        yield from pa.table({"row": table["row"], "n": table["n"], "own": table["own"], "sums": _arrays(sums)}).to_batches(8192)

    met = dealt.repartitionById(parts * (parts + 1) // 2, "pair").mapInArrow(meet, "row bigint, n bigint, own array<int>, sums array<double>")
    met = met.select("row", "n", *(F.col("own")[m].alias(f"c{m}") for m in range(len(columns))), *(F.col("sums")[s].alias(f"s{s}") for s in range(total)))
    each = met.groupBy("row", "n", *(f"c{m}" for m in range(len(columns)))).agg(*(F.sum(f"s{s}").alias(f"s{s}") for s in range(total)))
    none, means = F.lit(None).cast("double"), []
    for m, own in enumerate(sizes):
        means_of = [(F.col(f"c{m}") == at, F.col(f"s{starts[m] + at}"), size) for at, size in enumerate(own.values())]
        a = F.coalesce(none, *(F.when(mine, s / (size - 1)) for mine, s, size in means_of if size > 1))
        b = F.array_min(F.array(none, *(F.when(~mine, s / size) for mine, s, size in means_of)))
        wide = F.greatest(a, b)
        s = F.when(a.isNotNull() & b.isNotNull() & (wide > 0), (b - a) / wide).otherwise(0.0)
        means.append((F.sum(s * F.col("n")) / F.sum("n")).alias(columns[m]))
    return stage(each.agg(*means), "silhouette")


def pca(rows: DataFrame, k: int) -> tuple[DataFrame, list[float], list[float]]:
    """`rows` with `pcs` (centred, each component's largest loading positive), the shares of variance explained, and their running sum."""
    data = rows.withColumn("_v", array_to_vector("features"))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(data)
    axes = np.array(model.pc.toArray())
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    means = [m for m, _ in fit_scaler(rows)]
    each = [F.aggregate(F.zip_with(F.zip_with("features", F.array(*map(F.lit, means)), lambda x, m: x - m), F.array(*map(F.lit, axes[:, j].tolist())), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x) for j in range(k)]
    shares = model.explainedVariance.toArray().tolist()
    return rows.withColumn("pcs", F.array(*each)), shares, list(itertools.accumulate(shares))


def correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for each pair, a before b, from one aggregation."""
    pairs = list(itertools.combinations(columns, 2))
    one = df.agg(*(F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)))).alias("p")).select("p.*")


def gmm_sweep(rows: DataFrame, low: int = 2, high: int = 8, *, restarts: int = 3, max_iter: int = 200, seed: int = SEED) -> DataFrame:
    """(k, bic, mean_max_responsibility, entropy): full covariances, the best of `restarts`; entropy is by that of k equal shares."""
    data = rows.select(array_to_vector("features").alias("features")).persist()
    n, d = data.count(), len(rows.select("features").first()[0])
    out = []
    for k in range(low, high + 1):
        runs = [GaussianMixture(k=k, seed=seed + r, maxIter=max_iter).fit(data) for r in range(restarts)]
        best = max(runs, key=lambda m: m.summary.logLikelihood)
        p = vector_to_array("probability")
        entropy = F.aggregate(F.transform(p, lambda x: -x * F.ln(x + 1e-12)), F.lit(0.0), lambda s, x: s + x) / math.log(k)
        found = best.transform(data).agg(F.avg(F.array_max(p)).alias("m"), F.avg(entropy).alias("e")).first()
        parameters = (k - 1) + k * d + k * d * (d + 1) / 2
        out.append((k, -2 * best.summary.logLikelihood + parameters * math.log(n), found["m"], found["e"]))
    data.unpersist()
    return rows.sparkSession.createDataFrame(out, "k int, bic double, mean_max_responsibility double, entropy double")


def match_clusters(a: Sequence[Sequence[float]], b: Sequence[Sequence[float]]) -> list[tuple[int, int]]:
    """The pairing of two runs' centres with the least sum of distances, for any number of
    clusters; of unequal numbers some centres of the larger side stay without a partner."""
    if not len(a) or not len(b):
        return []
    cost = np.sqrt(((np.array(a, float)[:, None] - np.array(b, float)[None]) ** 2).sum(axis=2))
    if len(a) <= len(b):
        return list(enumerate(assignment(cost).tolist()))
    return sorted((int(i), j) for j, i in enumerate(assignment(cost.T).tolist()))


def assignment(cost: np.ndarray) -> np.ndarray:
    """For each row of `cost` (no more rows than columns) a column of its own, at the least sum: rows come
    in one after another, each along the shortest augmenting path under the prices so far, so the time is cubic."""
    rows, columns = cost.shape
    owner = np.full(columns, -1)  # of each column
    row_price, column_price = np.zeros(rows), np.zeros(columns)
    for new in range(rows):
        far = np.full(columns, np.inf)  # to each column
        came = np.full(columns, -1)  # from which column's row
        done = np.zeros(columns, bool)
        row, at, so_far = new, -1, 0.0
        while True:
            step = so_far + cost[row] - row_price[row] - column_price
            closer = ~done & (step < far)
            far[closer], came[closer] = step[closer], at
            at = int(np.where(done, np.inf, far).argmin())
            done[at], so_far = True, far[at]
            if owner[at] < 0:
                break
            row = owner[at]
        seen = np.flatnonzero(done)
        row_price[new] += so_far
        held = seen[owner[seen] >= 0]
        row_price[owner[held]] += so_far - far[held]
        column_price[seen] += far[seen] - so_far
        while at >= 0:  # each column along the path takes the row before it
            before = came[at]
            owner[at] = new if before < 0 else owner[before]
            at = before
    found = np.empty(rows, int)
    found[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return found


def save_model(spark: SparkSession, path: str, columns: Sequence[str], scaler, centres, means: dict[str, float] | None = None) -> None:
    """A model as one row of JSON: the order of its features goes with it, and what imputation needs."""
    text = json.dumps({"columns": list(columns), "scaler": scaler, "centres": centres, "means": means or {}})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
