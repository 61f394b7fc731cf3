"""Density clusters (HDBSCAN) of a bounded sample.

Spark finds each point's core distance and, round by round, each component's
nearest way out (Boruvka's minimum spanning tree over mutual reachability), with
the points of the sample (SAMPLE, unless the caller asks for more or fewer) at every task. The tree has one edge fewer than
the sample has points; condensing it is what is left for the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 30_000


def _distances(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((points[at] ** 2).sum(axis=1)[:, None] + (points**2).sum(axis=1) - 2 * points[at] @ points.T, 0))


def spanning_tree(rows: DataFrame, min_samples: int) -> tuple[np.ndarray, int]:
    """(edges, n): edges (i, j, weight) of the tree over the points' mutual reachability."""
    spark = rows.sparkSession
    points = np.array([r[0] for r in rows.select("features").collect()], float)  # the sample's rows
    n = len(points)
    if n < 2:
        return np.zeros((0, 3)), n
    shared = spark.sparkContext.broadcast(points)
    parts = spark.range(n, numPartitions=max(1, min(64, n // 256)))

    def cores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in np.array_split(batch["id"].to_numpy(), max(1, len(batch) // 256)):
                d = np.partition(_distances(shared.value, at), min(min_samples - 1, n - 1), axis=1)[:, min(min_samples - 1, n - 1)]
                yield pd.DataFrame({"id": at, "core": d})

    core = parts.mapInPandas(cores, "id bigint, core double").toPandas().sort_values("id")["core"].to_numpy()
    label, edges = np.arange(n), []
    while len(np.unique(label)) > 1:
        state = spark.sparkContext.broadcast((core, label))

        def out(batches: Iterator[pd.DataFrame], state=state) -> Iterator[pd.DataFrame]:
            core, label = state.value
            for batch in batches:
                for at in np.array_split(batch["id"].to_numpy(), max(1, len(batch) // 256)):
                    d = np.maximum(np.maximum(_distances(shared.value, at), core), core[at][:, None])
                    d[label[at][:, None] == label] = np.inf
                    j = d.argmin(axis=1)
                    yield pd.DataFrame({"label": label[at], "w": d[np.arange(len(at)), j], "i": at, "j": j})

        ways = parts.mapInPandas(out, "label bigint, w double, i bigint, j bigint")
        a, b = F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")
        best = ways.groupBy("label").agg(F.min(F.struct("w", a, b)).alias("m")).select("m.*").distinct().collect()
        for w, i, j in sorted((r["w"], r["a"], r["b"]) for r in best):
            x, y = label[i], label[j]
            if x != y:
                edges.append((i, j, w))
                label[label == max(x, y)] = min(x, y)
    return np.array(edges), n


def condensed(edges: np.ndarray, n: int, min_cluster_size: int) -> np.ndarray:
    """Labels (-1: noise) by excess of mass over the tree's hierarchy."""
    parent, size, node = list(range(n)), [1] * n, list(range(n))
    merges = []  # (left, right, distance) of each inner node n, n + 1, ...

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j, w in edges[np.argsort(edges[:, 2], kind="stable")] if len(edges) else []:
        x, y = top(int(i)), top(int(j))
        merges.append((node[x], node[y], w))
        parent[y] = x
        size[x] += size[y]
        node[x] = n + len(merges) - 1
    count = [1] * n + [0] * len(merges)
    for k, (a, b, _) in enumerate(merges):
        count[n + k] = count[a] + count[b]
    labels = np.full(n, -1)
    if not merges:
        return labels

    def points(x: int) -> list[int]:
        out, todo = [], [x]
        while todo:
            y = todo.pop()
            if y < n:
                out.append(y)
            else:
                todo += merges[y - n][:2]
        return out

    birth, mass, kids, start = {0: 0.0}, {0: 0.0}, {0: []}, {0: n + len(merges) - 1}
    todo = [(n + len(merges) - 1, 0)]
    while todo:
        x, c = todo.pop()
        if x < n:
            continue
        a, b, w = merges[x - n]
        level = 1 / w if w > 0 else 1e12
        large = [y for y in (a, b) if count[y] >= min_cluster_size]
        if len(large) == 2:
            mass[c] += count[x] * (level - birth[c])
            for y in large:
                new = len(birth)
                birth[new], mass[new], kids[new], start[new] = level, 0.0, [], y
                kids[c].append(new)
                todo.append((y, new))
        else:
            mass[c] += sum(count[y] for y in (a, b) if y not in large) * (level - birth[c])
            todo += [(y, c) for y in large]
            if not large:
                continue
    chosen, best = {}, {}
    for c in sorted(birth, reverse=True):
        below = sum(best[k] for k in kids[c])
        chosen[c] = c != 0 and mass[c] >= below
        best[c] = mass[c] if chosen[c] else below
    todo, label = [0], 0
    while todo:
        c = todo.pop()
        if chosen[c]:
            labels[points(start[c])] = label
            label += 1
        else:
            todo += kids[c]
    return labels


def density_sweep(rows: DataFrame, sizes: Sequence[int] = (50, 100, 250, 500), *, sample_size: int = SAMPLE, seed: int = 42) -> DataFrame:
    """(min_cluster_size, clusters, noise, biggest) over a sample of (id, features): `sample_size` rows, which
    every task holds and whose square is the number of distances."""
    sample = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample_size)
    out = []
    for size in sizes:
        labels = condensed(*spanning_tree(sample, size), size)
        kept = labels[labels >= 0]
        out.append((size, len(np.unique(kept)), float((labels < 0).mean()) if len(labels) else 0.0, float(np.bincount(kept).max() / len(labels)) if len(kept) else 0.0))
    return rows.sparkSession.createDataFrame(out, "min_cluster_size int, clusters int, noise double, biggest double")
