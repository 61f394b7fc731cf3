"""Nearest players, and rankings pooled from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rankings import pool_blocks, rank_openings
from ..shared import stage
from .models import distance

#: Queries of one block, about: a block at a time is sent to all tasks.
BLOCK = 4096


def nearest(rows: DataFrame, query: Column, k: int, exclude=None) -> DataFrame:
    """The `k` rows (id, features) nearest to `query` (an array), ties by id, without `exclude`: each task keeps k, and one merges them."""
    rows = rows if exclude is None else rows.where(F.col("id") != F.lit(exclude))
    return rows.withColumn("dist", distance(F.transform("features", lambda x: x.cast("double")), query)).orderBy("dist", "id").limit(k)


def nearest_many(rows: DataFrame, queries: DataFrame, k: int, *, block: int = BLOCK) -> DataFrame:
    """(query, id, dist, rank) of the `k` rows nearest to each of the queries (id,
    features), a row's own id left out. Queries are taken in blocks of about `block`, of any number; each block's result is a table."""
    blocks = -(-queries.count() // block)
    if blocks <= 1:
        return _nearest_block(rows, queries, k)[0]
    out = None
    for n in range(blocks):
        found, shared = _nearest_block(rows, queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n), k)
        found = stage(found, "nearest")
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


#: Pairs whose exact distances are worked out at once.
PAIRS = 1 << 15


def _least(points: np.ndarray, x: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the `k` rows of `x` nearest to each of `points`, ties by
    id. A product of matrices leaves out rows that are farther for sure, by a bound of its rounding; differences decide among the rest."""
    far = (points**2).sum(axis=1)[:, None] + (x**2).sum(axis=1) - 2 * points @ x.T
    bound = 8 * 2.0**-52 * (points.shape[1] + 2) * ((points**2).sum(axis=1) + (x**2).sum(axis=1).max())
    far[own[:, None] == ids] = np.inf
    kth = np.partition(far, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
    i, j = np.nonzero(np.isfinite(far) & (far <= (kth + bound)[:, None]))
    d = np.concatenate([np.zeros(0), *(np.sqrt(((points[i[at : at + PAIRS]] - x[j[at : at + PAIRS]]) ** 2).sum(axis=1)) for at in range(0, len(i), PAIRS))])
    order = np.lexsort((np.unique(ids, return_inverse=True)[1][j], d, i))
    i, j, d = i[order], j[order], d[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], d[keep]


def _nearest_block(rows: DataFrame, queries: DataFrame, k: int):
    """`nearest_many` of one block, and its broadcast: every batch of rows meets the queries and keeps k of each."""
    asked = queries.select("id", "features").toPandas()
    names = asked["id"].to_numpy()
    points = np.array(asked["features"].tolist(), float).reshape(len(asked), -1)
    shared = rows.sparkSession.sparkContext.broadcast((names, points))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, points = shared.value
        for batch in batches:
            for start in range(0, len(batch), 4096):
                some = batch.iloc[start : start + 4096]
                ids, x = some["id"].to_numpy(), np.array(some["features"].tolist(), float)
                for at in range(0, len(names), 256):
                    i, j, d = _least(points[at : at + 256], x, ids, names[at : at + 256], k)
                    yield pd.DataFrame({"query": names[at : at + 256][i], "id": ids[j], "dist": d})

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.select("id", "features").mapInPandas(meet, f"query {kind}, id {kind}, dist double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("dist", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k), shared


def recommend_from_games(rows: DataFrame, query: Column, games: DataFrame, *, k: int = 2000, exclude=None, **ranking) -> DataFrame:
    """Openings of the nearest players, from their games."""
    members = nearest(rows, query, k, exclude).select(F.col("id").alias("username"), F.lit(0).alias("cohort"))
    return rank_openings(games, members, **({"min_games": 100, "top_n": 5, "shrinkage_k": 2000} | ranking)).drop("cohort")


def recommend_from_blocks(rows: DataFrame, query: Column, blocks: DataFrame, *, k: int = 2000, exclude=None, **ranking) -> DataFrame:
    """The same from `family_blocks`, without reading a game."""
    members = nearest(rows, query, k, exclude).select(F.col("id").alias("username"), F.lit(0).alias("cohort"))
    return pool_blocks(blocks, members, **ranking).drop("cohort")


def neighbour_ratings(neighbours: DataFrame) -> DataFrame:
    return neighbours.agg(F.count("*").alias("k"), F.min("avg_rating").alias("rating_min"), F.max("avg_rating").alias("rating_max"), F.avg("avg_rating").alias("rating_mean"))
