"""Mixing sources to target weights by pivotal dependent rounding.

Each source is to give so many words. Each of its documents is to be taken x
times, x the source's target over its size: its whole part surely, its fraction by
rounding. Two documents with fractions p and q and sizes a and b meet, and one
moves up and the other down so that a p + b q stays what it was, until one of
them is whole; which way is drawn so that each keeps its mean. What is left over
in a block of documents goes on to the next level, whose blocks hold the
leftovers of many: a reduction tree, of which the last node of a source rounds
its one leftover. So a source's words miss its target by less than one document.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import WORD, stage

#: A document is taken at most so often; sources weigh these numbers in turn; documents in a block, blocks in the next.
MOST, WEIGHTS, BLOCK, FAN_IN = 3, (1, 2, 3), 4096, 64
SEED = 11


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """`rows` with the sum of each of `sums` over the rows before them in `order`:
    within the ranges of a sort, and of ranges their totals, one row a range."""
    ranged = stage(rows.orderBy(*order).withColumn("range", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("range").agg(*(F.sum(c).alias(f"{n}_all") for n, c in sums.items()))
    ranges = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as the sort has tasks
    totals = totals.select("range", *(F.coalesce(F.sum(f"{n}_all").over(ranges), F.lit(0)).alias(f"{n}_all") for n in sums))
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    told = ranged.join(F.broadcast(totals), "range")  # as many rows as the sort has tasks
    return told.select(*rows.columns, *((F.col(f"{n}_all") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(n) for n, c in sums.items()))


def targets(sizes: DataFrame) -> DataFrame:
    """`sizes` (source, source_size: a row a source) with target: shares of the
    total by weight, none above MOST times its size, the excess shared by weight
    among the others.

    That is min(MOST * size, level * weight) with one level for all: sources in
    order of MOST * size / weight are capped up to the first that would not be.
    Sources may be many: both orders are made by ranges."""
    name = F.col("source").cast("binary").asc_nulls_last()
    named = running(sizes, [name], {"rank": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    rows = named.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST)
    rows = stage(running(rows, [F.col("cap") / F.col("weight"), name], {"capped": F.col("cap"), "filled": F.col("weight")}), "filling")
    whole = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    left, heavy = F.lit(whole[0] or 0) - F.col("capped"), F.lit(whole[1] or 0) - F.col("filled")
    level = left.cast("double") / heavy
    first = rows.where(F.col("cap") > level * F.col("weight")).agg(F.min(F.struct((F.col("cap") / F.col("weight")).alias("at"), (-level).alias("level")))["level"]).first()[0]  # of equals the first, whose level is highest
    cap = F.col("cap").cast("double")
    return rows.select("source", "source_size", (cap if first is None else F.least(cap, F.lit(-first) * F.col("weight"))).alias("target"))


def _meet(p: float, q: float, a: int, b: int, draw: float) -> tuple[float, float]:
    """New fractions of two documents of sizes a and b, one of them whole."""
    up = min((1 - p) * a, q * b)  # words that can move from the second to the first
    down = min(p * a, (1 - q) * b)
    if draw * (up + down) < down:
        p, q = (1.0 if up == (1 - p) * a else p + up / a), (0.0 if up == q * b else q - up / b)
    else:
        p, q = (0.0 if down == p * a else p - down / a), (1.0 if down == (1 - q) * b else q + down / b)
    return p, q


def round_block(fractions: np.ndarray, sizes: np.ndarray, seed: int, last: bool) -> np.ndarray:
    """Fractions made whole in turn; one may stay, unless this is the `last` node: there it goes to the nearer."""
    p, held = fractions.astype(float).copy(), None
    at = np.flatnonzero((p > 0) & (p < 1))
    for i, draw in zip(at, np.random.default_rng(seed).random(len(at)), strict=True):
        if held is None:
            held = i
            continue
        p[held], p[i] = _meet(p[held], p[i], int(sizes[held]), int(sizes[i]), draw)
        held = i if 0 < p[i] < 1 else held if 0 < p[held] < 1 else None
    if last and held is not None:
        p[held] = float(p[held] >= 0.5)
    return p


def _level(rows: DataFrame, last: bool, level: int) -> DataFrame:
    """Rounds each (source, block) of `rows`."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        # Large documents first: they trade with their like, and small ones even out what is left.
        group = group.sort_values(["size", "tie", "doc_id"], ascending=[False, True, True], kind="stable")
        seed = zlib.crc32(f"{SEED} {level} {group['source'].iloc[0]} {group['block'].iloc[0]}".encode())
        return group.assign(part=round_block(group["part"].to_numpy(), group["size"].to_numpy(), seed, last))

    return rows.groupBy("source", "block").applyInPandas(one, rows.schema)


def mix(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", block: int = BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """A row for each row of `docs`: doc_id, source, size (words of its text),
    source_size, target (its source's, in words), copies (0 to MOST) and taken (size * copies).

    Null and empty texts have size 0 and are taken 0 times; a null source is a
    source, the last in order; repeated rows and null ids are rows of their own;
    other columns aren't read; an empty table gives none. Runs agree: draws come
    from a block's name, and blocks from hashes of ids (of rows' places, if one id has
    thousands of rows: then with the same files and settings). Texts are read once and
    not shuffled; of a source only its size is gathered, and its rows are dealt to blocks."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).cast("string").alias("source"), F.coalesce(F.regexp_count(text_column, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))
    rows = stage(rows, "sizes").withColumn("row", F.monotonically_increasing_id())
    sizes = stage(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))).join(rows.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("n")), F.expr("source <=> s")).drop("s"), "targets")
    most = sizes.agg(F.max("n")).first()[0] or 0
    told = rows.join(sizes.withColumnRenamed("source", "s"), F.expr("source <=> s")).drop("s")
    times = F.when((F.col("size") > 0) & (F.col("source_size") > 0), F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    times = F.when(F.abs(times - F.round(times)) < 1e-12, F.round(times)).otherwise(times)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block))
    told = told.withColumn("whole", F.floor(times).cast("int")).withColumn("part", times - F.floor(times))
    # Blocks come from hashes of ids; where many rows have one id (or none), from their places in the table.
    for key in ("doc_id", "row"):
        dealt = told.withColumn("tie", F.xxhash64(key, F.lit(SEED))).withColumn("block", F.pmod("tie", blocks))
        if not dealt.groupBy("source", "block").count().where(F.col("count") > 4 * block).limit(1).count():
            break
    told = dealt.drop("n", "row")
    done, left, level = [told.where(F.col("part") == 0)], told.where(F.col("part") > 0), 0
    n_blocks = max(1, math.ceil(most / block))
    while True:
        now = stage(_level(left, n_blocks == 1, level), f"mix{level}")
        done.append(now.where(F.col("part").isin(0.0, 1.0)))
        if n_blocks == 1:
            break
        left = now.where(~F.col("part").isin(0.0, 1.0)).withColumn("block", F.floor(F.col("block") / fan_in))
        n_blocks, level = math.ceil(n_blocks / fan_in), level + 1
    all_rows = done[0]
    for more in done[1:]:
        all_rows = all_rows.unionByName(more)
    copies = (F.col("whole") + F.col("part")).cast("int")
    return all_rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
