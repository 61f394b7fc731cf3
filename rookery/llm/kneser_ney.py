"""A modified Kneser-Ney model of code points, counted and smoothed by Spark.

An n-gram is ORDER code points of 21 bits each, exact in two numbers: `a` holds all
but the last three, `b` those three. Before a text stand ORDER - 1 spaces. Spark
counts the n-grams of all texts; below the highest order, an n-gram counts by how
many code points it follows; the probabilities of each order come from a join
with those of the order below. The model has a row for each distinct n-gram of
the corpus, so it grows with the corpus.

Texts look n-grams up in arrays sorted by a 64-bit hash. Up to BROADCAST_ROWS
n-grams these arrays go to all tasks. A larger model stays where it is: blocks of
texts ask for their distinct n-grams, a join by hash answers, and each block
meets its own arrays. Both ways give the same figures.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import stage
from .minhash import mix64

ORDER = 5
#: n-grams of a model that goes to all tasks, 12 bytes each (96 MB).
BROADCAST_ROWS = 8_000_000
#: n-grams that are worked on at once; bytes of texts likewise.
STEP, SLICE_BYTES = 1 << 19, 1 << 21

_ONE, _TWO = (1 << 21) - 1, (1 << 42) - 1


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit or i - start == 255:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def grams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(owner, a, b) of the n-gram that ends at each code point of `texts`, STEP at most at a time."""
    before = ORDER - 1
    decoded = [t.decode(errors="replace") for t in texts]
    sizes = np.array([len(t) + before for t in decoded], np.int64)
    points = np.frombuffer("".join(" " * before + t for t in decoded).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    real = np.ones(len(points), bool)
    for i in range(before):
        real[np.cumsum(sizes) - sizes + i] = False
    for at in range(before, len(points), STEP):
        end = min(at + STEP, len(points))
        p = points[at - before : end].astype(np.int64)
        n, on = end - at, real[at:end]
        a, b = p[:n] << 21 | p[1 : n + 1], p[2 : n + 2] << 42 | p[3 : n + 3] << 21 | p[4 : n + 4]
        yield owner[at:end][on], a[on], b[on]


def hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(mix64(a.astype(np.uint64)) + b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _distinct(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, a, b, n) of the distinct n-grams of `texts`."""
    held: list[tuple[np.ndarray, ...]] = []

    def merge() -> None:
        h, a, b, n = (np.concatenate(x) for x in zip(*held, strict=True))
        keys, first, place = np.unique(h, return_index=True, return_inverse=True)
        held[:] = [(keys, a[first], b[first], np.bincount(place, n, len(keys)).astype(np.int64))]

    for start, end in slices(texts):
        for _, a, b in grams(texts[start:end]):
            keys, first, n = np.unique(hashed(a, b), return_index=True, return_counts=True)
            held.append((keys, a[first], b[first], n))
        if len(held) >= 16:
            merge()
    if not held:
        held.append((np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3))
    merge()
    return held[0]


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def counted(texts: DataFrame) -> DataFrame:
    """(a, b, n) of the n-grams of all of every text (column 0); each batch counts its own before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, a, b, n = _distinct(_bytes(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])

    return texts.mapInArrow(count, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _without_first(k: int) -> list[Column]:
    """The key of an n-gram of k + 1 code points without its first."""
    a, b = F.col("a"), F.col("b")
    return [(a.bitwiseAND(_ONE) if k == 4 else F.lit(0).cast("bigint")).alias("a"), (b.bitwiseAND(_TWO) if k == 2 else b.bitwiseAND(_ONE) if k == 1 else b).alias("b")]


def discounts(n: list[int]) -> list[float]:
    """For counts 1, 2 and more, from how many n-grams have counts 1 to 4 (Chen and Goodman)."""
    if not n[0] or not n[1]:
        return [0.5, 0.75, 1.0]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k) if n[k - 1] and n[k] else 0.5 * k for k in (1, 2, 3)]


def fitted(counts: DataFrame) -> DataFrame:
    """(a, b, bits): -log2 of each n-gram's probability, all orders interpolated."""
    levels = {ORDER: stage(counts, "grams5")}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = stage(levels[k + 1].select(*_without_first(k)).groupBy("a", "b").agg(F.count("*").alias("n")), f"grams{k}")
    spread = None
    for k, rows in levels.items():
        one = rows.agg(F.lit(k).alias("k"), F.count("*").alias("rows"), *(F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)))
        spread = one if spread is None else spread.unionByName(one)
    told = {r["k"]: r for r in spread.collect()}  # a row an order
    below = None
    for k in range(1, ORDER + 1):
        taken = discounts([told[k][f"n{i}"] for i in (1, 2, 3, 4)])
        rows = levels[k].withColumn("d", F.when(F.col("n") == 1, taken[0]).when(F.col("n") == 2, taken[1]).otherwise(taken[2]))
        context = [F.col("a").alias("ca"), F.shiftright("b", 21).alias("cb")]
        contexts = rows.groupBy(*context).agg(F.sum("n").alias("total"), F.sum("d").alias("left"))
        rows = rows.select("*", *context).join(contexts, ["ca", "cb"])
        if k == 1:
            lower: Column = F.lit(1.0 / max(1, told[1]["rows"]))
        else:
            after = _without_first(k - 1)
            rows = rows.select("a", "b", "n", "d", "total", "left", after[0].alias("la"), after[1].alias("lb")).join(below.select(F.col("a").alias("la"), F.col("b").alias("lb"), "p"), ["la", "lb"])
            lower = F.col("p")
        p = (F.col("n") - F.col("d")) / F.col("total") + F.col("left") / F.col("total") * lower
        below = rows.select("a", "b", p.alias("p"))
        if k == 3:
            below = stage(below, "grams_p3")
    return below.select("a", "b", (-F.log2("p")).alias("bits"))


class Lookup:
    """Bits of n-grams by hash, from arrays sorted by it; where each hash's leading bits begin is remembered."""

    def __init__(self, keys: np.ndarray, bits: np.ndarray):
        self.keys = np.append(keys, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.bits = np.append(bits, bits.max() if len(bits) else np.float32(21))
        leading = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - leading)
        self.first = np.searchsorted(keys, np.arange(1 << leading, dtype=np.uint64) << self.shift)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = self.first[h >> self.shift]
        on = np.flatnonzero(self.keys[at] < h)
        while len(on):
            at[on] += 1
            on = on[self.keys[at[on]] < h[on]]
        return self.bits[at]


def total_bits(texts: list[bytes], look: Lookup) -> np.ndarray:
    """The sum over each text."""
    out = np.zeros(len(texts))
    for start, end in slices(texts):
        for owner, a, b in grams(texts[start:end]):
            out[start:end] += np.bincount(owner, look(hashed(a, b)), end - start)
    return out


def scored(docs: DataFrame, model: DataFrame, measure: Callable[[pa.RecordBatch, Lookup], pa.RecordBatch], schema: str, *, most: int = BROADCAST_ROWS) -> DataFrame:
    """`measure` of batches of `docs` (text in column 1) with the bits of their n-grams, by `model` (a, b, bits), which must know them all."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = hashed(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(2).cast(pa.float32())], ["h", "bits"])

    table = stage(model.mapInArrow(keyed, "h bigint, bits float"), "model")
    if table.count() <= most:
        held = table.toArrow()
        keys, bits = held.column("h").to_numpy().view(np.uint64), held.column("bits").to_numpy()
        order = np.argsort(keys)
        shared = docs.sparkSession.sparkContext.broadcast((keys[order], bits[order]))

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            look = Lookup(*shared.value)
            for batch in batches:
                yield measure(batch, look)

        return docs.mapInArrow(told, schema)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        for n, batch in enumerate(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part + n] * len(batch), pa.int64())], [*batch.schema.names, "block"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            for block in np.unique(blocks).tolist():
                h = _distinct(_bytes(batch.column(1).filter(pa.array(blocks == block))))[0]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(h), pa.int64()), pa.array(h.view(np.int64))], ["block", "h"])

    def met(texts: pa.Table, answers: pa.Table) -> pa.Table:
        keys, first = np.unique(answers.column("h").to_numpy().view(np.uint64), return_index=True)
        look = Lookup(keys, answers.column("bits").to_numpy()[first])
        batches = texts.drop_columns("block").combine_chunks().to_batches(max_chunksize=1024)
        return pa.Table.from_batches([measure(b, look) for b in batches])

    kinds = ", ".join(f"{n} {t}" for n, t in docs.dtypes)
    blocks = stage(docs.mapInArrow(dealt, f"{kinds}, block bigint"), "blocks")  # a batch of bounded bytes each
    answers = blocks.select("block", docs.columns[1]).mapInArrow(asked, "block bigint, h bigint").join(table, "h").select("block", "h", "bits")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(met, schema)
