"""A quality classifier: a factorisation machine over hashed words, statistics of
structure and metadata.

Features of a text are its words (lower-cased, hashed into WORDS slots, damped
counts of unit length), and statistics, each cut at its quantiles in the training
rows into bins of which one is on. A score is

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

whose last part is the sum over all pairs of features <v_i, v_j> x_i x_j, in time
linear in the features that are on. Weights are learnt on the driver from a
bounded number of labelled rows; documents are scored where they lie.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import binary, keep_rows, label_sample, stage

#: Labelled rows that training reads at most, and their words' slots in all (12 bytes each); slots for words; rank; bins of a statistic.
TRAIN_ROWS, TRAIN_SLOTS, WORDS, RANK, BINS = 4096, 1 << 22, 1 << 14, 8, 8
EPOCHS, RATE, RIDGE, SEED = 12, 0.1, 1e-4, 7
CUT = 0.5

STATISTICS = ("n_words", "word_length", "distinct_words", "top_word", "runs", "symbols", "capitals", "figures", "stops", "beyond_ascii", "line_words", "distinct_lines", "n_chars")

_KIND = np.zeros(256, np.uint8)
_KIND[list(b"#*$%&|<>!~^=")] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[list(b".,;:?")] = 4
_KIND[128:] = 5


def statistics(text: bytes, words: list[bytes], counts: Counter, n_chars: int | None) -> list[float]:
    """STATISTICS of a text; `n_chars` is metadata (the bytes, where it is null)."""
    n, size = max(1, len(words)), max(1, len(text))
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=6)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        np.log1p(len(words)), sum(map(len, words)) / n, np.log1p(len(counts)) / np.log1p(n), max(counts.values(), default=0) / n, same / n,
        *(kinds[1:] / size), np.log1p(len(words) / max(1, len(lines))), len(set(lines)) / max(1, len(lines)), np.log1p(max(0, n_chars if n_chars is not None else len(text))),
    ]


class Hasher(dict):
    """The slot of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        slot = self[word] = zlib.crc32(word) % WORDS
        return slot


def features(text: bytes, n_chars: int | None, slots: Hasher) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Slots of the text's words, their values, and its statistics."""
    words = text.split()
    counts = Counter(words)
    folded = text.lower().split()
    by_slot = Counter(map(slots.__getitem__, folded))
    at = np.fromiter(by_slot.keys(), np.int64, len(by_slot))
    value = np.log1p(np.fromiter(by_slot.values(), np.float64, len(by_slot)))
    return at, value / max(1e-9, float(np.sqrt((value * value).sum()))), statistics(text, words, counts, n_chars)


@dataclass
class Machine:
    """w0, weights, factors, and the bounds of the statistics' bins."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    bounds: np.ndarray

    def row(self, at: np.ndarray, value: np.ndarray, stats: list[float]) -> tuple[np.ndarray, np.ndarray]:
        bins = (np.array(stats)[:, None] >= self.bounds).sum(axis=1)
        on = WORDS + np.arange(len(stats)) * BINS + bins
        return np.concatenate([at, on]), np.concatenate([value, np.full(len(stats), 0.5)])

    def score(self, at: np.ndarray, value: np.ndarray) -> float:
        """In linear time: the square of the sums, less the sum of the squares."""
        v = self.v[at] * value[:, None]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v * v).sum(axis=0)).sum())
        return 1 / (1 + np.exp(-np.clip(self.w0 + float(self.w[at] @ value) + pairs, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray, list[float]]], labels: list[int]) -> Machine:
    """AdaGrad over small batches in a fixed order. Without rows of both kinds the machine knows their share only."""
    size = WORDS + len(STATISTICS) * BINS
    random = np.random.default_rng(SEED)
    flat = Machine(0.0, np.zeros(size), np.zeros((size, RANK)), np.full((len(STATISTICS), BINS - 1), np.inf))
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        flat.w0 = 0.0 if not len(y) else 4.0 if y[0] else -4.0
        return flat
    stats = np.array([r[2] for r in rows])
    flat.bounds = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T.copy()
    m = Machine(0.0, flat.w, random.normal(0, 0.05, (size, RANK)), flat.bounds)
    data = [m.row(*r) for r in rows]
    gw, gv, g0 = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5
    for _ in range(EPOCHS):
        order = random.permutation(len(y))
        for b in range(0, len(order), 64):
            some = order[b : b + 64]
            at = np.concatenate([data[k][0] for k in some])
            value = np.concatenate([data[k][1] for k in some])
            sizes = np.array([len(data[k][0]) for k in some])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            owner = np.repeat(np.arange(len(some)), sizes)
            v = m.v[at]
            xv = v * value[:, None]
            sums = np.add.reduceat(xv, starts)
            raw = m.w0 + np.add.reduceat(m.w[at] * value, starts) + 0.5 * (sums**2 - np.add.reduceat(xv * xv, starts)).sum(axis=1)
            slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[some]) * weight[some] / len(some)
            each = slope[owner] * value
            uniq, place = np.unique(at, return_inverse=True)
            dw = np.bincount(place, each, len(uniq)) + RIDGE * m.w[uniq]
            dv = np.stack([np.bincount(place, each * (sums[owner, f] - xv[:, f]), len(uniq)) for f in range(RANK)], axis=1) + RIDGE * m.v[uniq]
            gw[uniq] += dw * dw
            gv[uniq] += dv * dv
            g0 += slope.sum() ** 2
            m.w[uniq] -= RATE * dw / np.sqrt(gw[uniq])
            m.v[uniq] -= 0.5 * RATE * dv / np.sqrt(gv[uniq])
            m.w0 -= RATE * slope.sum() / np.sqrt(g0)
    return m


def _inputs(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    n_chars = F.col("n_chars").cast("bigint") if "n_chars" in docs.columns else F.lit(None).cast("bigint")
    return docs.select(F.col(id_column).alias("id"), "text", n_chars.alias("n_chars"))


def training_rows(docs: DataFrame, labels: DataFrame, *, target: str = "quality", max_rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, text, n_chars, label) of the labelled sample: of an id one row, that of the smallest hash."""
    some = label_sample(labels, target, max_rows).withColumnRenamed("doc_id", "id")
    rows = _inputs(docs).join(F.broadcast(some), "id")
    one = F.min(F.struct(F.xxhash64("text", "n_chars").alias("h"), "text", "n_chars"))
    return rows.groupBy("id", "label").agg(one.alias("one")).select("id", "one.text", "one.n_chars", "label")


def learn(docs: DataFrame, labels: DataFrame, *, target: str = "quality", max_rows: int = TRAIN_ROWS, max_slots: int = TRAIN_SLOTS) -> Machine:
    """The machine, from `max_rows` labelled rows at most, and of these in order of
    their hash those whose words fill `max_slots` slots in all (so the driver holds a bounded number of bytes)."""
    rows = stage(training_rows(docs, labels, target=target, max_rows=max_rows), "quality_train")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Hasher()
        for batch in batches:
            found = [features(t.as_py(), n.as_py(), slots) for t, n in zip(binary(batch.column(1)), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float64())), pa.array([f[2] for f in found], pa.list_(pa.float64()))], ["id", "label", "at", "value", "stats"])

    kind = rows.schema["id"].dataType.simpleString()
    told = stage(rows.mapInArrow(read, f"id {kind}, label int, at array<int>, value array<double>, stats array<double>"), "quality_features")
    order = Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0)
    sizes = told.select("id", F.size("at").alias("n")).withColumn("upto", F.sum("n").over(order))  # `max_rows` at most
    found = told.join(F.broadcast(sizes.where(F.col("upto") <= max_slots).select("id")), "id").toPandas().sort_values("id", kind="stable")
    return train([(np.asarray(a, np.int64), np.asarray(v), list(s)) for a, v, s in zip(found["at"], found["value"], found["stats"], strict=True)], [int(x == 1) for x in found["label"]])


def score_quality(docs: DataFrame, labels: DataFrame, *, cut: float = CUT, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """A row for each row of `docs`: doc_id, score (0 to 1, higher: label 1 is
    likelier) and predicted (1 from `cut`).

    Null and empty texts are scored by their statistics alone; repeated rows and
    null ids stay; a table without n_chars, or with nulls there, has the text's
    bytes instead; other columns aren't read; an empty table gives none. Without labels every score is 0.5. One pass to score, one to read the labelled rows; no shuffle of texts."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, max_rows=max_rows))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, slots = shared.value, Hasher()
        for batch in batches:
            score = [machine.score(*machine.row(*features(t.as_py(), n.as_py(), slots))) for t, n in zip(binary(batch.column(1)), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array([int(s >= cut) for s in score], pa.int32())], ["doc_id", "score", "predicted"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return _inputs(docs).mapInArrow(scored, f"doc_id {kind}, score double, predicted int")


def drop_low_quality(docs: DataFrame, labels: DataFrame, *, cut: float = CUT, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of `docs`, all columns, that `score_quality` predicts to be good; decided where they lie."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, max_rows=max_rows))
    measured, remembered = "n_chars" in docs.columns, []

    def good(batch: pa.RecordBatch, at) -> np.ndarray:
        if not remembered:
            remembered.append(Hasher())
        machine, slots = shared.value, remembered[0]
        lengths = batch.column(at("n_chars")).to_pylist() if measured else [None] * len(batch)
        return np.array([machine.score(*machine.row(*features(t.as_py(), n, slots))) >= cut for t, n in zip(binary(batch.column(at("text"))), lengths, strict=True)], bool)

    return keep_rows(docs, good)
