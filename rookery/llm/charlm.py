"""A small character n-gram model with modified Kneser-Ney smoothing, for decoding.

Texts are read as UTF-8 bytes, folded into 64 classes, so the table of all n-grams
of order N has 64**N rows however large the corpus is, and a decoder finds any
transition by its key. Spark counts them over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import binary

CLASSES = 64


def _classes() -> np.ndarray:
    """A class for each byte: white space 0, letters, one for digits, stops, marks, symbols, and six for bytes beyond ASCII."""
    out = np.zeros(256, np.uint8)
    for i in range(256):
        c = chr(i)
        if i >= 128:
            out[i] = 58 + i % 6
        elif c.isalpha():
            out[i] = 1 + ord(c.lower()) - 97
        elif c.isdigit():
            out[i] = 53
        elif c in ".,":
            out[i] = 54 + ".,".index(c)
        elif c in "#*$%&|<>":
            out[i] = 57
        elif c > " ":
            out[i] = 56
    return out


FOLDED = _classes()


def keys_of(texts: pa.Array, order: int, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram key that ends at each byte of `texts` (binary, no nulls), and where each text's keys begin (one more at the end). Before a text stands white space."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    starts = offsets - offsets[0]
    folded = classes[data].astype(np.uint32)
    keys = folded.copy()
    within = np.arange(len(data)) - np.repeat(starts[:-1], np.diff(starts)) if order > 1 else None
    for back in range(1, order):
        keys[back:] |= np.where(within[back:] >= back, folded[:-back], 0).astype(np.uint32) << np.uint32(6 * back)
    return keys, starts


def count(docs: DataFrame, text_column: str, order: int, classes: np.ndarray) -> DataFrame:
    """(key, n) over all of every text: each task sums its own n-grams before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**order, np.uint32)
        for batch in batches:
            texts = binary(batch.column(0))
            for at in range(0, len(texts), 256):
                found, n = np.unique(keys_of(texts.slice(at, 256), order, classes)[0], return_counts=True)
                total[found] += n.astype(np.uint32)
        keys = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total[keys].astype(np.int64))], ["key", "n"])

    return docs.select(text_column).mapInArrow(counted, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """log2 probabilities: `values` of the n-grams in `keys` (sorted); for others, `backoff` of their context plus `lower` (by the n-gram without its first symbol)."""

    order: int
    keys: np.ndarray
    values: np.ndarray
    backoff: np.ndarray
    lower: np.ndarray
    table: np.ndarray | None = None  # of all n-grams, where a reader wants one (small orders)
    costs: list[float] | None = None  # the same as a list

    def score(self, keys: np.ndarray) -> np.ndarray:
        out = self.backoff[keys >> 6] + self.lower[keys & np.uint32(CLASSES ** (self.order - 1) - 1)]
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            out = np.where(self.keys[at] == keys, self.values[at], out)
        return out


def _discounts(counts: np.ndarray) -> np.ndarray:
    """The three discounts of modified Kneser-Ney, for counts 1, 2 and more (0 for 0)."""
    n = [float((counts == i).sum()) for i in (1, 2, 3, 4)]
    if not n[0] or not n[1]:
        return np.array([0, 0.5, 0.75, 1])
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k) if n[k - 1] and n[k] else 0.5 * k for k in (1, 2, 3))])


def fit(counts: DataFrame, order: int) -> Model:
    """The model from counted n-grams (`count`), at most 64**order rows."""
    found = counts.toPandas().sort_values("key")
    keys, n = found["key"].to_numpy(np.int64), found["n"].to_numpy(np.float64)
    if not len(keys):
        flat = np.full(CLASSES ** (order - 1), -np.log2(CLASSES), np.float32)
        return Model(order, keys.astype(np.uint32), np.zeros(0, np.float32), np.zeros_like(flat), flat)
    levels = [(keys, n)]  # below the highest order, n-grams count by how many symbols they follow
    for k in range(order - 1, 0, -1):
        levels.append(np.unique(levels[-1][0] & (CLASSES**k - 1), return_counts=True))
    p = np.full(CLASSES, 1 / CLASSES)  # by the n-gram, of the order below
    for k in range(1, order + 1):
        keys, n = levels[order - k]
        n = n.astype(np.float64)
        taken = _discounts(n)[np.minimum(n, 3).astype(int)]
        contexts = CLASSES ** (k - 1)
        total, left = (np.bincount(keys >> 6, x, contexts) for x in (n, taken))
        backoff = np.where(total > 0, left / np.maximum(total, 1), 1.0)
        if k == order:
            values = (n - taken) / total[keys >> 6] + backoff[keys >> 6] * p[keys & (contexts - 1 if k > 1 else 63)]
            return Model(order, keys.astype(np.uint32), np.log2(values).astype(np.float32), np.log2(np.maximum(backoff, 1e-9)).astype(np.float32), np.log2(p).astype(np.float32))
        full = np.repeat(backoff, CLASSES) * (p if k == 1 else np.tile(p, CLASSES))
        full[keys] += (n - taken) / total[keys >> 6]
        p = full
    raise AssertionError
