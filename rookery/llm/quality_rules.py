"""Quality rules: counts of words, symbols and repeats, and an n-gram model's perplexity.

The model (kneser_ney, five code points) is counted over all texts; perplexity is
that of a word: 2 to the bits of a text over its words. A document is rejected if
it lies outside its language's band, whose bounds come from the quartiles of the
bits a word over that language's documents: at FENCE times their distance
(MIN_WIDTH at least) beyond them, far outside what is usual. A mean over n words
scatters the more the fewer they are, so the band of a text is wider by
sqrt(1 + SCATTER / n).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kneser_ney
from .base import binary, stage

FENCE, MIN_WIDTH, SCATTER = 3.0, 0.25, 100
WINDOW = 8
#: Digits of the bits a word that quartiles are counted by.
DIGITS = 3

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_ODD = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(1, WINDOW + 1)], np.uint64)


def repeated(words: list[list[bytes]]) -> np.ndarray:
    """For each text, its words that lie in a window of 8 words found twice or more in it."""
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    if total < WINDOW:
        return np.zeros(len(words), np.int64)
    hashes = np.fromiter((h for w in words for h in map(hash, w)), np.int64, total).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    n = total - WINDOW + 1
    key = owner[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(WINDOW):
        key += hashes[i : n + i] * _ODD[i]
    whole = owner[:n] == owner[WINDOW - 1 :]
    at = np.flatnonzero(whole)
    order = at[np.argsort(key[at], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    twice = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
    return covered[ends] - covered[ends - sizes]


def _per_text(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[starts[1:]] - sums[starts[:-1]]


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measured(batch: pa.RecordBatch, look: kneser_ney.Lookup) -> pa.RecordBatch:
    """(id, lang, NAMES, bits) of rows (id, text, lang): bits a word, null without words."""
    columns: list[list] = [[] for _ in range(6)]
    texts = binary(batch.column(1))
    for at in range(0, len(texts), 256):
        some = texts.slice(at, 256)
        offsets = np.frombuffer(some.buffers()[1], np.int32, len(some) + 1, some.offset * 4).astype(np.int64)
        starts = offsets - offsets[0]
        data = np.frombuffer(some.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if starts[-1] else np.zeros(0, np.uint8)
        values = some.to_pylist()
        words = [t.split() for t in values]
        lines = [[x for x in t.split(b"\n") if x and not x.isspace()] for t in values]
        sums = kneser_ney.total_bits(values, look).tolist()
        bits = [b / len(w) if w else None for b, w in zip(sums, words, strict=True)]
        for column, value in zip(columns, ([len(w) for w in words], _per_text(~_SPACE[data] & ((data & 0xC0) != 0x80), starts), _per_text(_SYMBOL[data], starts), [len(x) - len(set(x)) for x in lines], repeated(words), bits), strict=True):
            column.extend(value)
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.float64())], ["id", "lang", *NAMES, "bits"])


def quartiles(rows: DataFrame) -> DataFrame:
    """(tongue, q1, q3) of `rows` (tongue, bits), to DIGITS digits: from how often each
    value comes, so that of a language only its distinct values meet."""
    counts = rows.where("bits is not null").groupBy("tongue", F.round("bits", DIGITS).alias("at")).agg(F.count("*").alias("n"))
    by_tongue = Window.partitionBy("tongue")
    told = counts.withColumn("upto", F.sum("n").over(by_tongue.orderBy("at"))).withColumn("all", F.sum("n").over(by_tongue))
    return told.groupBy("tongue").agg(*(F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("at"))).alias(name) for name, share in (("q1", 0.25), ("q3", 0.75))))


def apply_rules(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", fence: float = FENCE, min_width: float = MIN_WIDTH, broadcast_rows: int = kneser_ney.BROADCAST_ROWS) -> DataFrame:
    """A row for each row of `docs`: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, perplexity (of a word), low, high, kept.

    Null texts are empty: no words, so they fail and their perplexity is null. A
    null language is a language of its own; one in which every document fails the base has no
    band, and keeps nothing that it would decide. Repeated rows and null ids stay,
    other columns aren't read, an empty table gives none. Two passes over the texts;
    shuffled are n-gram counts and how often each value of a language comes. A model of
    more than `broadcast_rows` n-grams isn't sent to all tasks (`kneser_ney.scored`)."""
    model = kneser_ney.fitted(kneser_ney.counted(docs.select(text_column)))
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang"))
    kind = source.schema[0].dataType.simpleString()
    schema = f"id {kind}, lang string, {', '.join(f'{n} bigint' for n in NAMES)}, bits double"
    rows = stage(kneser_ney.scored(source, model, _measured, schema, most=broadcast_rows).withColumnRenamed("id", "doc_id"), "measured")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("tongue", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")))
    width = fence * F.greatest(F.col("q3") - F.col("q1"), F.lit(min_width))
    bands = quartiles(rows.where(~F.col("base_failed"))).withColumn("width", width)
    told = rows.join(bands, "tongue", "left").withColumn("wide", F.col("width") * F.sqrt(1 + SCATTER / F.greatest("n_words", F.lit(1))))
    for name, power in (("perplexity", F.col("bits")), ("low", F.col("q1") - F.col("wide")), ("high", F.col("q3") + F.col("wide"))):
        told = told.withColumn(name, F.pow(F.lit(2.0), power))
    kept = ~F.col("base_failed") & F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return told.select("doc_id", *NAMES, "base_failed", kept.alias("kept"), "perplexity", "low", "high")
