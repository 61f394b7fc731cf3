"""Vectors as short codes: each part of a vector is the index of its nearest codebook entry.

Components become whole numbers, so distances, sums and codebooks are exact and the
same however the vectors are dealt out. The codebooks (parts x entries) go to all
tasks; an Arrow batch finds all its distances at once, as |x|^2 - 2 x.c + |c|^2 with
matrix products of int64, and the first smallest. A task gives one sum for each entry
it used and component; a grouped shuffle adds them up, and the driver sees as many
rows as the codebooks have components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stage

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each part of each vector (n, parts, m) the first nearest entry of `book` (parts, entries, m) and the squared distance."""
    entry, far = (np.empty(x.shape[:2], np.int64) for _ in range(2))
    for p in range(x.shape[1]):
        own, centres = np.ascontiguousarray(x[:, p]), book[p]
        d = (own * own).sum(axis=1)[:, None] - 2 * (own @ centres.T) + (centres * centres).sum(axis=1)
        entry[:, p] = d.argmin(axis=1)
        far[:, p] = d[np.arange(len(d)), entry[:, p]]
    return entry, far


def _cut(column: pa.Array, size: int, parts: int) -> np.ndarray:
    """Lists of `size` numbers as (n, parts, m) of int64; zeros fill up the last part."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)
    room = -(-size // parts) * parts
    return np.pad(flat, ((0, 0), (0, room - size))).reshape(len(flat), parts, room // parts)


def _sums(x: np.ndarray, entry: np.ndarray, total: np.ndarray) -> None:
    """Adds to `total` (parts, entries, m + 1) the components of each entry's vectors, and their number."""
    entries = np.arange(total.shape[1])[:, None]
    for p in range(x.shape[1]):
        mine = (entries == entry[:, p]).astype(np.int64)
        total[p, :, :-1] += mine @ np.ascontiguousarray(x[:, p])
        total[p, :, -1] += mine.sum(axis=1)


def _refined(rows: DataFrame, book: np.ndarray, size: int) -> np.ndarray:
    """The codebooks after a round: each entry the floor of its parts' mean; unused ones as they were."""
    shared = rows.sparkSession.sparkContext.broadcast(book)
    parts, entries, m = book.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, m + 1), np.int64)
        for batch in batches:
            x = _cut(batch.column(0), size, parts)
            _sums(x, nearest(x, shared.value)[0], total)
        p, e = np.nonzero(total[:, :, -1])
        slots = np.repeat(p * entries + e, m + 1)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.tile(np.arange(m + 1), len(p))), pa.array(total[p, e].reshape(-1))], ["slot", "component", "s"])

    partial = rows.select("q").mapInArrow(add, "slot bigint, component bigint, s bigint")
    found = partial.groupBy("slot", "component").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # parts x entries x (m + 1) at most
    shared.unpersist()
    sums = {(r["slot"], r["component"]): int(r["s"]) for r in found}
    new = book.copy()
    for slot, component in sums:
        if component < m:
            new[slot // entries, slot % entries, component] = sums[slot, component] // sums[slot, m]
    return new


def compress_vectors(
    vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """A row (vec_id, label, code, error) for each vector, and the codebooks (parts, entries, m).

    Components x become floor(scale * x). A codebook starts as that part of the vectors
    with the smallest ids (null ids last; vectors of one id by their components). Each of
    `rounds` rounds gives every part to the nearest entry (ties: the first) and moves
    entries to the floor of their mean. `code` has two hex digits a part, `error` is the
    squared distance left.

    Vectors that are null, empty, or hold a null, NaN or infinity are left out, and so are
    those of another size than the first. A size that `parts` doesn't divide is filled up
    with zeros. A vector so large that its squared distances leave 64 bits (components
    over 32,000 at 64 dimensions) has no code, error null, and moves no entry. Fewer
    vectors than `entries` make fewer entries; repeated rows count as often as they come;
    other columns aren't read; an empty table gives no rows and no codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("two hex digits name 256 entries at most")
    rows = vectors.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"), F.col(vector_column).cast("array<double>").alias("v"))
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    size = F.size("v")
    room = F.least(F.sqrt(2.0**60 / size), F.lit(2.0**31 - 1))  # |x - c|^2 and its terms stay below 2^63
    small = F.forall("v", lambda x: F.abs(x) * scale + 1 < room)
    whole = F.when(small, F.transform("v", lambda x: F.floor(x * scale).cast("int")))
    rows = stage(rows.where(sound).select("id", "label", size.alias("size"), whole.alias("q")), "vectors")
    order = [F.col("id").asc_nulls_last(), F.col("q")]
    first = rows.orderBy(F.col("id").asc_nulls_last(), "size", "q").select("size").first()
    size_ = first["size"] if first else 0
    rows = rows.where(F.col("size") == size_)
    start = [r["q"] for r in rows.where("q is not null").orderBy(*order).limit(entries).select("q").collect()]
    book = _cut(pa.array(start, pa.list_(pa.int32())), size_, parts).transpose(1, 0, 2) if start else np.zeros((parts, 0, 0), np.int64)
    coded = rows.where("q is not null").select("id", "label", "q")
    for _ in range(rounds if start else 0):
        book = _refined(coded, book, size_)

    shared = rows.sparkSession.sparkContext.broadcast(book)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                entry, far = nearest(_cut(batch.column(2), size_, parts), shared.value)
                codes = [row.tobytes().hex() for row in entry.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(codes, pa.string()), pa.array(far.sum(axis=1))], ["vec_id", "label", "code", "error"])

    kinds = ", ".join(f"{name} {rows.schema[c].dataType.simpleString()}" for name, c in (("vec_id", "id"), ("label", "label")))
    found = coded.mapInArrow(encode, f"{kinds}, code string, error bigint")
    too_large = rows.where("q is null").select(F.col("id").alias("vec_id"), "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    return found.unionByName(too_large), book


def book_digest(book: np.ndarray) -> str:
    """SHA-256 of all components' decimal figures by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def code_table(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): `compress_vectors` with the errors
    summed over equal labels (nulls together; null beyond 64 bits)."""
    found, book = compress_vectors(vectors, **options)
    coded = stage(found, "codes")
    # A row a label. Written, so that Spark sends it to all tasks only if it knows it to be small.
    sums = stage(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint").alias("label_error")), "label_errors")
    told = coded.join(sums, coded["label"].eqNullSafe(sums["label"]), "left")
    return told.select("vec_id", "code", "error", "label_error", F.lit(book_digest(book)).alias("codebooks_sha256"))
