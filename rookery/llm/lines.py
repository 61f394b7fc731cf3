"""Lines that many documents share, dropped from all but one of them.

A line's key goes on as a 128-bit hash, with the document and the line's places in
it. Hashes are partitioned by range and sorted by document (largest first) and text,
so a task streams each hash's documents in order: the first one keeps its lines, and
those after it lose theirs once there are enough. A range may end within a hash that
very many documents share; what a task can't decide of its first and its last hash it
leaves open, with a summary of two rows a task, from which those are decided.

What comes back is no text but a bitmap for each document that loses lines: a bit a
line, 1 where it stays, compressed.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import stage, values

#: Code points of a key, and documents that hold it, from which its lines go.
KEY_CHARS, DOCUMENTS = 20, 3
SPACE = b" \t\n\v\f\r"
#: Keys of one Arrow batch.
ROWS = 100_000


def keys_of(text: bytes, key_chars: int = KEY_CHARS) -> tuple[int, dict[bytes, list[int]]]:
    """The number of lines, and the places (from 0) of each key: the line stripped of ASCII
    white space, A-Z lower-cased, if it has `key_chars` code points or more."""
    found: dict[bytes, list[int]] = {}
    lines = text.lower().split(b"\n")  # bytes: A-Z alone
    for i, line in enumerate(lines):
        if len(line) >= key_chars:
            key = line.strip(SPACE)
            if len(key) >= key_chars and (key.isascii() or len(key.decode(errors="replace")) >= key_chars):
                found.setdefault(key, []).append(i)
    return len(lines), found


def line_keys(docs: DataFrame, key_chars: int = KEY_CHARS) -> DataFrame:
    """(h1, h2, doc, text_key, n_lines, places) for each key of each row of `docs` (doc, text_key, text)."""
    kind = docs.schema["doc"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, sizes, digests, places = [], [], [], []

            def flush() -> pa.RecordBatch:
                h = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                at = pa.array(owners, pa.int64())
                return pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column(0).take(at), batch.column(1).take(at), pa.array(sizes, pa.int32()), pa.array(places, pa.binary())], ["h1", "h2", "doc", "text_key", "n_lines", "places"])

            for k, text in enumerate(values(batch.column(2))):
                n, found = keys_of(text, key_chars)
                owners += [k] * len(found)
                sizes += [n] * len(found)
                digests += [xxhash.xxh3_128_digest(key) for key in found]
                places += [np.array(p, "<u4").tobytes() for p in found.values()]
                if len(owners) >= ROWS:
                    yield flush()
                    owners, sizes, digests, places = [], [], [], []
            yield flush()

    return docs.select("doc", "text_key", "text").mapInArrow(read, f"h1 bigint, h2 bigint, doc {kind}, text_key bigint, n_lines int, places binary")


def _changes(column: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """Where a value differs from the one before it; nulls are equal."""
    first = pa.array([None if before is None else before.as_py()], column.type)
    earlier = pa.concat_arrays([first, column.slice(0, max(len(column) - 1, 0))])
    differ = pc.fill_null(pc.not_equal(column, earlier), False).to_numpy(zero_copy_only=False)
    return differ | (column.is_null().to_numpy(zero_copy_only=False) != earlier.is_null().to_numpy(zero_copy_only=False))


#: What a task says of a row: it's dropped; it depends on other tasks; a summary of the documents of a hash.
DROP, OPEN, ENDS = 0, 1, 2


def stream(batches: Iterator[pa.RecordBatch], part: int, documents: int = DOCUMENTS) -> Iterator[pa.RecordBatch]:
    """Rows (DROP, OPEN, ENDS) of one task's sorted keys. Held in memory: a batch, and of one
    hash the rows of the second to the last document before there are enough."""
    key: tuple[int, int] | None = None
    count, top, last, is_first = 0, None, None, True  # of the run of equal hashes that is going on
    pending: list[pa.RecordBatch] = []

    def told(kind: int, rows: pa.RecordBatch) -> pa.RecordBatch:
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), *rows.columns, pa.array(np.full(n, part, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, rows.column(2).type)], NAMES)

    def ends(doc_type: pa.DataType) -> pa.RecordBatch:
        one = [pa.array([ENDS], pa.int8()), pa.array([key[0]]), pa.array([key[1]]), pa.array([top.as_py()], doc_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary())]
        return pa.RecordBatch.from_arrays([*one, pa.array([part], pa.int32()), pa.array([count], pa.int64()), pa.array([last.as_py()], doc_type)], NAMES)

    for batch in batches:
        n = len(batch)
        if not n:
            continue
        h1, h2 = (batch.column(i).to_numpy() for i in (0, 1))
        docs = batch.column(2)
        same = np.empty(n, bool)
        same[0] = key == (h1[0], h2[0])
        same[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        fresh = ~same | _changes(docs, last)
        starts = np.flatnonzero(~same)
        run = np.cumsum(~same) - (0 if same[0] else 1)  # 0: what the first row belongs to
        seen = np.cumsum(fresh)
        before = np.where(np.arange(run[-1] + 1) == 0, -count if same[0] else 0, 0)
        before[run[starts]] = seen[starts] - 1
        rank = seen - before[run]  # of the row's document among those of its hash, from 1
        stops = np.append(np.flatnonzero(np.diff(run)), n - 1)
        total = rank[stops]
        if not same[0] and key is not None:  # the run before is over
            if is_first:
                yield ends(docs.type)
            is_first, pending = False, []
        enough = total >= documents
        state = np.where((rank >= 2) & enough[run], DROP, -1)
        if is_first:
            state[run == 0] = OPEN
        elif same[0] and enough[0]:
            yield from (told(DROP, p) for p in pending)
            pending = []
        elif run[-1] > 0:
            pending = []
        finished_first = is_first and run[-1] > 0
        if finished_first:
            size = int(total[0])
            if key is None or not same[0]:
                top = docs[0]
            key, count, last = (int(h1[0]), int(h2[0])), size, docs[int(stops[0])]
            yield ends(docs.type)
            is_first = False
        a = int(starts[-1]) if len(starts) else 0
        if len(starts):
            top = docs[a]
        if not is_first and not enough[-1]:
            waits = np.flatnonzero((run == run[-1]) & (rank >= 2))
            if len(waits):
                pending.append(batch.slice(int(waits[0]), int(waits[-1] - waits[0] + 1)))
        key, count, last = (int(h1[-1]), int(h2[-1])), int(total[-1]), docs[n - 1]
        for kind in (DROP, OPEN):
            rows = batch.filter(pa.array(state == kind))
            if len(rows):
                yield told(kind, rows)
    if key is not None:
        yield from (told(OPEN, p) for p in pending)
        yield ends(last.type)


NAMES = ["kind", "h1", "h2", "doc", "text_key", "n_lines", "places", "part", "documents", "last"]


def _dropped(keys: DataFrame, documents: int) -> DataFrame:
    """Of `keys` (a written table) the rows (doc, text_key, n_lines, places) whose lines go."""
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc_nulls_last(), F.col("text_key")]
    kind = keys.schema["doc"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from stream(batches, TaskContext.get().partitionId(), documents)

    ranged = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    judged = stage(ranged.mapInArrow(judge, f"kind tinyint, h1 bigint, h2 bigint, doc {kind}, text_key bigint, n_lines int, places binary, part int, documents bigint, last {kind}"), "judged")
    # Two rows a task at most, so as many of one hash as there are tasks at most.
    along = Window.partitionBy("h1", "h2").orderBy("part")
    carried = F.lag(F.struct("last")).over(along).eqNullSafe(F.struct(F.col("doc").alias("last")))  # a document on both sides of a border
    sums = judged.where(F.col("kind") == ENDS).withColumn("more", F.col("documents") - carried.cast("bigint")).groupBy("h1", "h2").agg(F.sum("more").alias("n"), F.min_by(F.struct("doc"), "part").alias("top"))
    many = sums.where(F.col("n") >= documents).select("h1", "h2", "top")
    rest = judged.where(F.col("kind") == OPEN).join(F.broadcast(many), ["h1", "h2"]).where(~F.struct("doc").eqNullSafe(F.col("top")))
    columns = ["doc", "text_key", "n_lines", "places"]
    return judged.where(F.col("kind") == DROP).select(columns).unionByName(rest.select(columns))


def keep_bitmaps(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", key_chars: int = KEY_CHARS, documents: int = DOCUMENTS) -> DataFrame:
    """(doc, text_key, n_lines, n_dropped, keep) of each document that loses lines: its
    id, a hash of its text, and a bitmap of its lines (`kept_lines` reads it).

    A line goes if its key (stripped of ASCII white space, A-Z lower-cased, `key_chars`
    code points or more) is in `documents` documents or more, but from the one with the
    largest id. Rows of one id are one document in that; those with a null id are one
    document too, smaller than any other. Equal rows share a bitmap. Null and empty texts
    have one empty line, which stays. Other columns aren't read; an empty table gives none."""
    rows = docs.select(F.col(id_column).alias("doc"), F.xxhash64(text_column).alias("text_key"), F.col(text_column).alias("text"))
    gone = _dropped(stage(line_keys(rows, key_chars), "line_keys"), documents)
    # As many as the text has keys at most, however often the row is repeated.
    each = gone.groupBy("doc", "text_key").agg(F.first("n_lines").alias("n_lines"), F.collect_set("places").alias("places"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_dropped, bits = [], []
            for n, places in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                keep = np.ones(n, np.uint8)
                keep[np.frombuffer(b"".join(places), "<u4")] = 0
                n_dropped.append(n - int(keep.sum()))
                bits.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n_dropped, pa.int32()), pa.array(bits, pa.binary())], ["doc", "text_key", "n_lines", "n_dropped", "keep"])

    kind = rows.schema["doc"].dataType.simpleString()
    return each.mapInArrow(draw, f"doc {kind}, text_key bigint, n_lines int, n_dropped int, keep binary")


def kept_lines(text: bytes, keep: bytes | None) -> list[bytes]:
    """The lines of `text` that its bitmap keeps; without one all."""
    lines = text.split(b"\n")
    if keep is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return [line for line, bit in zip(lines, bits.tolist(), strict=True) if bit]


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc, text, keep): each row of `docs` with its bitmap, or null if it keeps all lines."""
    rows = docs.select(F.col(id_column).alias("doc"), F.xxhash64(text_column).alias("text_key"), F.col(text_column).alias("text"))
    same: Column = rows["doc"].eqNullSafe(bitmaps["doc"]) & (rows["text_key"] == bitmaps["text_key"])
    return rows.join(bitmaps, same, "left").select(rows["doc"], rows["text"], bitmaps["keep"])


def drop_lines(docs: DataFrame, **options) -> DataFrame:
    """(doc, text) for each row of `docs`: the lines that stay, joined by \\n; options as of `keep_bitmaps`."""
    names = {k: v for k, v in options.items() if k in ("id_column", "text_column")}
    told = with_bitmaps(docs, keep_bitmaps(docs, **options), **names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"\n".join(kept_lines(t, k)).decode(errors="replace") for t, k in zip(values(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc", "text"])

    return told.mapInArrow(cut, f"doc {told.schema['doc'].dataType.simpleString()}, text string")


def line_digests(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for each row of `docs`, through its bitmap."""
    names = {k: v for k, v in options.items() if k in ("id_column", "text_column")}
    told = with_bitmaps(docs, keep_bitmaps(docs, **options), **names)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, digests = [], [], []
            for text, keep in zip(values(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                n = text.count(b"\n") + 1
                lines = None if keep is None else kept_lines(text, keep)
                n_lines.append(n)
                n_dropped.append(0 if lines is None else n - len(lines))
                digests.append(hashlib.sha256(text if lines is None else b"\n".join(lines)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return told.mapInArrow(digest, f"doc_id {told.schema['doc'].dataType.simpleString()}, n_lines bigint, n_dropped bigint, kept_sha256 string")
