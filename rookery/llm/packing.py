"""Packing of token pieces into sequences of fixed room, by linear grouping.

What decides a packing is how many pieces have each length, and lengths are whole
numbers up to the room C; so the plan is made from that histogram, C numbers
however large the table is, and says for the pieces of a length, numbered from 0,
which run of them goes to which run of sequences, and where in them:

1. Large pieces, from long to short, form groups of almost equal number, each
   rounded up to its longest.
2. A few sizes are left. Configurations of sizes that fit one sequence are found
   by column generation (a knapsack over the dual prices finds the next), and the
   linear programme over them says how many sequences to fill by each.
3. Actual pieces take the places of rounded ones.
4. What the rounded-down programme leaves over and the small pieces go, from long
   to short, where they fit best.

Rounding up costs room that best fit can't always use, so 3 and 4 are tried with
several shares of the configurations, and the plan with the fewest sequences is
taken: a histogram makes each cheap.

The table itself is only numbered (within its length, in hash buckets) and told
its places.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import stage, values
from .tokens import encoded

GROUPS = 64
SMALL_SHARE = 6
#: Shares of the programme's sequences that are tried.
SHARES = (1.0, 0.9, 0.75, 0.5, 0.25)

#: (length, first and end of the run of pieces, first sequence, offset)
Plan = list[tuple[int, int, int, int, int]]


def _configurations(sizes: np.ndarray, counts: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the covering programme min sum(x), A x >= counts, and x, by column generation."""
    k, ascending = len(sizes), np.argsort(sizes, kind="stable")
    small_first, fits = sizes[ascending], np.searchsorted(sizes[ascending], np.arange(room + 1), side="right")
    columns = np.zeros((k, k), int)
    columns[np.arange(k), np.arange(k)] = room // sizes
    basis = columns.astype(float)
    inverse = np.diag(1 / np.diag(basis))
    x = inverse @ counts
    for _ in range(40 * k):
        prices = inverse.sum(axis=0)
        best, choice, worth = np.zeros(room + 1), np.full(room + 1, -1), prices[ascending]
        for c in range(int(small_first[0]), room + 1):  # best[c]: value of the best filling of c
            values = best[c - small_first[: fits[c]]] + worth[: fits[c]]
            i = values.argmax()
            if values[i] > best[c - 1] + 1e-12:
                best[c], choice[c] = values[i], ascending[i]
            else:
                best[c] = best[c - 1]
        if best[room] <= 1 + 1e-6:
            break
        column, c = np.zeros(k, int), room
        while c > 0:
            if choice[c] < 0:
                c -= 1
            else:
                column[choice[c]] += 1
                c -= int(sizes[choice[c]])
        direction = inverse @ column
        positive = direction > 1e-9
        ratios = np.where(positive, x / np.where(positive, direction, 1), np.inf)
        out = int(ratios.argmin())
        step = ratios[out]
        x = x - step * direction
        x[out] = step
        columns[:, out] = column
        row = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, row)
        inverse[out] = row
    return columns, np.maximum(x, 0)


def plan(histogram: dict[int, int], room: int, *, groups: int = GROUPS, small_share: int = SMALL_SHARE) -> tuple[Plan, int]:
    """The plan for so many pieces of each length (1 to `room`), and its number of
    sequences: of several ways to use the configurations, the one with the fewest.
    They fill all the sequences that the programme says, or a share of them, as they
    are, or but for each one's smallest place, which then goes to whatever piece fits
    it best. None has more sequences than best fit alone, which is the last one tried."""
    lengths = np.array(sorted((n for n, c in histogram.items() if room > n > room // small_share and c), reverse=True), np.int64)
    ends = np.cumsum([histogram[n] for n in lengths.tolist()]).astype(np.int64)
    tried = []
    if len(lengths):
        grouped = _grouped(lengths, ends, room, groups)
        tried = [_planned(histogram, room, lengths, ends, grouped, share, open_last) for share in SHARES for open_last in (True, False)]
    return min([*tried, _planned(histogram, room, lengths, ends, None)], key=lambda t: t[1])


def _grouped(lengths: np.ndarray, ends: np.ndarray, room: int, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of almost equal number of the large pieces (from long to short): where they start and
    stop, the size each is rounded up to; and the configurations with how many sequences to fill by each."""
    bounds = np.unique(np.concatenate([[0], np.ceil(np.arange(1, groups + 1) * ends[-1] / groups).astype(np.int64)]))
    starts = bounds[:-1]
    size = lengths[np.searchsorted(ends, starts, side="right")]
    first = np.concatenate([[True], size[1:] != size[:-1]])  # groups of one size are one
    starts = starts[first]
    stops = np.append(starts[1:], ends[-1])
    return starts, stops, size[first], *_configurations(size[first], (stops - starts).astype(float), room)


def _planned(histogram: dict[int, int], room: int, lengths: np.ndarray, ends: np.ndarray, grouped: tuple | None, share: float = 1.0, open_last: bool = False) -> tuple[Plan, int]:
    out: Plan = []
    used = {n: 0 for n in histogram}  # pieces of each length that have a place
    n_sequences = int(histogram.get(room, 0))
    if n_sequences:
        out.append((room, 0, n_sequences, 0, 0))
        used[room] = n_sequences
    free: dict[int, list[tuple[int, int]]] = {}  # by room left: runs of sequences
    rooms: list[int] = []

    def leave(left: int, start: int, end: int) -> None:
        if left and end > start:
            if left not in free:
                free[left] = []
                insort(rooms, left)
            free[left].append((start, end))

    rest: dict[int, int] = {n: c for n, c in histogram.items() if 0 < n < room and c}
    if grouped is not None:
        at, stops, sizes, columns, x = grouped[0].copy(), *grouped[1:]
        for j in np.argsort(-(sizes @ columns), kind="stable"):
            column, n = columns[:, j].copy(), int(share * x[j] + 1e-6)
            if open_last and column.sum() > 1:
                column[np.flatnonzero(column)[-1]] -= 1  # sizes fall from group to group
            left = stops - at
            while n > 0:  # a column may ask for more than is left
                use = np.minimum(column, left)
                if not use.any():
                    break
                with np.errstate(divide="ignore"):
                    times = int(min(n, np.where(use > 0, left // np.maximum(use, 1), n).min()))
                for a, b, total in _fill(out, used, use, times, at, lengths, ends, n_sequences):
                    leave(room - total, n_sequences + a, n_sequences + b)
                at = at + use * times
                left = stops - at
                n_sequences += times
                n -= times
        # Numbers within a length are given out in order, so what is left of each is renumbered below.
        rest = {n: c - used[n] for n, c in rest.items() if c > used[n]}
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                fresh = -(-n // (room // length))
                leave(room, n_sequences, n_sequences + fresh)
                n_sequences += fresh
                continue
            left = rooms[i]
            start, end = free[left].pop()
            if not free[left]:
                del free[left]
                rooms.pop(i)
            each = left // length  # a sequence takes all it can before the next one does
            take = min(n // each, end - start)
            if not take:
                each, take = n, 1
            leave(left, start + take, end)
            for copy in range(each):
                out.append((length, used[length], used[length] + take, start, room - left + copy * length))
                used[length] += take
            leave(left - each * length, start, start + take)
            n -= each * take
    return out, n_sequences


def _runs(start: int, end: int, lengths: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Places `start` to `end` of all large pieces, from long to short, as runs of one length."""
    i = int(np.searchsorted(ends, start, side="right"))
    while start < end:
        stop = min(end, int(ends[i]))
        yield int(lengths[i]), start, stop
        start, i = stop, i + 1


def _fill(out: Plan, used: dict[int, int], use: np.ndarray, times: int, at: np.ndarray, lengths: np.ndarray, ends: np.ndarray, base: int) -> list[tuple[int, int, int]]:
    """Puts actual pieces into `times` sequences of one configuration; runs of sequences and the room they take."""
    parts = [(0, times, 0)]
    for g in np.flatnonzero(use):
        for copy in range(int(use[g])):
            start = int(at[g]) + copy * times
            new = []
            for length, a, b in _runs(start, start + times, lengths, ends):
                for p, q, total in parts:
                    low, high = max(p, a - start), min(q, b - start)
                    if low < high:
                        out.append((length, used[length], used[length] + high - low, base + low, total))
                        used[length] += high - low
                        new.append((low, high, total + length))
            parts = new
    return parts


def token_pieces(docs: DataFrame, path: str, *, room: int = 2048, id_column: str = "doc_id", text_column: str = "text", end_id: int = 0) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32: each text's token ids, then
    `end_id`, cut into pieces of `room`. Null and empty texts are one piece of the
    end id alone; repeated rows and null ids stay. One pass, no shuffle; ids don't
    leave the worker."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owners = [], []
            for k, ids in enumerate(encoded(values(batch.column(1)), path)):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * room)):
                    part = ids[at : at + 4 * room]
                    rows.append((piece, at // 4, len(part) // 4, zlib.crc32(part)))
                    owners.append(k)
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True))], ["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.select(id_column).schema[0].dataType.simpleString()
    found = docs.select(id_column, text_column).mapInArrow(cut, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")
    return found.withColumnRenamed("id", "doc_id")


def numbered(pieces: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """`pieces` (a written table, with a number of its own for each: row) with n, the number of each
    within its length from 0, and the histogram of lengths. Pieces are numbered within buckets, by row, so that a length (or an id, null say) that a third of them have isn't one
    task's; of a bucket and length only the count is gathered. Equal rows may swap numbers."""
    buckets = max(16, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("c"))
    before = counts.withColumn("before", F.sum("c").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    within = Window.partitionBy("length", "bucket").orderBy("row")
    rows = dealt.withColumn("n", F.row_number().over(within) - 1).join(before.select("length", "bucket", "before"), ["length", "bucket"])
    histogram = {r["length"]: r["c"] for r in counts.groupBy("length").agg(F.sum("c").alias("c")).collect()}  # one row a length at most
    return rows.withColumn("n", F.col("n") + F.coalesce("before", F.lit(0))).drop("before", "bucket", "row"), histogram


def pack(pieces: DataFrame, *, room: int = 2048, groups: int = GROUPS, small_share: int = SMALL_SHARE) -> DataFrame:
    """`pieces` (doc_id, piece, start, length from 1 to `room`, ids_crc32) with
    sequence_id and offset: pieces of a sequence stand one after another from 0 and
    take `room` at most. A piece stands once; repeated rows are pieces of their own;
    an empty table gives none. `pieces` is written first, each with its number, so that
    a task that runs again, or a scan that is split otherwise, sees the same rows."""
    rows, histogram = numbered(stage(pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.monotonically_increasing_id().alias("row")), "pieces"))
    steps, _ = plan(histogram, room, groups=groups, small_share=small_share)
    # As large as the room's square at worst, however many pieces there are.
    table = np.array(sorted(steps), np.int64).reshape(-1, 5)
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = shared.value
        keys = (told[:, 0] << 48) + told[:, 1]
        for batch in batches:
            length, n = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "n"))
            at = told[np.searchsorted(keys, (length << 48) + n, side="right") - 1] if len(told) else np.zeros((0, 5), np.int64)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(at[:, 3] + n - at[:, 1]), pa.array(at[:, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = pieces.select("doc_id").schema[0].dataType.simpleString()
    return rows.mapInArrow(place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
