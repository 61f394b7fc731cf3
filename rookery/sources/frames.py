"""Compressed dumps of many zstd frames, read by many tasks.

A frame is decompressed by itself, so its header is a place where a task may begin. Frames
are found by walking over the headers of their blocks, without decompressing any. A record
belongs to the task in whose frames its first line begins; that task reads on into the next
ones to the record's end. A file of a single frame stays one task's to read.

Paths are ones that driver and executors can open: local to all, or mounted.
"""

from __future__ import annotations

import os
import struct
import uuid
import warnings
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shared import shared_dir

#: Compressed bytes of a task, about; records of a frame that is written; what is read and decompressed at once.
TASK_BYTES, FRAME_RECORDS, CHUNK = 16 << 20, 2000, 1 << 20
_MAGIC, _SKIPPABLE = 0xFD2FB528, range(0x184D2A50, 0x184D2A60)
_START = b"[Event "


def find_frames(path: str) -> list[tuple[int, int]]:
    """(offset, bytes) of each frame of a file; skippable ones are left out. ValueError for what is no zstd."""
    found, at, size = [], 0, os.path.getsize(path)
    with open(path, "rb") as f:

        def read(n: int, at: int) -> bytes:
            f.seek(at)
            data = f.read(n)
            if len(data) < n:
                raise ValueError(f"{path} ends within a frame")
            return data

        while at < size:
            (magic,) = struct.unpack("<I", read(4, at))
            if magic in _SKIPPABLE:
                at += 8 + struct.unpack("<I", read(4, at + 4))[0]
                continue
            if magic != _MAGIC:
                raise ValueError(f"no frame at byte {at} of {path}")
            told = read(1, at + 4)[0]
            single, checked = told >> 5 & 1, told >> 2 & 1
            end = at + 5 + (1 - single) + (0, 1, 2, 4)[told & 3] + (single, 2, 4, 8)[told >> 6]
            last = False
            while not last:
                block = int.from_bytes(read(3, end), "little")
                last, kind = bool(block & 1), block >> 1 & 3
                if kind == 3:
                    raise ValueError(f"a damaged block at byte {end} of {path}")
                end += 3 + (1 if kind == 1 else block >> 3)
            end += 4 * checked
            if end > size:
                raise ValueError(f"{path} ends within a frame")
            found.append((at, end - at))
            at = end
    return found


class _Frames(InputPartition):
    def __init__(self, path: str, frames: list[tuple[int, int]], first: int, stop: int):
        self.path, self.first, self.stop = path, first, stop
        self.begin = frames[first][0]
        self.before = frames[first - 1] if first else None
        self.own = frames[stop - 1][0] + frames[stop - 1][1]  # where the next task's bytes begin


def _decompressed(path: str, begin: int, end: int | None) -> Iterator[bytes]:
    """The text of the frames from byte `begin` to `end`, or to the end of the file, in chunks."""
    import zstandard

    with open(path, "rb") as f:
        f.seek(begin)
        left = None if end is None else end - begin
        data, one = b"", None
        while True:
            if not data:
                data = f.read(CHUNK if left is None else min(CHUNK, left))
                left = left if left is None else left - len(data)
                if not data:
                    return
            one = one or zstandard.ZstdDecompressor(max_window_size=2**31).decompressobj()
            text = one.decompress(data)
            data = one.unused_data if one.eof else b""
            one = None if one.eof else one
            if text:
                yield text


def records_of(part: _Frames) -> Iterator[bytes]:
    """The records whose first line begins in a task's frames; what stands before a file's first record is one too."""
    held, begun = b"", part.before is None
    own = _decompressed(part.path, part.begin, part.own)
    for n, text in enumerate(own):
        if not n and not begun and text.startswith(_START[: len(text)]):
            # At the very beginning: a record's first line, if the frame before ends a line.
            last = b""
            for last in _decompressed(part.path, part.before[0], sum(part.before)):
                pass
            text, begun = (text, True) if last.endswith(b"\n") else (text, False)
        held += text
        while (at := held.find(b"\n" + _START)) >= 0:
            if begun:
                yield held[:at]
            held, begun = held[at + 1 :], True
        if not begun:
            held = held[-len(_START) :]
    if not begun and not (held and (b"\n" + _START).startswith(held[held.rfind(b"\n") :] if b"\n" in held else b"x")):
        return
    mine = len(held)
    for text in _decompressed(part.path, part.own, None):
        held += text
        while (at := held.find(b"\n" + _START)) >= 0:
            if begun:
                yield held[:at]
            if at + 1 >= mine:
                return
            held, mine, begun = held[at + 1 :], mine - at - 1, True
        if not begun and len(held) >= mine + len(_START):
            return
    if begun and held:
        yield held


class FrameReader(DataSource):
    """format("zstd_frames") with the options path (a file, or a folder of .zst files) and bytes
    (compressed bytes of a task, about): rows (record), without carriage returns and white space at the end."""

    @classmethod
    def name(cls) -> str:
        return "zstd_frames"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bytes = options["path"].removeprefix("file://"), int(options.get("bytes", TASK_BYTES))

    def partitions(self) -> list[InputPartition]:
        at = Path(self.path)
        out: list[InputPartition] = []
        for path in sorted(at.glob("*.zst")) if at.is_dir() else [at]:
            frames = find_frames(str(path))
            if len(frames) == 1 and frames[0][1] > self.bytes:
                warnings.warn(f"{path} is a single frame: one task reads it", stacklevel=2)
            first = 0
            for k in range(len(frames)):
                if k + 1 == len(frames) or frames[k + 1][0] - frames[first][0] >= self.bytes:
                    out.append(_Frames(str(path), frames, first, k + 1))
                    first = k + 1
        return out or [_Frames(os.devnull, [(0, 0)], 0, 1)]

    def read(self, partition: _Frames) -> Iterator[pa.RecordBatch]:
        some: list[str] = []
        for record in records_of(partition):
            text = record.replace(b"\r", b"").rstrip().decode(errors="replace")
            if text:
                some.append(text)
            if len(some) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["record"])
                some = []
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["record"])


def read_frames(spark: SparkSession, path: str, *, task_bytes: int = TASK_BYTES) -> DataFrame:
    """`record` of a dump, by as many tasks as its frames fill."""
    spark.dataSource.register(FrameReader)
    return spark.read.format("zstd_frames").option("path", path).option("bytes", task_bytes).load()


def write_frames(records: DataFrame, out: str | None = None, *, frame_records: int = FRAME_RECORDS) -> str:
    """Writes `records` (record) as .zst files of many frames, one for each task, to a folder that driver
    and executors share (by default a new one in spark.checkpoint.dir), which is returned. A file has its name once it is whole."""
    out = (out or f"{shared_dir(records.sparkSession)}/frames-{uuid.uuid4().hex}").removeprefix("file://")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        os.makedirs(out, exist_ok=True)
        part, n = TaskContext.get().partitionId(), 0
        aside = f"{out}/.{part}-{uuid.uuid4().hex}"
        with open(aside, "wb") as f:
            some: list[str] = []
            for batch in batches:
                some += [r for r in batch.column(0).to_pylist() if r]
                while len(some) >= frame_records:
                    f.write(zstandard.ZstdCompressor().compress(("\n\n".join(some[:frame_records]) + "\n\n").encode()))
                    some, n = some[frame_records:], n + frame_records
            if some:
                f.write(zstandard.ZstdCompressor().compress(("\n\n".join(some) + "\n\n").encode()))
                n += len(some)
        os.replace(aside, f"{out}/part-{part:06d}.pgn.zst")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    records.select("record").mapInArrow(write, "n bigint").agg({"n": "sum"}).collect()
    return out
