r"""Chat formatting: every assistant turn becomes an example of its own.

A turn is written as

    <|im_start|>role
    text<|im_end|>

An example holds all turns up to an assistant's, in order; of it only that reply's
text is trained on (loss_start, loss_chars). In role and text a backslash is
doubled and `<|` is written `<\|`, and in a role a line feed is written `\n`, so
no text can end or begin a turn, and reading back gives what was there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END), re.DOTALL)

#: Characters of examples that leave the worker together.
BATCH_CHARS = 4_000_000


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def format_examples(turns: DataFrame, *, trained_role: str = "assistant") -> DataFrame:
    """Rows conv_id, example (from 0), target_turn (place of the last turn, from 0),
    trainable, text, loss_start, loss_chars: one for each turn of `trained_role`,
    with all turns before it as context. If a conversation goes on after its last
    such turn, or has none, one more row holds it whole, with nothing to train on,
    so that no turn is lost.

    `turns` has conv_id, turn, role, text; null roles and texts are empty, rows
    with a null conv_id are one conversation, turns go by number (null last), ties
    by role and text, and repeated rows are turns of their own. Other columns
    aren't read; an empty table gives none.

    A conversation's turns are shuffled once, sorted on disk if need be, and read
    as a stream: a worker holds one conversation's text so far, never its examples
    together. The examples of a conversation come together and in order."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        conv, seen, example, turn, so_far, tail = None, False, 0, 0, "", False
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not seen or row[0] != conv:
                    if tail:
                        out.append((conv, example, turn - 1, False, so_far, 0, 0))
                    conv, seen, example, turn, so_far, tail = row[0], True, 0, 0, "", False
                head, body = f"{START}{escape(row[1]).replace('\n', '\\n')}\n", escape(row[2])
                before = len(so_far) + len(head)
                so_far = "".join((so_far, head, body, END))
                tail = row[1] != trained_role
                if not tail:
                    out.append((conv, example, turn, True, so_far, before, len(body)))
                    size += len(so_far)
                    example += 1
                turn += 1
                if size > BATCH_CHARS:
                    yield _rows(out, batch.schema[0].type)
                    out, size = [], 0
        if tail:
            out.append((conv, example, turn - 1, False, so_far, 0, 0))
        if out:
            yield _rows(out, batch.schema[0].type)

    kind = turns.select("conv_id").schema[0].dataType.simpleString()
    rows = turns.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    return placed.select("conv_id", "role", "text").mapInArrow(expand, f"conv_id {kind}, example bigint, target_turn bigint, trainable boolean, text string, loss_start bigint, loss_chars bigint")


def _rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64()]
    names = ["conv_id", "example", "target_turn", "trainable", "text", "loss_start", "loss_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_back(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(text)]


def digests(examples: DataFrame) -> DataFrame:
    """A row for each conversation of `format_examples`, read from the formatted
    text alone: conv_id, n_turns, turns_sha256 (of role, line feed, text, line feed
    for each turn), loss_chars and loss_sha256 (of all trained text, unescaped) and
    formatted_chars (of all its examples). Takes the examples as that operator
    leaves them, a conversation's together and in order; no shuffle."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, last, loss, n_loss, n_chars = None, False, "", hashlib.sha256(), 0, 0
        done: list[tuple] = []

        def close() -> None:
            turns, whole = read_back(last), hashlib.sha256()
            for role, text in turns:
                whole.update(f"{role}\n{text}\n".encode())
            done.append((now, len(turns), whole.hexdigest(), n_loss, loss.hexdigest(), n_chars))

        def take() -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            kind = batch.schema[0].type
            for conv, text, start, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if seen and conv != now:
                    close()
                    loss, n_loss, n_chars = hashlib.sha256(), 0, 0
                now, seen, last = conv, True, text
                trained = unescape(text[start : start + chars])
                loss.update(trained.encode())
                n_loss += len(trained)
                n_chars += len(text)
            if done:
                yield take()
                done.clear()
        if seen:
            close()
            yield take()

    kind = examples.select("conv_id").schema[0].dataType.simpleString()
    return examples.select("conv_id", "text", "loss_start", "loss_chars").mapInArrow(read, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
