"""Licence notices in texts: exact phrases, and short notices with a few wrong letters.

Words are runs of digits, letters a-z (A-Z lowered) and characters beyond ASCII;
a text is searched as its words with single spaces between them. A notice that
may hold k errors is cut into k + 1 pieces: wherever it stands with k errors or
fewer, one piece at least stands exactly. An automaton finds the pieces of all
notices in one pass; around each, the regex library's bounded-error match
decides and tells the edits. A window is as long as the notice and its edits on
both sides, so the work grows with the number of pieces found, not with a text's length.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .base import binary

#: Phrases that must stand exactly, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Short notices that may hold errors: words, label. A notice may hold an edit for every LETTERS_AN_EDIT letters.
NOTICES = [
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("apache license", "apache"),
    ("apache license version 2 0", "apache"),
    ("mit license", "mit"),
    ("licensed under the apache license", "apache"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person", "mit"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("licensed under cc by", "cc-by"),
    ("creative commons attribution", "cc-by"),
    ("creative commons zero", "cc0"),
]
LETTERS_AN_EDIT = 10

_SPACED = bytes(i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
MATCH = "array<struct<label: string, notice: string, first_word: bigint, last_word: bigint, edits: int>>"


def _cut(notice: str, pieces: int) -> Iterator[tuple[int, str]]:
    """The notice in almost equal pieces, and where each starts."""
    at = [len(notice) * i // pieces for i in range(pieces + 1)]
    return ((a, notice[a:b]) for a, b in zip(at, at[1:], strict=False))


@lru_cache(maxsize=4)
def _searcher(notices: tuple[tuple[str, str], ...], letters_an_edit: int):
    """The automaton of all pieces, and for each notice its pattern and number of edits. Bytes beyond ASCII are read as Latin-1: an edit is one of a byte."""
    import ahocorasick
    import regex

    seeds: dict[str, list[tuple[int, int]]] = {}
    patterns = []
    for n, (notice, _) in enumerate(notices):
        edits = len(notice) // letters_an_edit
        for start, piece in _cut(notice, edits + 1):
            seeds.setdefault(piece, []).append((n, start))
        patterns.append((regex.compile(rf"(?e)(?<![^ ])(?:{regex.escape(notice, special_only=True, literal_spaces=True)}){{e<={edits}}}(?![^ ])"), edits))
    automaton = ahocorasick.Automaton()
    for piece, where in seeds.items():
        automaton.add_word(piece, (len(piece), where))
    automaton.make_automaton()
    return automaton, patterns


def scan(text: bytes, phrases: dict[str, str], notices: tuple[tuple[str, str], ...], letters_an_edit: int) -> tuple[int, list, list]:
    """n_words; exact places and matches with errors, each as (label, notice, first word, last word, edits)."""
    words = text.lower().translate(_SPACED).split()
    joined = " " + b" ".join(words).decode("latin-1") + " "
    starts = list(accumulate((len(w) + 1 for w in words), initial=1))  # of each word in `joined`
    exact = []
    for phrase, label in phrases.items():
        at, last = joined.find(f" {phrase} "), phrase.count(" ")
        while at >= 0:
            word = bisect_left(starts, at + 1)
            exact.append((label, phrase, word, word + last, 0))
            at = joined.find(f" {phrase} ", at + 1)
    automaton, patterns = _searcher(notices, letters_an_edit)
    windows = {(n, end + 1 - length - start) for end, (length, where) in automaton.iter(joined) for n, start in where}
    found: dict[int, set[tuple[int, int, int]]] = {}
    for n, low in windows:
        pattern, edits = patterns[n]
        for m in pattern.finditer(joined, max(0, low - 2 * edits - 1), min(len(joined), low + len(notices[n][0]) + 2 * edits + 1)):
            start, stop = m.span()
            if inside := joined[start:stop].strip():
                first = bisect_left(starts, start)
                found.setdefault(n, set()).add((first, first + inside.count(" "), sum(m.fuzzy_counts)))
    return len(words), exact, sorted((notices[n][1], notices[n][0], *span) for n, spans in found.items() for span in _apart(spans))


def _apart(spans: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of spans (first, last, edits) that overlap those with the fewest edits, the first of equals."""
    kept: list[tuple[int, int, int]] = []
    for span in sorted(spans):
        if kept and span[0] <= kept[-1][1]:
            if span[2] < kept[-1][2]:
                kept[-1] = span
        else:
            kept.append(span)
    return kept


def scan_licenses(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", phrases: dict[str, str] | None = None, notices: list[tuple[str, str]] | None = None, letters_an_edit: int = LETTERS_AN_EDIT) -> DataFrame:
    """A row for each row of `docs`: its id, n_words, n_base (places of exact
    phrases), first_word and last_word (their smallest and largest start, else
    null), base_labels and labels (distinct, sorted, joined by commas; labels holds
    those of notices with errors too), score (1 for an exact phrase, else 1 -
    edits / length of the best match, 0 without one) and matches (all spans, in words).

    Null texts are empty: no words, empty labels, score 0. Repeated rows and null
    ids stay, other columns aren't read, an empty table gives none. One pass, no shuffle."""
    phrases = PHRASES if phrases is None else phrases
    notices = tuple(NOTICES if notices is None else notices)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")}
            for text in binary(batch.column(1)):
                n, exact, near = scan(text.as_py(), phrases, notices, letters_an_edit)
                starts = [m[2] for m in exact]
                base = {m[0] for m in exact}
                best = max([1.0 * bool(exact), *(1 - m[4] / len(m[1]) for m in near)])
                for column, value in zip(rows.values(), (n, len(exact), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {m[0] for m in near})), best, [dict(zip(("label", "notice", "first_word", "last_word", "edits"), m, strict=True)) for m in exact + near]), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True))], ["id", *rows])

    span = pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())])
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
    kind = docs.select(id_column).schema[0].dataType.simpleString()
    schema = f"id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, matches {MATCH}"
    return docs.select(id_column, text_column).mapInArrow(found, schema).withColumnRenamed("id", id_column)
