"""Token counts and ids of whole texts, by a public tokenizer.

Text goes to the tokenizer in Arrow batches, cut into runs of about equal bytes;
a long text is cut at white space. For a vocabulary that drops white space (every
word is encoded by itself) white space is a safe boundary: the ids of a text are
those of its words, one after another. So a word that comes again need not be
encoded again, and what is left for the tokenizer is each new word of a worker.
Other vocabularies get whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .base import binary, by_bytes, values

#: Bytes of text that are encoded together, and words that a worker remembers.
RUN_BYTES = 1 << 20
WORDS_KEPT = 500_000

#: A letter that neither case folding nor normalisation changes but by lowering it (ASCII and Latin-1).
_LETTER = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"
#: A word of such letters, then ASCII marks: two tokens' runs for the tokenizer, letters and marks.
_PLAIN = re.compile(rb"(" + _LETTER + rb"+)([!\"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]*)")
#: A full stop or comma at a word's end that belongs to a longer run of marks.
_IN_RUN = re.compile(rb"(?<![A-Za-z0-9])(?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])[.,](?=[ \n])")


def split_words(text: bytes) -> list[bytes]:
    """Words whose ids, one after another, are those of the text. Where that
    changes no id, case is folded and marks stand alone, so that fewer words differ:
    not with combining marks or control strings in the text."""
    if b"<|" in text or b"\xcc" in text or b"\xcd" in text or _IN_RUN.search(text):
        return text.split()
    return text.lower().replace(b". ", b" . ").replace(b", ", b" , ").replace(b".\n", b" .\n").replace(b",\n", b" ,\n").split()


class WordEncoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_roots(self, roots: list[bytes]) -> None:
        """Encodes plain lower-case words, many as one text: each ends with a token that ends a word."""
        for i in range(0, len(roots), 4096):
            some = roots[i : i + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("the tokenizer doesn't end each word with a token of its own")
            data, at = ids.tobytes(), (ends * 4).tolist()
            self.words.update(zip(some, (data[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)), strict=True))

    def learn(self, new: set[bytes]) -> None:
        lower = {w for w in new if w.isalpha() and w.islower()}  # ASCII letters only
        plain, other = [], []
        for w in new - lower:
            if m := _PLAIN.fullmatch(w):
                root, marks = m.groups()
                plain.append((w, root.lower() if root.isascii() else root.decode().lower().encode(), marks))
            else:
                other.append(w)
        self._learn_roots(list(lower.union(r for _, r, _ in plain).difference(self.words)))
        marks = list({m for _, _, m in plain}.difference(self.words, [b""]))
        self.words.update(zip(marks, self._encode([m.decode() for m in marks]), strict=True))
        self.words.update((w, self.words[r] + (self.words[m] if m else b"")) for w, r, m in plain)
        self.words.update(zip(other, self._encode([w.decode(errors="replace") for w in other]), strict=True))

    def ids(self, texts: list[bytes]) -> list[bytes]:
        words = [split_words(t) for t in texts]
        known = self.words
        new = set(chain.from_iterable(words)).difference(known)
        if len(known) + len(new) > WORDS_KEPT:
            known.clear()
            new = set(chain.from_iterable(words))
        if new:
            self.learn(new)
        return [b"".join(map(known.__getitem__, ws)) for ws in words]


class TextEncoder:
    """The same for vocabularies in which white space counts: whole texts."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            model = Tokenizer.from_file(path)
            self.encode = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(ids, "<u4").tobytes() for ids in self.encode([t.decode(errors="replace") for t in texts])]


def _drops_white_space(path: str) -> bool:
    if not path.endswith(".json"):
        return False
    with open(path) as f:
        steps = json.load(f)
    split = [s for s in (steps.get("pre_tokenizer") or {}).get("pretokenizers", []) if s["type"] == "Split"]
    marked = (steps["model"].get("end_of_word_suffix") or "") == "</w>"
    return marked and bool(split) and split[0]["behavior"] == "Removed" and split[0]["invert"] and r"[^\s" in split[0]["pattern"].get("Regex", "")


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder | TextEncoder:
    """One for each worker process and vocabulary."""
    return WordEncoder(path) if _drops_white_space(path) else TextEncoder(path)


def parts(text: bytes, limit: int = RUN_BYTES) -> list[bytes]:
    """A long text in parts of about `limit` bytes, each ending before ASCII white space."""
    if len(text) <= limit:
        return [text]
    out, start = [], 0
    space = re.compile(rb"[ \t-\r]")
    while len(text) - start > limit and (m := space.search(text, start + limit)):
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


def encoded(texts: Iterable[bytes], path: str) -> Iterator[bytes]:
    """The ids of each text, in runs balanced by bytes."""
    use = encoder(path)
    run: list[list[bytes]] = []
    size = 0

    def flush() -> Iterator[bytes]:
        pieces = [p for cut in run for p in cut]
        ids = (x for a, b in by_bytes(pieces, RUN_BYTES) for x in use.ids(pieces[a:b]))
        for cut in run:
            yield next(ids) if len(cut) == 1 else b"".join(islice(ids, len(cut)))

    for text in texts:
        run.append(parts(text) if isinstance(use, WordEncoder) else [text])
        size += len(text) + 64
        if size >= RUN_BYTES:
            yield from flush()
            run, size = [], 0
    yield from flush()


def count_tokens(docs: DataFrame, path: str, *, id_column: str = "doc_id", text_column: str = "text", limit: int = 2048) -> DataFrame:
    """A row for each row of `docs`: its id, n_bytes (UTF-8), n_tokens without
    added special tokens, and over_limit (n_tokens > `limit`).

    Null and empty texts count 0 and 0. Repeated rows and ids stay as they are, a
    null id stays null, other columns aren't read, an empty table gives none.
    Only lengths leave the Python worker. One pass, no shuffle."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array([len(x) // 4 for x in encoded(values(batch.column(1)), path)], pa.int64())
            sizes = pc.cast(pc.binary_length(binary(batch.column(1))), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, n, pc.greater(n, limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.select(id_column).schema[0].dataType.simpleString()
    found = docs.select(id_column, text_column).mapInArrow(lengths, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return found.withColumnRenamed("id", id_column)
