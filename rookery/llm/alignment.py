"""Two tokenizers' tokens of the same text, aligned by the bytes where they end.

A worker tokenises, in batches of texts. Words come again and again, so a text is cut
into pieces: one begins at a space or line feed that follows another kind of character,
and no token of either vocabulary crosses that place (which is checked as it is loaded).
Nor does one lead from a word's letters to the marks after it, so a piece of both is put
together from the two. Both tokens end where a piece does: a piece is tokenised and aligned
once (numpy and Arrow, many at a time), and its groups and links are those of every text
that has it. A worker remembers the pieces that come most often.

A row for each text leaves it, with its groups and links. The rest is Spark's: a link's
count over the corpus comes from grouping and is joined back.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import by_bytes, stage, values
from .tokens import _PLAIN

#: Bytes of text that are tokenised together, pieces that a worker remembers, distinct pairs of ids that go to all tasks.
RUN_BYTES, PIECES_KEPT, PAIRS = 1 << 20, 300_000, 1 << 20

#: Words that a tokenizer gets at once: what it says of each takes far more room than its ids.
AT_ONCE = 4096
#: Tokens of each vocabulary that a worker remembers, for each of PIECES_KEPT.
TOKENS_A_PIECE = 8

#: White space that another one follows: beyond such places pieces aren't told apart by bytes alone.
_IRREGULAR = re.compile(rb"(?:[\t-\r\x1c- ]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8b\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\xef\xbb\xbf)[\t-\r\x1c- ]")
#: White space of one byte; bytes that neither white space but space and line feed nor a longer form of it begins with.
_SPACES = (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")
_ORDINARY = bytes(sorted(set(range(256)) - {*b"\t\v\f\r\x1c\x1d\x1e\x1f", 0xC2, 0xE1, 0xE2, 0xE3, 0xEF}))
#: A place where a piece begins.
_BORDER = re.compile(r"(?<=[^\s\u180e\u200b\ufeff])(?=[ \n])")
_BLANK = "▁"
#: Marks that follow a word's letters, as in _PLAIN, and a letter that one of them follows.
_MARKS = b"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
_MARKED = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])[" + re.escape(_MARKS) + rb"]")


def byte_values() -> dict[str, int]:
    """What byte each character of a byte-level vocabulary stands for: printable ones for themselves, the others, in order, from 256 up."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Ids of space + text by a byte-level vocabulary (A), and of text by a piece vocabulary that adds that space (B)."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = byte_values()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.blank, lead = self.b.piece_to_id(_BLANK), self.b.piece_to_id(_BLANK + "a")
        with open(a_path) as f:
            step = json.load(f)["pre_tokenizer"]
        words = step["type"] == "ByteLevel" and step["use_regex"] and not step["add_prefix_space"]
        crossed = any(re.search(rf"[^ \n{_BLANK}][ \n{_BLANK}]", p) for p in pieces)
        begun = any(p.startswith((_BLANK + "\n", "\n")) for p in pieces)
        self.in_pieces = words and not crossed and not begun and self.blank > 0
        told = [i for i in range(len(pieces)) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.marks_apart = self.b.encode("a") == [lead] and not any(_MARKED.search(self.b_bytes[i]) for i in told)
        self._forget()

    def _forget(self) -> None:
        self.at: dict[bytes, int] = {}  # a piece's number
        self.marks: dict[bytes, int] = {}  # that of marks that follow letters
        self.keys: list[bytes | None] = []  # of all numbers, in order; marks have none
        self.ids_a, self.ids_b = (np.zeros(0, np.uint32) for _ in range(2))  # of all pieces, one after another
        self.links = np.zeros(0, np.int64)  # likewise: A id * 2^32 + B id of tokens that end together
        self.n_a, self.n_b, self.n_links, self.uses = (np.zeros(0, np.int64) for _ in range(4))
        self.groups = pa.array([], pa.string())  # a piece's groups, as in `aligned`
        self.sound = np.zeros(0, bool)  # whether the tokens' bytes are the piece's

    def _forget_rare(self) -> None:
        """Keeps the half that came most often."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: PIECES_KEPT // 2])
        kept = kept[[self.keys[i] is not None for i in kept.tolist()]]
        parts = [_of(kept, *x) for x in ((self.ids_a, self.n_a), (self.ids_b, self.n_b), (self.links, self.n_links))]
        each = [x[kept] for x in (self.n_a, self.n_b, self.n_links, self.uses // 2, self.sound)]
        groups, keys = self.groups.take(pa.array(kept)), [self.keys[i] for i in kept.tolist()]
        self._forget()
        if max(map(len, parts)) <= TOKENS_A_PIECE // 2 * PIECES_KEPT:
            (self.ids_a, self.ids_b, self.links), (self.n_a, self.n_b, self.n_links, self.uses, self.sound) = parts, each
            self.groups, self.keys, self.at = groups, keys, {k: i for i, k in enumerate(keys)}

    def _encode_a(self, words: list[bytes], joined: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each with its space, and how many each has. `joined`: many as one text, as no token crosses from word to word."""
        asked = [w.decode(errors="replace") for w in words]
        runs = [asked[k : k + AT_ONCE] for k in range(0, len(asked), AT_ONCE)]
        ids, n = _flat([e.ids for r in runs for e in self.a.encode_batch_fast(["".join(r)] if joined else r, add_special_tokens=False)])
        if joined:
            ends, wanted = np.cumsum(self.a_size[ids]), np.cumsum([len(w) for w in words])
            if not len(ends) or ends[-1] != wanted[-1]:  # a vocabulary that leaves something out
                return self._encode_a(words, False)
            n = np.diff(np.searchsorted(ends, wanted) + 1, prepend=0)
        return ids, n

    def _encode_b(self, words: list[str]) -> list[list[int]]:
        return [ids for k in range(0, len(words), AT_ONCE) for ids in self.b.encode(words[k : k + AT_ONCE], num_threads=1)]

    def cut(self, text: bytes) -> list[bytes]:
        """The pieces of space + text, without the space that most of them begin with."""
        pairs = text[:1] in _SPACES or b"  " in text or b" \n" in text or b"\n " in text or b"\n\n" in text
        if not pairs and not (text.translate(None, _ORDINARY) and _IRREGULAR.search(text)):
            return text.replace(b"\n", b" \n").split(b" ")
        whole = [p.encode() for p in _BORDER.split(" " + text.decode(errors="replace"))]
        return [p[1:] if p[:1] == b" " and p[1:2] not in _SPACES else p for p in whole]

    def learn(self, new: list[bytes]) -> None:
        """Both tokenizers' ids of new pieces, aligned."""
        words: dict[bytes, None] = {}  # for its order
        other, marked, roots, ends = [], [], [], []
        for p in new:
            root = p.rstrip(_MARKS)
            if not self.marks_apart or not (root.isalpha() or _PLAIN.fullmatch(root)):
                other.append(p)
                continue
            words[root] = None
            if len(root) < len(p):
                marked.append(p)
                roots.append(root)
                ends.append(p[len(root) :])
        fresh = [w for w in words if w not in self.at]
        if fresh:
            self._keep(fresh, [b" " + w for w in fresh], self._encode_a([b" " + w for w in fresh], True), _flat(self._encode_b([w.decode() for w in fresh])))
        marks = [m for m in dict.fromkeys(ends) if m not in self.marks]
        if marks:
            self.marks.update(zip(marks, range(len(self.keys), len(self.keys) + len(marks)), strict=True))
            after = [ids[1:] for ids in self._encode_b(["a" + m.decode() for m in marks])]
            self._keep([None] * len(marks), marks, self._encode_a(marks, False), _flat(after))
        if marked:
            self._join(marked, np.array([list(map(self.at.__getitem__, roots)), list(map(self.marks.__getitem__, ends))], np.int64).T)
        if other:
            self._learn_other(other)

    def _learn_other(self, new: list[bytes]) -> None:
        pieces = [p if p and p[:1] in _SPACES else b" " + p for p in new]
        # B puts a blank before what it gets: it stands for the piece's own space, or else it goes.
        lists = self._encode_b([(w[1:] if w[:1] == b" " else w).decode(errors="replace") for w in pieces])
        for k, (w, ids) in enumerate(zip(pieces, lists, strict=True)):
            if w[:1] != b" ":
                lists[k] = ids[1:] if ids[:1] == [self.blank] else [0]
            elif not ids:
                lists[k] = [self.blank]
        self._keep(new, pieces, self._encode_a(pieces, False), _flat(lists))

    def whole(self, texts: list[bytes]) -> None:
        """The same of texts that can't be cut: each is a piece."""
        pieces = [b" " + t for t in texts]
        self._keep(texts, pieces, self._encode_a(pieces, False), _flat(self._encode_b([t.decode(errors="replace") for t in texts])))

    def _keep(self, keys: list[bytes | None], pieces: list[bytes], found_a: tuple[np.ndarray, np.ndarray], found_b: tuple[np.ndarray, np.ndarray]) -> None:
        """Aligns pieces whose ids were found, and remembers them."""
        sizes, sound = np.array([len(w) for w in pieces], np.int64), np.ones(len(pieces), bool)
        for (ids, n), size, own in ((found_a, self.a_size, self.a_bytes), (found_b, self.b_size, self.b_bytes)):
            so_far = np.concatenate([[0], np.cumsum(size[ids])])
            if (so_far[np.cumsum(n)] != np.cumsum(sizes)).any() or b"".join(map(own.__getitem__, ids.tolist())) != b"".join(pieces):
                ends = np.cumsum(n).tolist()
                sound &= np.array([b"".join([own[i] for i in ids[e - c : e].tolist()]) == w for e, c, w in zip(ends, n.tolist(), pieces, strict=True)], bool)
        good = np.flatnonzero(sound)
        (a, n_a), (b, n_b) = ((_of(good, ids, n), n[good]) for ids, n in (found_a, found_b))
        links, n_links, groups = np.zeros(0, np.int64), np.zeros(len(pieces), np.int64), [""] * len(pieces)
        if len(good):
            common, at_a, at_b = np.intersect1d(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), assume_unique=True, return_indices=True)
            links = (a[at_a].astype(np.int64) << 32) | b[at_b]
            n_links[good] = np.diff(np.searchsorted(common, np.cumsum(sizes[good]), "right"), prepend=0)
            sides = [_joined(pa.array(ids).cast(pa.string()), at + 1, ",") for ids, at in ((a, at_a), (b, at_b))]
            groups = _joined(pc.binary_join_element_wise(*sides, "|"), np.cumsum(n_links), ";")
        self._add(keys, found_a, found_b, (links, n_links), groups, sound)

    def _join(self, keys: list[bytes], halves: np.ndarray) -> None:
        """Remembers pieces that are made of two known ones each."""
        both = halves.ravel()
        found = [(_of(both, *x), x[1][halves].sum(1)) for x in ((self.ids_a, self.n_a), (self.ids_b, self.n_b), (self.links, self.n_links))]
        self._add(keys, *found, pc.binary_join_element_wise(*(self.groups.take(pa.array(x)) for x in halves.T), ";"), self.sound[halves].all(1))

    def _add(self, keys: list[bytes | None], a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], links: tuple[np.ndarray, np.ndarray], groups: pa.Array | list[str], sound: np.ndarray) -> None:
        self.at.update((k, i) for i, k in enumerate(keys, len(self.keys)) if k is not None)
        self.keys += keys
        self.ids_a, self.ids_b, self.links = (np.concatenate([x, y]) for x, y in ((self.ids_a, a[0]), (self.ids_b, b[0]), (self.links, links[0])))
        self.n_a, self.n_b, self.n_links = (np.concatenate([x, y]) for x, y in ((self.n_a, a[1]), (self.n_b, b[1]), (self.n_links, links[1])))
        self.uses = np.concatenate([self.uses, np.zeros(len(keys), np.int64)])
        self.groups = pa.concat_arrays([self.groups, groups if isinstance(groups, pa.Array) else pa.array(groups, pa.string())])
        self.sound = np.concatenate([self.sound, sound])

    def numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts' pieces, and the text each belongs to; none of a text that's empty or whose bytes aren't the tokens'."""
        cuts = [(self.cut(t) if self.in_pieces else [t]) if t else [] for t in texts]
        every = list(chain.from_iterable(cuts))
        at = list(map(self.at.get, every))
        missing = [k for k, i in enumerate(at) if i is None]
        if missing:
            new = {every[k] for k in missing}
            if not self.in_pieces:
                self._forget()
                new, missing = set(every), range(len(every))
            elif len(self.keys) + len(new) > PIECES_KEPT or max(map(len, (self.ids_a, self.ids_b))) > TOKENS_A_PIECE * PIECES_KEPT:
                self._forget_rare()
                new, missing = set(every).difference(self.at), range(len(every))
            (self.learn if self.in_pieces else self.whole)(list(new))
            for k in missing:
                at[k] = self.at[every[k]]
        number, owner = np.array(at, np.int64), np.repeat(np.arange(len(texts)), [len(c) for c in cuts])
        self.uses += np.bincount(number, minlength=len(self.uses))
        kept = (np.bincount(owner[~self.sound[number]], minlength=len(texts)) == 0)[owner]
        return number[kept], owner[kept]

    def tokens(self, pieces: np.ndarray) -> list[np.ndarray]:
        """Of the pieces of these numbers, one after another: ids by A and where each ends, the same by B, and where each piece ends."""
        out: list[np.ndarray] = []
        for ids, n, size in ((self.ids_a, self.n_a, self.a_size), (self.ids_b, self.n_b, self.b_size)):
            found = _of(pieces, ids, n)
            out += [found, np.cumsum(size[found])]
        return [*out, out[1][np.cumsum(self.n_a[pieces]) - 1]]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of `lists`, and how many each has."""
    n = np.array([len(x) for x in lists], np.int64)
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(n.sum())), n


def _of(which: np.ndarray, values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The values of these owners, one after another, of `values` of which each owner has `n`."""
    own, first = n[which], (np.cumsum(n) - n)[which]
    return values[np.repeat(first - (np.cumsum(own) - own), own) + np.arange(own.sum())]


def _joined(texts: pa.Array, ends: np.ndarray, mark: str) -> pa.Array:
    """Texts in a row, joined up to each of `ends`."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), texts), mark)


@lru_cache(maxsize=1)
def pair(a_path: str, b_path: str) -> Pair:
    """One for each worker process."""
    return Pair(a_path, b_path)


def aligned(docs: DataFrame, a_path: str, b_path: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each text: doc_id, n_a, n_b, groups (a string: `a1,a2|b1;a3|b2,b3`) and links (of the A
    and the B token that end together: A id * 2^32 + B id). Texts without tokens have none of these."""
    kind = docs.select(id_column).schema[0].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = pair(a_path, b_path)
        for batch in batches:
            texts = list(values(batch.column(1)))
            for start, stop in by_bytes(texts, RUN_BYTES):
                number, owner = use.numbers(texts[start:stop])
                count = stop - start
                n_a, n_b, n_links = (np.bincount(owner, n[number], minlength=count).astype(np.int64) for n in (use.n_a, use.n_b, use.n_links))
                groups = _joined(use.groups.take(pa.array(number)), np.cumsum(np.bincount(owner, minlength=count)), ";")
                links = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_links)]), pa.int32()), pa.array(_of(number, use.links, use.n_links)))
                columns = [batch.column(0).slice(start, count), pa.array(n_a), pa.array(n_b), groups, links]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "groups", "links"])

    return docs.select(id_column, text_column).mapInArrow(read, f"doc_id {kind}, n_a bigint, n_b bigint, groups string, links array<bigint>")


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best) of `links` (pair: as in `aligned`): how often it comes, and whether no other A id comes more often with its B id."""
    counts = links.groupBy("pair").agg(F.count("*").alias("n"))
    b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, *, id_column: str = "doc_id", text_column: str = "text", pairs: int = PAIRS) -> DataFrame:
    """A row for each row of `docs`: doc_id, n_a and n_b (tokens of space + text by A, of text
    by B), n_groups, n_links, n_best, count_sum and groups_sha256.

    Byte offsets where tokens of both end cut them into groups; the A and the B token that
    end there are linked. A pair of ids counts as often as it is linked in the whole table
    (repeated rows each time); n_best are links than which their B id has no more frequent
    one, count_sum adds up the counts of links. Texts that are null or empty, or whose
    tokens' bytes aren't those of space + text, have no tokens: zeros, and '' for the hash.
    Ids may repeat or be null; other columns aren't read; an empty table gives none.

    Counts go to all tasks if there are `pairs` of them at most (they are counted); beyond,
    the most frequent `pairs` do, and links of others are joined by the pair, document by document."""
    made = aligned(docs, a_path, b_path, id_column=id_column, text_column=text_column)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    rows = stage(made.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", F.size("links").cast("bigint").alias("n_groups"), digest.alias("groups_sha256"), "links"), "aligned")
    each = rows.select("row", F.explode("links").alias("pair"))
    counts = stage(pair_counts(each), "pair_counts")
    if counts.count() <= pairs:
        told = each.join(F.broadcast(counts), "pair").select("row", F.col("best").cast("bigint").alias("best"), "n")
    else:
        least = counts.orderBy(F.col("n").desc(), "pair").limit(pairs + 1).agg(F.min("n")).first()[0]
        often = F.col("n") > least  # `pairs` at most
        near = each.join(F.broadcast(counts.where(often)), "pair", "left")
        near = near.select("row", "pair", F.col("best").cast("bigint").alias("best"), "n")
        rare = near.where("n is null").groupBy("row", "pair").agg(F.count("*").alias("times")).join(counts.where(~often), "pair")
        told = near.where("n is not null").select("row", "best", "n").unionByName(rare.select("row", (F.col("best").cast("bigint") * F.col("times")).alias("best"), (F.col("n") * F.col("times")).alias("n")))
    sums = told.groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    zero = F.lit(0).cast("bigint")
    return rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )
