"""Toxicity through a noisy channel: words that were disguised are restored, then scored.

Disguises are figures, marks and look-alikes in place of letters, letters held
down or with accents, letters with spaces or marks between them, and a space
within a word. A disguised word becomes a lattice: at each place the letters it
may stand for, each at the channel's cost. A character trigram model, counted over
all texts, weighs the paths; Viterbi search keeps the best few for each state (the
trigram's last two characters), so none of the likeliest readings is lost. Only
lattices that hold one of the model's terms are decoded: a walk of all terms at
once through the lattice tells, and leaves out none that decoding could find. The
restored text is scored by a logistic model over the terms (words, and how long
words begin) that mark toxic documents among the labelled ones.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import charlm
from .base import binary, keep_rows, label_sample, stage

#: Labelled rows that training reads at most, and terms of the model at most.
TRAIN_ROWS, TERMS = 8192, 1024
#: Restored words of a disguised one, terms a worker remembers.
RESTORED, KEPT = 3, 200_000
#: States of the narrow search whose readings bound the exact one.
BEAM = 8
CUT = 0.7
#: Letters of a longer word's beginning that are a term by themselves.
BEGINS = (4, 5, 6, 7)

#: What a figure or mark may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "tl", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "*": "aeioubcdfghjklmnpqrstvwxyz",
}
#: Letters of other alphabets that look like Latin ones.
LOOKS_LIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
}
#: Characters that aren't seen.
UNSEEN = dict.fromkeys(map(ord, "\u00ad\u200b\u200c\u200d\u2060\ufeff"))
#: log2 costs of the channel: a letter as it is, one disguised, one held down, a consonant behind a star besides, a space within a word.
PLAIN, DISGUISED, HELD, CONSONANT, PARTED = 0.0, -2.0, -1.0, -2.0, -6.0
#: Letters of a term that may hold a space, at least.
PARTED_LETTERS = 5

_WORD = re.compile(r"[^\W_]{3,}")
_ONE = rb"(?:[!-~]|[\xc2-\xf4][\x80-\xbf]+)"
_GAP = rb"(?:[ \t-\r]|\xc2\xa0|\xe2\x80[\x80-\x8b\xaf]|\xe3\x80\x80)+"
_RUN = re.compile(rb"(?<![^ \t-\r])" + _ONE + rb"(?:" + _GAP + _ONE + rb"){2,}(?![^ \t-\r])")
_GAPS = re.compile(_GAP)
_HELD = re.compile(r"(.)\1")
_SAME = re.compile(r"(.)\1*", re.DOTALL)
#: One mark between all letters, or some marks between letters.
_PARTED = re.compile(r"\S([^\w\s]|_)\S(?:\1\S)+")
_MARKS = re.compile(r"(?:[^\w\s]|_)+")
_EDGES = ".,;:?\"'()[]{}<>-_~`"


@lru_cache(maxsize=65536)
def stands_for(c: str) -> tuple[tuple[str, float], ...]:
    """What a character may stand for, each at its cost: a figure or mark for letters, a
    letter with an accent or of another alphabet for itself or a Latin one, another for itself."""
    if c in STANDS_FOR:
        return tuple((x, DISGUISED + (CONSONANT if c == "*" and x not in "aeiou" else 0)) for x in STANDS_FOR[c])
    plain = ((c, PLAIN),)
    if c.isascii():
        return plain
    base = LOOKS_LIKE.get(c) or unicodedata.normalize("NFKD", c)[0].lower()
    return (*plain, (base, DISGUISED)) if base != c and base.isascii() and base.isalpha() else plain


@lru_cache(maxsize=65536)
def _folded(text: str) -> tuple[int, ...]:
    return tuple(int(charlm.FOLDED[b]) for b in text.encode())


#: For each state, its likeliest paths: text and weight.
Paths = dict[int, dict[str, float]]


def restore(word: str, model: charlm.Model, *, best: int = RESTORED) -> list[str]:
    """The likeliest readings of a lower-case word, best first: exactly those, as
    what follows depends on a path's state only. A run of one figure or mark is one
    symbol held down, or as many independent ones."""
    return [t for t, _ in exact(word, model, best, few(word, model, best))]


def few(word: str, model: charlm.Model, best: int = RESTORED) -> list[tuple[str, float]]:
    """Readings and weights by a narrow search: no likelier than the likeliest."""
    return _readings(word, model, best, BEAM, -np.inf)


def exact(word: str, model: charlm.Model, best: int, known: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """The likeliest readings. Weights only fall along a path, so one below the last of enough `known` readings is given up."""
    return _readings(word, model, best, None, known[best - 1][1] - 1e-9 if len(known) >= best else -np.inf)


def _readings(word: str, model: charlm.Model, best: int, width: int | None, floor: float) -> list[tuple[str, float]]:
    paths: Paths = {0: {"": 0.0}}
    for m in _SAME.finditer(word):
        c, n = m[1], len(m[0])
        steps = dict(stands_for(c))
        held = {x * t: cost * t + HELD for x, cost in steps.items() for t in (1, 2) if t < n}
        if c not in STANDS_FOR and n > 2:
            paths = _merged([_grown(paths, held, model, floor)], best, width)
            continue
        apart = paths
        for _ in range(n):
            apart = _merged([_grown(apart, steps, model, floor)], best, width)
        paths = _merged([apart, _grown(paths, held, model, floor)], best, width) if held else apart
    sure: dict[str, float] = {}
    for state, some in paths.items():
        last = model.costs[state << 6]
        for t, p in some.items():
            sure[t] = max(p + last, sure.get(t, -np.inf))
    return sorted(sure.items(), key=lambda x: (-x[1], x[0]))[:best]


def _grown(paths: Paths, steps: dict[str, float], model: charlm.Model, floor: float) -> Paths:
    """The paths after one of `steps` each."""
    last, table = charlm.CLASSES ** (model.order - 1) - 1, model.costs
    out: Paths = {}
    folded = [(x, cost, _folded(x)) for x, cost in steps.items()]
    for state, some in paths.items():
        highest = max(some.values())
        for x, cost, symbols in folded:
            at, weight = state, cost
            for f in symbols:
                key = at << 6 | f
                weight += table[key]
                at = key & last
            if highest + weight < floor:
                continue
            known = out.setdefault(at, {})
            for t, p in some.items():
                if p + weight >= floor and p + weight > known.get(t + x, -np.inf):
                    known[t + x] = p + weight
    return out


def _merged(sides: list[Paths], best: int, width: int | None) -> Paths:
    """The `best` paths of each state, of the `width` best states if that is given."""
    out = sides[0]
    for side in sides[1:]:
        for state, some in side.items():
            known = out.setdefault(state, {})
            for t, p in some.items():
                if p > known.get(t, -np.inf):
                    known[t] = p
    if width is not None and len(out) > width:
        out = dict(sorted(out.items(), key=lambda x: -max(x[1].values(), default=-np.inf))[:width])
    return {state: some if len(some) <= best else dict(sorted(some.items(), key=lambda x: (-x[1], x[0]))[:best]) for state, some in out.items() if some}


def joined(text: str) -> str:
    """`text` without the marks between its single letters, or as it is."""
    if _PARTED.fullmatch(text):
        return text[::2]
    parts = [x for x in _MARKS.split(text) if x]
    return "".join(parts) if len(parts) >= 3 and all(len(x) == 1 for x in parts) else text


class Trie:
    """Terms as a tree of letters; which of them a lattice may hold is told by walking both at once."""

    def __init__(self, terms: Iterable[str]):
        self.root: dict = {}
        for t in terms:
            node = self.root
            for c in t.removesuffix("~"):
                node = node.setdefault(c, {})
            node["begun" if t.endswith("~") else "ended"] = True

    def weight(self, word: str, model: charlm.Model) -> float:
        """The weight of the likeliest reading of `word` that is a term, or of a
        likeliest beginning that is one (no less than the whole reading's); minus infinity without any."""
        last, table = charlm.CLASSES ** (model.order - 1) - 1, model.costs
        found = -np.inf

        def step(nodes: list[tuple[dict, int, float]], steps: Iterable[tuple[str, float]]) -> list[tuple[dict, int, float]]:
            nonlocal found
            out = []
            for node, state, weight in nodes:
                for x, cost in steps:
                    at, key, w = node, state, weight + cost
                    for c in x:
                        at = at.get(c)
                        if at is None:
                            break
                        for f in _folded(c):
                            key = (key & last) << 6 | f
                            w += table[key]
                        if "begun" in at and w > found:
                            found = w
                    else:
                        out.append((at, key & last, w))
            return out

        nodes = [(self.root, 0, 0.0)]
        for m in _SAME.finditer(word):
            c, n = m[1], len(m[0])
            steps, out, apart = stands_for(c), [], nodes
            if c in STANDS_FOR or n <= 2:
                for _ in range(n):
                    apart = step(apart, steps)
                out = apart
            if n > 1:
                out = out + step(nodes, [(x * t, cost * t + HELD) for x, cost in steps for t in (1, 2) if t < n])
            if not out:
                return found
            nodes = out
        return max([found, *(w + table[state << 6] for node, state, w in nodes if "ended" in node)])

    def anywhere(self, word: str) -> bool:
        """Whether some reading of `word` holds a term."""
        heads = [self.root]
        for m in _SAME.finditer(word):
            c, n = m[1], len(m[0])
            steps, out = stands_for(c), []
            for nodes in [heads] * min(n, 2):  # once, or twice and more
                for _ in range(n if c in STANDS_FOR else min(n, 2)):
                    nodes = [x[s] for x in nodes for s, _ in steps if s in x]
                    out += nodes
                    nodes = [*nodes, self.root]
            if any("ended" in x or "begun" in x for x in out):
                return True
            heads = [*out, self.root]
        return False


@dataclass
class Reader:
    """Finds the terms of texts; remembers words that it has read."""

    model: charlm.Model
    terms: dict[str, int] | None = None  # without: all terms
    known: dict[bytes, tuple] = field(default_factory=dict)

    def __post_init__(self):
        keys = np.arange(charlm.CLASSES**self.model.order, dtype=np.uint32)
        self.model.table = self.model.score(keys)
        self.model.costs = self.model.table.tolist()
        self.whole = sorted((t for t in self.terms if "~" not in t and len(t) >= 4), key=len) if self.terms is not None else []
        self.trie = Trie(self.terms) if self.terms is not None else None
        self.heads = {t[:3] for t in self.terms or ()}
        parted = (t.encode() for t in self.whole if len(t) >= PARTED_LETTERS)
        self.parted = {(t[:i], t[i:]): t.decode() for t in parted for i in range(1, len(t)) if self._parted(t[:i], t[i:])}

    def _weight(self, word: bytes) -> float:
        """log2 probability of a word and the space after it."""
        key, out = 0, 0.0
        for b in word + b" ":
            key = (key << 6 | int(charlm.FOLDED[b])) & (charlm.CLASSES**self.model.order - 1)
            out += self.model.costs[key]
        return out

    def _parted(self, head: bytes, tail: bytes) -> bool:
        """Whether two words are likelier one with a space in it."""
        return self._weight(head + tail) + PARTED > self._weight(head) + self._weight(tail)

    def _of(self, word: str) -> list[str]:
        return [word, *(f"{word[:n]}~" for n in BEGINS if len(word) > n)] if len(word) >= 3 else []

    def _kept(self, found: list[str]) -> tuple:
        return tuple(found) if self.terms is None else tuple(sorted({self.terms[t] for t in found if t in self.terms}))

    def _hopeless(self, word: str) -> bool:
        """Whether no term can be a reading: three plain letters, none held down, begin all readings alike."""
        head = word[:3]
        return self.trie is not None and len(head) == 3 and head.isascii() and head.isalpha() and head[0] != head[1] != head[2] and head not in self.heads

    def _restored(self, word: str) -> list[str]:
        """The likeliest readings, if a term may be among them."""
        if self.trie is None:
            return restore(word, self.model)
        if self._hopeless(word):
            return []
        weight = self.trie.weight(word, self.model)
        if weight == -np.inf:
            return []
        known = few(word, self.model)
        if len(known) == RESTORED and weight < known[-1][1] - 1e-9:
            return []
        return [t for t, _ in exact(word, self.model, RESTORED, known)]

    def word(self, raw: bytes) -> tuple:
        text = raw.decode(errors="replace").lower()
        if not text.isascii():
            text = text.translate(UNSEEN)
        shorn = text.strip(_EDGES)
        learning = self.terms is None  # which takes doubled letters as they are, and leaves marks behind a word out
        if shorn.isalpha():
            if self._hopeless(shorn):
                return ()
            found = self._of(shorn)
            if re.search(r"(.)\1\1", shorn) if learning else not shorn.isascii() or _HELD.search(shorn):
                found += [x for r in self._restored(shorn) for x in self._of(r)]
            return self._kept(found)
        plain = text.strip(_EDGES + "!*|+$@")
        found = self._of(plain) if plain.isalpha() else [x for w in _WORD.findall(text) for x in self._of(w)]
        letters = sum(c.isalpha() for c in shorn)
        bare, whole = re.sub(r"[.\-_~]", "", shorn), joined(shorn)
        disguised = whole != shorn or letters >= 1 and any(c in STANDS_FOR for c in shorn) or bool(_HELD.search(shorn)) or letters >= 3 and len(bare) < len(shorn) and not re.search(r"[^\W\d_]{3}", shorn)
        disguised = disguised or not learning and not shorn.isascii()
        if disguised and len(bare) >= 3 and not (learning and plain.isalpha()):
            for option in {whole} if whole != shorn else {bare, bare.rstrip("!*|+$@") or bare}:
                found += [x for r in self._restored(option) for x in self._of(r)]
        return self._kept(found)

    def run(self, raw: bytes) -> tuple:
        """A run of single letters: it may hide several words, so known words are looked for anywhere in it."""
        found, letters = [], joined(_GAPS.sub(b"", raw).decode(errors="replace").lower())
        for reading in restore(letters, self.model) if self.trie is None or self.trie.anywhere(letters) else ():
            found += self._of(reading) + [w for w in self.whole if w in reading]
        return self._kept(found)

    def read(self, text: bytes) -> set:
        if len(self.known) > KEPT:
            self.known.clear()
        known, found = self.known, set()
        words = set(text.split())
        for w in words.difference(known):
            known[w] = self.word(w)
        for w in words:
            if terms := known[w]:
                found.update(terms)
        for run in set(_RUN.findall(text)):
            found.update(self.run(run))
        if self.parted:
            in_order = text.lower().split()
            found.update(self.terms[self.parted[p]] for p in self.parted.keys() & set(zip(in_order, in_order[1:], strict=False)))
        return found


def _kin(text: bytes) -> int:
    """The least hash of two words in a row, which near copies mostly share."""
    import xxhash

    words = text.split()
    return min((xxhash.xxh3_64_intdigest(a + b" " + b) >> 1 for a, b in zip(words, [*words[1:], b""], strict=False)), default=0)


def _terms_of(texts: DataFrame, model: charlm.Model, terms: dict[str, int] | None) -> DataFrame:
    """(id, label, kin, terms) for rows (id, text, label): terms as text, or their numbers in `terms`."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((model, terms))
    inner = pa.string() if terms is None else pa.int32()
    readers: list[Reader] = []

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not readers:
            readers.append(Reader(*shared.value))
        for batch in batches:
            some = [t.as_py() for t in binary(batch.column(1))]
            found = [sorted(readers[0].read(t)) for t in some]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(map(_kin, some), pa.int64()), pa.array(found, pa.list_(inner))], ["id", "label", "kin", "terms"])

    kind = texts.schema[0].dataType.simpleString()
    return texts.select("id", "text", "label").mapInArrow(read, f"id {kind}, label int, kin bigint, terms array<{'string' if terms is None else 'int'}>")


def learn(docs: DataFrame, labels: DataFrame, model: charlm.Model, *, target: str = "toxic", max_rows: int = TRAIN_ROWS, max_terms: int = TERMS) -> tuple[dict[str, int], np.ndarray]:
    """Terms, and weights for them and at the end the constant. Reads at most
    `max_rows` labelled rows, of an id one; terms are those that are in toxic documents mostly,
    `max_terms` at most. Without labelled rows of both kinds the weights are such that all scores are the share of toxic ones."""
    some = label_sample(labels, target, max_rows)
    texts = docs.select(F.col("doc_id").alias("id"), "text").where(F.col("id").isNotNull())
    rows = texts.join(F.broadcast(some.withColumnRenamed("doc_id", "id")), "id")
    one = rows.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    rows = stage(one.select("id", "text", "label"), "toxic_train")
    truth = rows.groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in truth}
    toxic, clean = n.get(1, 0), sum(c for k, c in n.items() if k != 1)
    if not toxic or not clean:
        return {}, np.array([-6.0 if not toxic else 6.0])
    found = stage(_terms_of(rows, model, None), "toxic_terms")
    # Copies mustn't make terms of all their words: texts whose least pair of words is the same count once.
    is_toxic = F.col("label") == 1
    counted = found.select(F.explode("terms").alias("term"), "kin", is_toxic.alias("is")).groupBy("term", "kin").agg(F.max("is").cast("int").alias("is"), F.min("is").cast("int").alias("all"))
    counted = counted.groupBy("term").agg(F.sum("is").alias("t"), (F.sum("is") + F.sum(1 - F.col("all"))).alias("n"))
    share = F.col("t") / F.col("n")
    best = counted.where((F.col("t") >= max(3, toxic // 100)) & (share >= 0.6)).orderBy((F.col("t") * share * share).desc(), "term").limit(max_terms)
    terms = {r["term"]: i for i, r in enumerate(best.collect())}
    data = _terms_of(rows, model, terms).select("label", "terms").collect()  # `max_rows` at most
    alike = Counter((tuple(sorted(r["terms"])), r["label"] == 1) for r in data)  # most documents have no term at all
    x = np.zeros((len(alike), len(terms) + 1), np.float32)
    x[:, -1] = 1
    for k, (found, _) in enumerate(alike):
        x[k, list(found)] = 1
    y = np.array([is_toxic for _, is_toxic in alike], np.float32)
    share = np.array(list(alike.values()), np.float32) / len(data)
    w, mean, square = np.zeros(x.shape[1], np.float32), 0.0, 0.0
    w[-1] = -2
    for k in range(1, 801):  # Adam, weights of terms at 0 or above
        slope = x.T @ (share * (1 / (1 + np.exp(-x @ w)) - y)) + 1e-5 * np.append(w[:-1], 0)
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        w -= 0.05 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-7)
        w[:-1] = np.maximum(w[:-1], 0)
    return terms, w


@dataclass
class Scorer:
    """Scores of a batch's texts; made once for each worker."""

    model: charlm.Model
    terms: dict[str, int]
    weights: np.ndarray
    reader: Reader | None = None

    def __call__(self, texts: pa.Array) -> np.ndarray:
        self.reader = self.reader or Reader(self.model, self.terms)
        found = (list(self.reader.read(t.as_py())) for t in binary(texts))
        return np.array([1 / (1 + np.exp(-(float(self.weights[t].sum()) + float(self.weights[-1])))) for t in found])


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = TRAIN_ROWS, max_terms: int = TERMS) -> Scorer:
    """Character model over all texts of `docs`, terms and weights over labelled rows that aren't held out."""
    model = charlm.fit(charlm.count(docs, "text", 3, charlm.FOLDED), 3)
    return Scorer(model, *learn(docs, labels, model, max_rows=max_rows, max_terms=max_terms))


def score_toxicity(docs: DataFrame, labels: DataFrame, *, cut: float = CUT, max_rows: int = TRAIN_ROWS, max_terms: int = TERMS) -> DataFrame:
    """A row for each row of `docs`: doc_id, score (0 to 1) and predicted (1 from `cut`).

    The character model is counted over all texts; labels are learnt from rows
    that aren't held out. Null and empty texts have no terms and get the lowest
    score; repeated rows and null ids stay; other columns aren't read; an empty table gives none. Texts are read twice and not shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_rows=max_rows, max_terms=max_terms))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, cut: float = CUT, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of `docs`, all columns, that `score_toxicity` doesn't predict toxic; decided where they lie."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_rows=max_rows))
    return keep_rows(docs, lambda batch, at: shared.value(batch.column(at("text"))) < cut)
