import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rookery.llm import alignment

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
PARTS = [
    "a", "B", "é", "É", "ß", " ", "  ", "\n", "\n\n", "\x1c", "\x85", "\xa0", "'s", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "1", "!", "?.", ", ", ".\n", ";\r\n", "\r", "̌", "中", "🙂", "ﬁ", "the", "\t", "\x0b", "▁", "　", "​", "﻿", " word", "ing", "\x00",
    "\U0001d4b3", "'ll", "’", "don't", "    ",
]


def brute(rows):
    """Text by text, whole texts to the tokenizers, dictionaries of ends."""
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = alignment.byte_values()
    made, counts = [], collections.Counter()
    for i, text in rows:
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        own_a = [bytes(byte[c] for c in first.id_to_token(x)) for x in a]
        own_b = [bytes([int(second.id_to_piece(x)[3:5], 16)]) if second.is_byte(x) else second.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if text and (b"".join(own_a) != (" " + text).encode() or b"".join(own_b) != (" " + text).encode()):
            a, b, own_a, own_b = [], [], [], []
        ends = [{sum(map(len, own[: k + 1])): k for k in range(len(own))} for own in (own_a, own_b)]
        common = sorted(ends[0].keys() & ends[1].keys())
        links = [(a[ends[0][c]], b[ends[1][c]]) for c in common]
        counts.update(links)
        groups, p, q = [], -1, -1
        for c in common:
            groups.append(",".join(map(str, a[p + 1 : ends[0][c] + 1])) + "|" + ",".join(map(str, b[q + 1 : ends[1][c] + 1])))
            p, q = ends[0][c], ends[1][c]
        made.append((i, a, b, groups, links))
    best = collections.Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(i, len(a), len(b), len(g), len(n), sum(counts[p] == best[p[1]] for p in n), sum(counts[p] for p in n), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for i, a, b, g, n in made]


@pytest.mark.parametrize("pairs", [alignment.PAIRS, 20])
def test_as_brute_force(spark, pairs):
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 25)))) for i in range(600)]
    rows += [(None, "the word"), (None, "the word"), (7, "twice"), (7, "twice"), (9001, None), (9002, ""), (9003, " "), (9004, "\n"), (9005, "the the, long words.\nAnd lines " * 60)]
    docs = spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], "doc_id long, text string, row string, a_ids int, pair string")
    got = sorted(map(tuple, alignment.align(docs, A, B, pairs=pairs).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    assert alignment.align(docs.limit(0), A, B).count() == 0


def by_text(use, texts):
    number, owner = use.numbers(texts)
    out = []
    for k in range(len(texts)):
        a, a_ends, b, b_ends, ends = use.tokens(number[owner == k]) if (owner == k).any() else [[]] * 5
        assert not len(a) or a_ends[-1] == b_ends[-1] == ends[-1] == len(texts[k]) + 1
        out.append((list(a), list(a_ends), list(b), list(b_ends)))
    return out


def test_pieces_that_are_forgotten_and_whole_texts(monkeypatch):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))).encode() for _ in range(300)]
    use = alignment.Pair(A, B)
    assert use.in_pieces
    told = by_text(use, texts)
    monkeypatch.setattr(alignment, "PIECES_KEPT", 50)
    assert [by_text(use, [t])[0] for t in texts] == told
    use.in_pieces = False
    use._forget()
    assert [x for n in range(0, 300, 50) for x in by_text(use, texts[n : n + 50])] == told


def told(use, texts):
    """Of each text, as in `brute`: tokens by both, groups, links and the groups' hash."""
    number, owner = use.numbers([t.encode() for t in texts])
    out = []
    for k in range(len(texts)):
        own = number[owner == k]
        groups, n = ";".join(use.groups.take(own).to_pylist()), use.n_links[own].sum()
        out.append((use.n_a[own].sum(), use.n_b[own].sum(), n, n, hashlib.sha256(groups.encode()).hexdigest() if len(own) else ""))
    return out


def test_words_and_their_marks_are_tokenised_once(monkeypatch):
    rnd = random.Random(5)
    letters, marks = "abcdefgthinéÉßæøÀ", "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
    words = ["".join(rnd.choices(letters, k=rnd.randint(1, 12))) for _ in range(60)]
    texts = [" ".join(rnd.choice(words) + "".join(rnd.choices(marks, k=rnd.randint(0, 3))) for _ in range(20)) for _ in range(80)]
    use = alignment.Pair(A, B)
    assert use.marks_apart
    asked = collections.Counter()
    encode = use._encode_b
    monkeypatch.setattr(use, "_encode_b", lambda some: asked.update(some) or encode(some))
    got = [x for n in range(0, 80, 20) for x in told(use, texts[n : n + 20])]
    assert got == [(*r[1:5], r[7]) for r in brute(enumerate(texts))]
    assert set(asked.values()) == {1} and set(words) >= {w for w in asked if w[-1] not in marks}
    monkeypatch.setattr(use, "marks_apart", False)
    use._forget()
    assert told(use, texts) == got


def test_pieces_that_come_often_stay(monkeypatch):
    monkeypatch.setattr(alignment, "PIECES_KEPT", 50)
    use = alignment.Pair(A, B)
    asked = collections.Counter()
    learn = use.learn
    monkeypatch.setattr(use, "learn", lambda new: asked.update(new) or learn(new))
    rare = ["".join(chr(97 + int(d)) for d in str(n)) for n in range(1000, 1400)]
    texts = ["the word the word, " + " ".join(rare[n : n + 10]) for n in range(0, 400, 10)]
    got = [x for t in texts for x in told(use, [t])]
    assert got == [(*r[1:5], r[7]) for r in brute(enumerate(texts))]
    assert asked[b"the"] == asked[b"word"] == asked[b"word,"] == 1
    assert len(use.keys) <= 50


def test_a_vocabulary_that_leaves_bytes_out(monkeypatch):
    use = alignment.Pair(A, B)
    encode = use.a.encode_batch_fast

    class Left:
        """Says of what has a q but the first token."""

        def encode_batch_fast(self, some, **how):
            class Told:
                def __init__(self, text, ids):
                    self.ids = ids[:1] if "q" in text else ids

            return [Told(t, e.ids) for t, e in zip(some, encode(some, **how), strict=True)]

    monkeypatch.setattr(use, "a", Left())
    number, owner = use.numbers([b"plain words", b"quince trees", b"more"])
    assert sorted(set(owner.tolist())) == [0, 2]
