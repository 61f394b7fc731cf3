import re
from collections import Counter

import numpy as np
import pyarrow as pa

from rookery.llm import charlm, kneser_ney
from rookery.llm.quality_rules import apply_rules, repeated

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_counts_as_brute_force(spark):
    rnd = np.random.default_rng(1)
    texts = ["", None, "   \n \t", "a b\na b\n\nc\xa0d é\x0b|$", "x " * 40, " ".join("abcdefgh") + " y " + " ".join("abcdefgh") + " z"]
    texts += [" ".join(rnd.choice(["a", "bé", "c|", "d\n", "e"], rnd.integers(0, 60))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "en" if i % 3 else None, "clash") for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept string")
    got = {r.doc_id: r for r in apply_rules(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        n = brute(t or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and not (r.base_failed and r.kept)
    assert got[0].perplexity is None
    assert apply_rules(docs.limit(0)).count() == 0


def test_repeats_do_not_cross_texts():
    words = [b"a b c d e f g h".split(), b"a b c d e f g h".split()]
    assert repeated(words).tolist() == [0, 0] and repeated([]).tolist() == []


def test_the_model_is_a_distribution(spark):
    docs = spark.createDataFrame([("the cat sat on the mat",), ("a dog ate the cat",), (None,)], "text string")
    counts = charlm.count(docs, "text", 3, charlm.FOLDED)
    keys, _ = charlm.keys_of(pa.array([b"the cat sat on the mat", b"a dog ate the cat"]), 3, charlm.FOLDED)
    assert {r.key: r.n for r in counts.collect()} == dict(Counter(keys.tolist()))
    m = charlm.fit(counts, 3)
    everything = np.arange(64**3, dtype=np.uint32)
    assert np.allclose((2.0 ** m.score(everything).astype(float)).reshape(-1, 64).sum(axis=1), 1, atol=1e-4)


def test_odd_texts_leave_the_band(spark):
    rnd = np.random.default_rng(2)
    vocabulary = ["the", "river", "garden", "window", "letter", "morning", "stone", "walked", "quiet", "under"]
    plain = [(i, " ".join(rnd.choice(vocabulary, 60)), "en") for i in range(300)]
    odd = [(1000, " ".join("".join(rnd.choice(list("qxzjkvw%#0123456789"), 6)) for _ in range(60)), "en")]
    kept = {r.doc_id: r.kept for r in apply_rules(spark.createDataFrame(plain + odd, "doc_id long, text string, lang string")).collect()}
    assert not kept[1000] and np.mean([kept[i] for i in range(300)]) > 0.99


def brute_kneser_ney(texts):
    """Bits of each n-gram of five code points, by dictionaries."""
    order, counts = 5, {5: Counter()}
    for t in texts:
        padded = " " * 4 + t
        counts[5].update(padded[i : i + 5] for i in range(len(t)))
    for k in (4, 3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    p = {"": 1 / len(counts[1])}
    for k in range(1, order + 1):
        some = counts[k]
        d = kneser_ney.discounts([sum(c == i for c in some.values()) for i in (1, 2, 3, 4)])
        total, left = Counter(), Counter()
        for g, c in some.items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3) - 1]
        p = {g: (c - d[min(c, 3) - 1]) / total[g[:-1]] + left[g[:-1]] / total[g[:-1]] * p[g[1:]] for g, c in some.items()}
    return {g: -np.log2(x) for g, x in p.items()}


def test_perplexity_as_brute_force_both_ways(spark):
    rnd = np.random.default_rng(5)
    words = ["река", "тихо", "сад", "语言", "模型", "la", "niña", "über", "the", "x😀y", "\n", "a"]
    texts = [" ".join(rnd.choice(words, int(rnd.integers(0, 50)))) for _ in range(80)] + ["", None, " ", "я" * 3000]
    bits = brute_kneser_ney([t or "" for t in texts])
    docs = spark.createDataFrame([(i, t, ["ru", "zh", None, ""][i % 4]) for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    for most in (kneser_ney.BROADCAST_ROWS, 0):
        got = {r.doc_id: r for r in apply_rules(docs, broadcast_rows=most).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            n = len(WORD.findall(t or ""))
            if not n:
                assert got[i].perplexity is None
                continue
            padded = " " * 4 + t
            want = sum(bits[padded[k : k + 5]] for k in range(len(t))) / n
            assert abs(np.log2(got[i].perplexity) - want) < 1e-4 * max(1, want), i
        bands = {i % 4: (r.low, r.high) for i, r in got.items()}
        assert len(set(bands.values())) == 4  # a null language isn't an empty one


def test_quartiles_by_language(spark):
    from rookery.llm.quality_rules import quartiles

    rnd = np.random.default_rng(6)
    rows = [("=en", round(float(x), 3)) for x in rnd.normal(10, 1, 500)] + [("", 3.0)] * 7 + [("=de", None)]
    got = {r.tongue: (r.q1, r.q3) for r in quartiles(spark.createDataFrame(rows, "tongue string, bits double")).collect()}
    en = sorted(x for t, x in rows if t == "=en")
    assert got == {"=en": (en[124], en[374]), "": (3.0, 3.0)}
