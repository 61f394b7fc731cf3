import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rookery.llm import charlm, quality_fm, toxicity
from rookery.llm.base import held_out, label_sample

SF = "/root/testdata/sf0.01"


def accuracy(scored, labels, target):
    rows = scored.join(labels, "doc_id").where(held_out()).select("predicted", target).collect()
    return np.mean([r.predicted == r[target] for r in rows])


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_labels_of_held_out_rows_are_never_read(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1), (3, None), (0, 1)], "doc_id long, quality int")
    got = label_sample(labels, "quality", 50)
    assert got.count() == 50 and got.where(held_out()).count() == 0
    assert label_sample(labels, "quality", 1000).count() == labels.where("doc_id is not null").where(~held_out()).select("doc_id").distinct().count()


def test_pairs_in_linear_time():
    rnd = np.random.default_rng(3)
    size = quality_fm.WORDS + len(quality_fm.STATISTICS) * quality_fm.BINS
    m = quality_fm.Machine(0.1, rnd.normal(size=size) * 0.1, rnd.normal(size=(size, 4)) * 0.1, np.zeros((1, 1)))
    at, value = np.array([3, 77, 500, 9000]), np.array([0.5, 0.2, 1.0, 0.3])
    pairs = sum(m.v[at[i]] @ m.v[at[j]] * value[i] * value[j] for i, j in itertools.combinations(range(4), 2))
    assert m.score(at, value) == pytest.approx(1 / (1 + np.exp(-(0.1 + m.w[at] @ value + pairs))))


def test_quality_on_held_out_rows(tables):
    assert accuracy(quality_fm.score_quality(*tables), tables[1], "quality") > 0.95


def plain_quality(m, text, n_chars):
    """A score as its definition says it: features counted plainly, every pair of them."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", text)
    lines = [x for x in re.split(rb"\n", text) if re.search(rb"[^\x20\x09-\x0D]", x)]
    n, size = max(1, len(words)), max(1, len(text))
    share = lambda some: sum(len(re.findall(some, text[i : i + 1])) for i in range(len(text))) / size
    stats = [
        np.log1p(len(words)), sum(len(w) for w in words) / n, np.log1p(len(set(words))) / np.log1p(n), max((words.count(w) for w in set(words)), default=0) / n,
        sum(words[i] == words[i - 1] for i in range(1, len(words))) / n, share(rb"[#*$%&|<>!~^=]"), share(rb"[A-Z]"), share(rb"[0-9]"), share(rb"[.,;:?]"), share(rb"[\x80-\xff]"),
        np.log1p(len(words) / max(1, len(lines))), len(set(lines)) / max(1, len(lines)), np.log1p(max(0, len(text) if n_chars is None else n_chars)),
    ]
    x = dict.fromkeys((zlib.crc32(w.lower()) % quality_fm.WORDS for w in words), 0)
    for w in words:
        x[zlib.crc32(w.lower()) % quality_fm.WORDS] += 1
    x = {i: np.log1p(c) for i, c in x.items()}
    length = max(1e-9, sum(v * v for v in x.values()) ** 0.5)
    x = {i: v / length for i, v in x.items()}
    for k, value in enumerate(stats):
        x[quality_fm.WORDS + k * quality_fm.BINS + sum(value >= b for b in m.bounds[k])] = 0.5
    raw = m.w0 + sum(m.w[i] * v for i, v in x.items()) + sum(m.v[i] @ m.v[j] * x[i] * x[j] for i, j in itertools.combinations(x, 2))
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def test_quality_as_brute_force(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame([(-1, "", 0), (-2, None, None), (-3, "Das ist ÄÖ 12 # it it\n\n it\n", None), (-4, " \n", 2)], "doc_id long, text string, n_chars long")
    every = docs.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars")).unionByName(odd)
    machine = quality_fm.learn(every, labels)
    some = every.where("text is null or length(text) < 1500").orderBy(F.xxhash64("doc_id")).limit(60).unionByName(odd)
    want = {r.doc_id: plain_quality(machine, (r.text or "").encode(), r.n_chars) for r in some.collect()}
    got = {r.doc_id: (r.score, r.predicted) for r in quality_fm.score_quality(every, labels).where(F.col("doc_id").isin(list(want))).collect()}
    assert got.keys() == want.keys() and len(want) > 60
    for i, score in want.items():
        assert got[i][0] == pytest.approx(score, rel=1e-9) and got[i][1] == (got[i][0] >= quality_fm.CUT), i
    assert len({p for _, p in got.values()}) == 2


def test_toxicity_on_held_out_rows(tables):
    scored = toxicity.score_toxicity(*tables)
    assert accuracy(scored, tables[1], "toxic") > 0.93
    clean = scored.join(tables[1].where("toxic = 0"), "doc_id")
    assert clean.where("predicted = 1").count() == 0


def test_disguised_words_are_restored(spark, tables):
    model = charlm.fit(charlm.count(tables[0], "text", 3, charlm.FOLDED), 3)
    reader = toxicity.Reader(model, {"idiot": 0, "stupid": 1, "moron": 2})
    for text, term in (("1d10t", 0), ("IDIOOOOT!!", 0), ("$tup1d", 1), ("st*pid", 1), ("m.o.r.o.n", 2), ("you i d i o t there", 0), ("m0r0n,", 2), ("a plain text of 1999 words", None), ("", None)):
        assert reader.read(text.encode()) == ({term} if term is not None else set()), text


def test_disguises_of_other_kinds_are_restored(spark, tables):
    model = charlm.fit(charlm.count(tables[0], "text", 3, charlm.FOLDED), 3)
    reader = toxicity.Reader(model, {"idiot": 0, "stupid": 1, "moron": 2, "blöde": 3})
    for text, term in (("i/d/i/o/t", 0), ("i*d*i*o*t", 0), ("(m|o|r|o|n)", 2), ("idiiot", 0), ("you b l ö d e there", 3), ("s/t/u/p/i/d,", 1), ("and/or either letter", None), ("you i   d   i   o   t", 0), ("i\xa0d\xa0i\xa0o\xa0t", 0), ("you id iot", 0), ("\xefd\xef\xf6t", 0), ("\u0456diot", 0), ("m\u200bor\u200bon", 2), ("st\u00fcpid", 1), ("the id is on it", None)):
        assert reader.read(text.encode()) == ({term} if term is not None else set()), text


def test_restoring_is_exact(spark, tables):
    model = charlm.fit(charlm.count(tables[0], "text", 3, charlm.FOLDED), 3)
    toxicity.Reader(model)  # makes the table
    assert model.costs == model.table.tolist()

    def weight(text):
        keys, _ = charlm.keys_of(pa.array([f" {text} ".encode()]), 3, charlm.FOLDED)
        return float(model.table[keys[1:]].astype(float).sum())

    for word in ("*d**t", "p1*9s", "**mb3r"):
        options = []
        for readings in itertools.product(*(toxicity.STANDS_FOR.get(c, c) for c in word)):
            cost = sum(0 if x == c else toxicity.DISGUISED + (toxicity.CONSONANT if c == "*" and x not in "aeiou" else 0) for x, c in zip(readings, word, strict=True))
            options.append((cost + weight("".join(readings)), "".join(readings)))
        top = [t for _, t in sorted(options, key=lambda x: (-x[0], x[1]))[:3]]
        got = [t for t in toxicity.restore(word, model, best=10_000) if len(t) == len(word)][:3]
        assert got == top, word
        few = toxicity.restore(word, model)
        assert few == toxicity.restore(word, model, best=10_000)[:3], word


@pytest.mark.parametrize("score", [quality_fm.score_quality, toxicity.score_toxicity])
def test_odd_rows(spark, score):
    docs = spark.createDataFrame([(1, "fine words here", 3, "x"), (1, "fine words here", None, "x"), (None, None, 5, "y"), (2, "", 0, None), (3, "w " * 40000, 9, "")], "doc_id long, text string, n_chars long, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (1, None, None), (None, 0, 1)], none.schema)
    for labels in (none, some):
        rows = score(docs, labels).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        assert score(docs.limit(0), labels).count() == 0
    assert score(docs.drop("n_chars"), some).count() == 5


def test_filters_keep_whole_rows(tables):
    docs, labels = tables
    docs = docs.withColumn("predicted", F.lit("clash"))
    for drop, score, bad in ((toxicity.drop_toxic, toxicity.score_toxicity, 1), (quality_fm.drop_low_quality, quality_fm.score_quality, 0)):
        kept = drop(docs, labels)
        assert kept.columns == docs.columns
        out = {r.doc_id for r in score(docs, labels).where(F.col("predicted") == bad).collect()}
        assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - out


def test_a_walk_of_terms_leaves_out_no_reading(spark, tables):
    model = charlm.fit(charlm.count(tables[0], "text", 3, charlm.FOLDED), 3)
    terms = {t: i for i, t in enumerate(["idiot", "stup~", "moron", "the", "ther", "rest~"])}
    reader, rnd = toxicity.Reader(model, terms), np.random.default_rng(4)
    for _ in range(400):
        word = "".join(rnd.choice(list("idotherslpum10*$@3!éѕі"), int(rnd.integers(3, 8))))
        readings = toxicity.restore(word, model)
        want = {t for r in readings for t in reader._of(r) if t in terms}
        assert {t for r in reader._restored(word) for t in reader._of(r) if t in terms} == want, word


def test_copies_of_one_document_make_no_terms(spark, tables):
    model = charlm.fit(charlm.count(tables[0], "text", 3, charlm.FOLDED), 3)
    rnd = np.random.default_rng(5)
    word = lambda: "".join(rnd.choice(list("aeioulmnrst"), 6))
    one = " ".join(word() for _ in range(60))
    rows = [(i, one if i % 2 else f"{word()} you grumblefish {word()} {word()}", 1) for i in range(120)] + [(200 + i, " ".join(word() for _ in range(8)), 0) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    terms, _ = toxicity.learn(docs, labels, model)
    assert "grumblefish" in terms and not set(one.split()) & set(terms)


def test_a_repeated_id_is_one_training_row(spark, tables):
    model = charlm.fit(charlm.count(tables[0], "text", 3, charlm.FOLDED), 3)
    docs = spark.createDataFrame([(2, f"some words {i}") for i in range(300)] + [(3, "x y z")], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 1, 1), (3, 0, 0)], "doc_id long, toxic int, quality int")
    toxicity.learn(docs, labels, model)
    assert quality_fm.training_rows(docs, labels).count() <= 2
