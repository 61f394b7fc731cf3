import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as p
from rookery.llm import minhash, mixing, quality_fm, toxicity
from rookery.llm.base import stage

SF = "/root/testdata/sf0.01"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_each_stage_decides_for_all_it_gets(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    steps = dict(p.STAGES)
    clean = stage(steps["toxicity"](spark, docs, SF), "a")
    assert clean.columns == docs.columns and ids(clean) == ids(toxicity.score_toxicity(docs, labels).where("predicted = 0"))
    good = stage(steps["quality"](spark, clean, SF), "b")
    assert good.columns == docs.columns and ids(good) == ids(quality_fm.score_quality(clean, labels).where("predicted = 1"))
    one = stage(steps["near_dedup"](spark, good, SF), "c")
    assert one.columns == docs.columns and ids(one) == ids(minhash.near_duplicates(good).where("kept"))
    mixed = stage(steps["mixing"](spark, one, SF), "d")
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    sizes = {r.doc_id: (r.source, r.size, r.target) for r in mixing.mix(one).collect()}
    assert mixed.columns == docs.columns and copies.keys() <= sizes.keys() and max(copies.values()) <= mixing.MOST
    for source in {s for s, _, _ in sizes.values()}:
        mine = {i: (n, t) for i, (s, n, t) in sizes.items() if s == source}
        taken = sum(copies.get(i, 0) * n for i, (n, _) in mine.items())
        assert abs(taken - next(t for _, t in mine.values())) <= max(n for n, _ in mine.values())
    packed = steps["packing"](spark, mixed, SF).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = sum((len(e.ids) + 1) for e in tokenizer.encode_batch([r.text for r in mixed.collect()], add_special_tokens=False))
    assert packed["length"].sum() == total and packed.groupby("sequence_id")["length"].sum().max() <= 2048
    assert packed["sequence_id"].nunique() <= 1.02 * np.ceil(total / 2048) + 1


def test_rows_without_ids_and_equal_rows(spark):
    five, other = "alpha beta gamma delta epsilon", "quite another text of its own kind"
    rows = [(None, five, "en", "a", 5), (None, five, "en", "a", 5), (1, five, "en", "a", 5), (1, five, "en", "a", 5), (2, five, "en", None, None), (1, other, "en", "a", 5), (3, None, None, "b", 0), (None, None, None, "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = p.near_dedup(spark, docs, SF)
    # One of the five equal texts, the other text of id 1, and null texts, which are near nothing.
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (1, five), (1, other), (3, "")]
    mixed = p.mixing(spark, docs.where("text is not null"), SF)
    assert mixed.columns == docs.columns
    empty = docs.limit(0)
    for _, step in p.STAGES:
        empty_out = step(spark, empty, SF)
        assert empty_out.count() == 0


def test_names_of_its_own_columns(spark):
    five = "alpha beta gamma delta epsilon"
    rows = [(1, five, "a", "r1", "t1", "x"), (2, five, "a", "r2", "t2", "x"), (3, "another text", "b", "r3", "t3", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row string, Times string, time string")
    kept = p.near_dedup(spark, docs, SF)
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]
    mixed = p.mixing(spark, docs, SF)
    assert mixed.columns == docs.columns and {tuple(r) for r in mixed.collect()} <= set(rows)
