"""The queries themselves: their columns, a row for each row of their table, and SQL where there is some."""

import duckdb
import pytest
from pyspark.sql import functions as F

from rookery.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
#: Columns that the contracts name, in order.
COLUMNS = {
    "op1_token_counts": "doc_id n_bytes n_tokens over_limit", "op2_quality_classifier": "doc_id held_out score predicted", "op3_mixing": "doc_id size source_size target taken",
    "op4_embedding_near_dedup": "vec_id n_links component_id kept", "op5_toxicity": "doc_id held_out score predicted", "op6_minhash_near_dedup": "doc_id class_id component_id kept",
    "op7_chat_formatting": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op8_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op9_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset", "op10_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op11_tokenizer_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256", "op12_line_dedup": "doc_id n_lines n_dropped kept_sha256", "op13_vector_codes": "vec_id code error label_error codebooks_sha256",
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF)
    assert got.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    rows = got.collect()
    key, table = ("vec_id", "embeddings") if name.startswith(("op4", "op13")) else ("conv_id", "conversations") if name.startswith("op7") else ("doc_id", "documents")
    all_ids = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(F.col(key)).distinct().collect()}
    assert {r[key] for r in rows} - {-1} == all_ids
    if name not in ORACLE_SQL:
        return
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted((tuple(dict(zip(names, r, strict=True))[c] for c in got.columns) for r in found.fetchall()), key=str)
    assert sorted(map(tuple, rows), key=str) == want
