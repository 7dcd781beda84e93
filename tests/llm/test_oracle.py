"""Registered queries against DuckDB on the smallest test data, and their columns."""

import pytest

from loanlens.llm.queries import ORACLE_SQL, QUERIES
from tools.check_oracle import compare

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_line_dedup": "doc_id text n_lines n_removed removed_lines",
    "op2_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op3_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op4_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op5_jaccard_join": "doc_id n_shingles component_id",
    "op6_quality_classifier": "doc_id held_out score predicted",
    "op7_topk_search": "query_id rank vec_id score",
    "op8_decontamination": "doc_id item_id item_shingles shared containment doc_shingles",
    "op9_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op10_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op11_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept js_chars js_words",
    "op12_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
    "op13_conversation_trie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
}


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, key):
    res = compare(spark, SF, [key], verbose=False)[key]
    assert "error" not in res, res.get("error")
    assert res["columns_match"] and res["values_match"], res


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_columns_and_extra_columns(spark, key, tmp_path):
    """The contract's columns; columns with clashing names in the tables do no harm."""
    from pyspark.sql import functions as F

    clash = ["text_key", "body", "rank", "set", "shingle", "n", "label", "cell", "part", "start", "score", "held_out", "_doc", "shard",
             "words", "kept", "conv", "depth", "vector", "aid"]
    for t in ("documents", "labels", "benchmark", "embeddings", "conversations"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        df.withColumns({c: F.lit("x") for c in clash if c not in df.columns}).write.parquet(f"{tmp_path}/{t}.parquet")
    want = QUERIES[key](spark, SF)
    assert want.columns == COLUMNS[key].split()
    assert QUERIES[key](spark, str(tmp_path)).count() == want.count()
