"""The registered queries over whole tables: SQL twins where there are any, and the columns of the others."""

import pytest
from oracle import compare, connect

from voxstars.llm.queries import ORACLE, QUERIES

COLUMNS = {
    "op1_benchmark_passages": {"doc_id", "item_ids", "n_passages", "least_distance", "most_distance"},
    "op3_repeated_bytes": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op4_simhash_components": {"doc_id", "fingerprint", "component_id"},
    "op5_ppm_scores": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op6_resample_quality": {"doc_id", "log_weight", "sample_key"},
    "op7_mix_sources": {"doc_id", "size", "source_size", "target", "taken"},
    "op8_toxic_passages": {"doc_id", "held_out", "score", "predicted", "segments"},
    "op10_main_text": {"page_id", "url", "text", "n_chars"},
    "op11_spelling_variants": {"word", "form", "root", "n", "n_near", "form_n"},
    "op12_whitened_vectors": {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"},
    "op13_packed_shards": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
}
WHOLE = {"op3_repeated_bytes", "op4_simhash_components", "op5_ppm_scores", "op7_mix_sources", "op8_toxic_passages", "op13_packed_shards"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, folder, name):
    con = connect(folder)
    assert compare(QUERIES[name](spark, folder), con, ORACLE[name]) is None
    con.close()


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_rows_and_columns(spark, folder, name):
    df = QUERIES[name](spark, folder)
    assert set(df.columns) == COLUMNS[name]
    rows = df.count()
    if name in WHOLE:
        assert rows == spark.read.parquet(f"{folder}/documents.parquet").count()
    elif name == "op10_main_text":
        assert rows == spark.read.parquet(f"{folder}/pages.parquet").count()
    else:
        assert rows > 0


def test_every_query_is_tested():
    assert set(QUERIES) == set(ORACLE) | set(COLUMNS)
