"""The registered queries: names, columns of their contracts, and rows where there is an SQL text."""

import pytest

from __spark_entry__ import oracle_sql, queries
from checks.compare import connect, duck_rows, spark_rows

COLUMNS = {
    "op1_pareto_mix": "doc_id size source_size target taken",
    "op2_line_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op3_suffix_array": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op4_blob_ledger": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op5_prefix_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op6_cross_entropy": "doc_id n_tokens target_loss background_loss difference",
    "op7_circulant_minhash": "doc_id n_shingles component_id kept",
    "op8_bit_packing": "doc_id start n_tokens ids_crc32",
    "op9_wrappers": "page_id url text n_chars",
    "op10_bit_sliced_top_k": "query_id rank vec_id score",
    "op11_filter_audit": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    "op12_digest_cache": "doc_id n_bytes n_tokens over_limit",
    "op13_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
}
NATIVE = ["op1_pareto_mix", "op2_line_rules", "op4_blob_ledger"]


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, small, name):
    frame = queries()[name](spark, small)
    assert set(COLUMNS[name].split()) <= set(frame.columns)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in NATIVE:
        assert not any(step in plan for step in ("EvalPython", "InPandas", "InArrow"))
    if name in oracle_sql():
        assert spark_rows(frame) == duck_rows(connect(small), oracle_sql()[name])
    else:
        table = "pages" if name == "op9_wrappers" else "documents"
        assert frame.count() == spark.read.parquet(f"{small}/{table}.parquet").count()


def test_registered():
    assert set(COLUMNS) | {"pipeline"} <= set(queries())
