"""Every registered corpus query over the smallest tables: contract columns, one row per document or page, DuckDB."""

import os

import duckdb
import pytest

from repograph.llm import registry

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id keep_id group_size kept text_sha256", "op2": "doc_id size source_size target taken", "op3": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op4": "doc_id held_out lang_pred score", "op5": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op6": "page_id host path rule verdict",
    "op7": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op8": "doc_id piece start length ids_crc32 sequence_id offset",
    "op9": "page_id payload_bytes payload_digest record_type refers_to", "op10": "doc_id fingerprint component_id",
}


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, SF)
    wanted = COLUMNS[name.split("_")[0]].split()
    assert df.columns[: len(wanted)] == wanted
    rows = df.collect()
    table = "pages" if "page_id" in wanted else "documents"
    ids = [r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(wanted[0]).collect()]
    assert sorted(set(r[0] for r in rows)) == sorted(ids)
    assert name.startswith("op8") or len(rows) == len(ids)
    if name in registry.oracle_sql():
        c = duckdb.connect()
        for f in os.listdir(SF):
            c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
        want = c.sql(registry.oracle_sql()[name])
        columns = sorted(want.columns)
        assert columns == sorted(df.columns)
        assert sorted(repr(tuple(r[k] for k in columns)) for r in rows) == sorted(map(repr, want.select(*[f'"{k}"' for k in columns]).fetchall()))


def test_results_dont_depend_on_how_rows_lie(spark, tmp_path):
    for t in ("documents", "pages"):
        spark.read.parquet(f"{SF}/{t}.parquet").repartition(7).write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("op2_mix_sources", "op3_secret_scan", "op4_language_id", "op7_pii", "op10_simhash"):
        q = registry.queries()[name]
        key = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
        assert key(q(spark, SF)) == key(q(spark, str(tmp_path))), name
