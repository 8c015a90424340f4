"""Registered training-data queries: against their SQL where they have one, whole tables in all."""

import compare
import pytest

from kerbline.llm.queries import CATALOG


@pytest.mark.parametrize("name", [n for n, (_, sql) in CATALOG.items() if sql])
def test_query_matches_sql(spark, small_sf, name):
    run, sql = CATALOG[name]
    assert compare.difference(compare.spark_rows(run(spark, small_sf)), compare.sql_rows(compare.connect(small_sf), sql)) is None


@pytest.mark.parametrize("name, columns", [
    ("op1_entropy_mix", "doc_id size source_size target taken"),
    ("op3_simhash_near_duplicates", "doc_id fingerprint component_id"),
    ("op4_quality_scores", None),
    ("op2_chunk_fingerprints", "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next"),
    ("op6_toxicity_scores", "doc_id held_out score predicted"),
    ("op7_languages", "doc_id held_out lang_pred score"),
    ("op8_pseudonyms", "doc_id text lang source n_chars n_private"),
])
def test_query_covers_its_table(spark, small_sf, name, columns):
    rows = CATALOG[name][0](spark, small_sf)
    assert set((columns or "doc_id").split()) <= set(rows.columns)
    ids = sorted(r.doc_id for r in rows.select("doc_id").collect())
    assert ids == sorted(r.doc_id for r in spark.read.parquet(f"{small_sf}/documents.parquet").select("doc_id").collect())


def test_numbers_are_all_there():
    assert {n.split("_")[0] for n in CATALOG} == {f"op{k}" for k in range(1, 14)}
