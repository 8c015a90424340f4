"""Sketched profiles against the exact one: merges, bounds, odd columns."""

import uuid

import pytest

from kerbline.operators import profile, profile_sketch as ps


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(60_000).selectExpr(
        "id AS unique_id", "CAST(pmod(id * 7919, 5000) AS INT) AS some", "CAST(pmod(id, 7) AS SMALLINT) AS few",
        "CAST(pmod(id * 31, 1009) AS DOUBLE) / 4 AS value", "IF(id % 3 = 0, NULL, concat('k', CAST(sqrt(id) AS INT))) AS name",
        "CAST(NULL AS STRING) AS none", "id % 2 = 0 AS flag", "date_add(DATE'2024-01-01', CAST(id % 400 AS INT)) AS day",
        "CAST(id % 90 AS DECIMAL(12,2)) AS money", "array(id % 3) AS list", "CAST(IF(id % 5 = 0, 'NaN', '1') AS DOUBLE) AS odd", "'it''s' AS `a b`")


def test_bounds_against_the_exact_profile(spark, table):
    exact = {r.column_name: r for r in profile.profile(table, "t").collect()}
    got = {r.column_name: r for r in ps.sketch_profile(table, "t").collect()}
    assert set(got) == set(exact)
    for name, e in exact.items():
        g = got[name]
        assert (g.table_name, g.data_type, g.total_rows, g.null_count, g.null_percentage) == ("t", e.data_type, e.total_rows, e.null_count, e.null_percentage)
        assert abs(g.distinct_count - e.distinct_count) <= max(1, 0.05 * e.distinct_count), name
        if name not in ("list", "odd", "flag"):
            assert (float(g.min_value), float(g.max_value)) == (float(e.min_value), float(e.max_value)) if g.quartiles else (
                g.min_value, g.max_value) == (e.min_value, e.max_value), name
    assert got["few"].most_common_rows == table.filter("few = 0").count() and got["few"].most_common_value in "0123"
    assert got["a b"].most_common_value == "it's"
    assert got["name"].most_common_value == exact["name"].most_common_value
    assert got["none"].most_common_value is None and got["none"].quartiles is None and got["none"].distinct_count == 0
    for name in ("unique_id", "value"):
        for share, q in zip(ps.QUANTILES, got[name].quartiles):
            rank = table.filter(f"{name} <= {q!r}").count() / 60_000
            assert abs(rank - share) < 0.02


def test_batches_merge_into_the_whole(spark, table):
    parts = [(f"b{k}", table.filter(f"unique_id % 3 = {k}")) for k in range(3)]
    whole = {r.column_name: r for r in ps.sketch_profile(table, "t").collect()}
    got = {r.column_name: r for r in ps.estimates(ps.sketch_batches(parts, "t")).collect()}
    for name, w in whole.items():
        g = got[name]
        assert (g.total_rows, g.null_count, g.min_value, g.max_value) == (w.total_rows, w.null_count, w.min_value, w.max_value)
        assert abs(g.distinct_count - w.distinct_count) <= max(1, 0.05 * w.distinct_count)
        if w.distinct_count < 500:
            assert g.most_common_rows == w.most_common_rows, name


def test_new_batch_reads_no_old_one(spark, table):
    store = f"sketches_{uuid.uuid4().hex[:8]}"
    ps.profile_batch(table.filter("unique_id < 100"), "t", "b1", store)
    ps.profile_batch(table.filter("unique_id >= 100"), "t", "b2", store)
    ps.profile_batch(table.filter("unique_id < 50"), "t", "b1", store)  # this batch is loaded again
    rows = {r.column_name: r for r in ps.estimates(spark.table(store)).collect()}
    assert rows["unique_id"].total_rows == 60_000 - 50 and (rows["unique_id"].min_value, rows["unique_id"].max_value) == ("0", "59999")
    assert spark.table(store).count() == 2 * len(table.columns)


def test_one_scan_and_one_row_shuffled(spark, table, tmp_path):
    table.limit(1000).write.parquet(str(tmp_path / "t"))
    plan = ps.column_sketches(spark.read.parquet(str(tmp_path / "t")), "t", "b")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange SinglePartition") == 1 and "Expand" not in plan


def test_empty_table(spark, table):
    rows = ps.sketch_profile(table.limit(0), "t").collect()
    assert len(rows) == len(table.columns)
    assert {(r.total_rows, r.null_count, r.distinct_count, r.min_value, r.most_common_value, r.quartiles, r.null_percentage) for r in rows} == {
        (0, 0, 0, None, None, None, None)}
