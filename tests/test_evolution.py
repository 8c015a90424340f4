"""Types that drift between months."""

import itertools

import pytest
from conftest import records
from pyspark.sql import types as T

from kerbline.operators import clean, evolution as ev

SAMPLES = {
    "tinyint": "-128Y", "smallint": "32767S", "int": "-2147483648", "bigint": "9223372036854775807L", "decimal(12,2)": "9999999999.99BD",
    "decimal(38,0)": "99999999999999999999999999999999999999BD", "double": "0.1D", "string": "'x'", "date": "DATE'2024-02-29'",
    "timestamp_ntz": "TIMESTAMP_NTZ'2024-01-01 10:00:00'", "boolean": "true",
}


@pytest.mark.parametrize("a, b", list(itertools.combinations_with_replacement(SAMPLES, 2)))
def test_lattice_holds_both(spark, a, b):
    one, two = (T._parse_datatype_string(x) for x in (a, b))
    up = ev.common_type(one, two)
    assert up == ev.common_type(two, one) and ev.common_type(up, one) == up and ev.common_type(up, two) == up


def test_months_union_without_loss(spark):
    months = {
        "m1": spark.sql("SELECT 1 AS id, 5 AS fee, 'a' AS tag, CAST(9007199254740993 AS BIGINT) AS big"),
        "m2": spark.sql("SELECT 3000000000 AS id, 2.25D AS fee, CAST(12345678.5 AS DECIMAL(10,1)) AS big"),
        "m3": spark.sql("SELECT 'x-7' AS ID, NULL AS fee, DATE'2024-01-01' AS tag, array(1) AS extra"),
    }
    out = ev.union_evolved(list(months.values()))
    assert out.dtypes == [("id", "string"), ("fee", "double"), ("tag", "string"), ("big", "decimal(20,1)"), ("extra", "array<int>")]
    rows = {r.id: r for r in out.collect()}
    assert set(rows) == {"1", "3000000000", "x-7"}
    assert (rows["1"].fee, rows["3000000000"].fee, rows["x-7"].fee, rows["x-7"].tag) == (5.0, 2.25, None, "2024-01-01")
    assert str(rows["1"].big) == "9007199254740993.0" and rows["1"].extra is None and rows["x-7"].extra == [1]
    drift = {(r["column"], r.batch): (r.resolved_type, r.change, r.exact) for r in ev.widenings(months).collect()}
    assert drift["fee", "m1"] == ("double", "widened", True) and drift["tag", "m2"] == ("string", "absent", True)
    assert drift["big", "m2"] == ("decimal(20,1)", "widened", True) and ("id", "m3") not in drift and len(drift) == 11
    lossy = ev.widenings({"a": months["m1"].select("big"), "b": spark.sql("SELECT 1D AS big")}).collect()
    assert [(r.batch, r.exact) for r in lossy] == [("a", False)]


def test_narrowing_is_refused_by_name(spark):
    target = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("s", T.StringType())])
    assert ev.fitted(spark.sql("SELECT 1Y AS n"), target).dtypes == [("n", "int"), ("s", "string")]
    with pytest.raises(ev.NarrowingError, match="n: bigint into int"):
        ev.fitted(spark.sql("SELECT 1L AS n"), target)
    with pytest.raises(ev.NarrowingError, match="more: no such column"):
        ev.union_evolved([spark.sql("SELECT 1 AS n, 2 AS more")], target)


def test_files_of_different_types_and_pushdown(spark, tmp_path):
    paths = {}
    for name, sql in (("a", "SELECT CAST(id AS INT) AS k, 1.5D AS v FROM range(10)"), ("b", "SELECT id AS k FROM range(10, 20)"),
                      ("c", "SELECT CAST(id AS STRING) AS k, CAST(7 AS INT) AS v FROM range(20, 30)")):
        paths[name] = str(tmp_path / name)
        spark.sql(sql).write.parquet(paths[name])
    out = ev.read_evolved(spark, paths, batch="month")
    assert out.dtypes == [("k", "string"), ("v", "double"), ("month", "string")]
    assert records(out.groupBy("month").agg({"v": "sum"})) == [("a", 15.0), ("b", None), ("c", 70.0)]
    two = ev.read_evolved(spark, {x: paths[x] for x in "ab"}).filter("k = 15")
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert two.count() == 1 and plan.count("EqualTo(k,15)") == 2  # the widened month too


def test_union_months_resolves(spark):
    assert clean.union_months([spark.sql("SELECT 1 AS a"), spark.sql("SELECT 2.5D AS a, 'n' AS b")]).dtypes == [("a", "double"), ("b", "string")]
