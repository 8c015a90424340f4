"""Incremental check results against full runs."""

import uuid

import pytest
from conftest import records
from pyspark.sql import functions as F

from kerbline.operators import check_state as cs, quality
from kerbline.operators.quality import Policy

CHECKS = [
    quality.passes("a", "Validity", "a > 0", quality.FAIL_ON_ANY), quality.fails("it's", "Completeness", "a IS NULL", quality.BY_PERCENT),
    quality.passes("b", "Accuracy", "b BETWEEN 1 AND 40", quality.WARN_ON_ANY), quality.fails("b", "Consistency", "b = 99", quality.tolerated(3)),
]


def batch(spark, k, n=200):
    return spark.range(n).selectExpr(f"CAST(IF(id % (7 + {k}) = 0, NULL, id - 5) AS INT) AS a", f"CAST(id % 50 + {k} AS INT) AS b")


def test_incremental_equals_the_full_run_after_each_batch(spark, tmp_path):
    store, seen = f"checks_{uuid.uuid4().hex[:8]}", None
    for k in range(3):
        df = batch(spark, k)
        seen = df if seen is None else seen.union(df)
        states = cs.check_batch(df, CHECKS, "trips", f"b{k}", store)
        assert records(cs.merged_results(states, CHECKS)) == records(quality.run_checks(seen, CHECKS))
        cs.check_batch(batch(spark, 9), CHECKS, "other", f"b{k}", store)
    again = cs.check_batch(batch(spark, 0), CHECKS, "trips", "b0", store)  # a batch that is loaded again counts once
    assert records(cs.merged_results(again, CHECKS)) == records(quality.run_checks(seen, CHECKS))
    changed = cs.check_batch(batch(spark, 5), CHECKS, "trips", "b0", store)
    want = batch(spark, 5).union(batch(spark, 1)).union(batch(spark, 2))
    assert records(cs.merged_results(changed, CHECKS)) == records(quality.run_checks(want, CHECKS))


def test_only_the_new_batch_is_scanned(spark, tmp_path):
    batch(spark, 1).write.parquet(str(tmp_path / "new"))
    plan = cs.check_counts(spark.read.parquet(str(tmp_path / "new")), CHECKS, "t", "b")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_drift_of_a_failure_rate(spark):
    checks = [quality.fails("a", "Validity", "id % 100 < 2", quality.BY_PERCENT), quality.fails("b", "Validity", "id % 100 < bad", quality.BY_PERCENT)]
    made = lambda name, bad, n=5000: cs.check_counts(spark.range(n).withColumn("bad", F.lit(bad)), checks, "t", name)
    states = made("b1", 2).union(made("b2", 2)).union(made("b3", 9)).union(made("b4", 50))
    for name, want in (("b1", [0, 0]), ("b2", [0, 0]), ("b3", [0, 1])):
        got = cs.drift(states, name).orderBy("column").collect()
        assert [(r.failed_rows, r.status) for r in got] == [(w, "WARN" if w else "PASS") for w in want], name
        assert {r.data_quality_check for r in got} == {"Validity drift"}
    assert [r.failed_rows for r in cs.drift(made("b1", 2).union(made("b2", 9, 0)), "b2").collect()] == [0, 0]


def test_empty_batches_and_refused_checks(spark):
    none = cs.check_counts(batch(spark, 0, 0), CHECKS, "t", "b")
    assert records(cs.merged_results(none, CHECKS, 0.0)) == records(quality.run_checks(batch(spark, 0, 0), CHECKS, empty_percentage=0.0))
    with pytest.raises(ValueError, match="a"):
        cs.check_counts(batch(spark, 0), [quality.Check("a", "Uniqueness", "count(a) - count(DISTINCT a)", Policy("severity"))], "t", "b")
