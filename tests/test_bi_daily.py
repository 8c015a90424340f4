"""Answers from daily partial sums after days change, come and go."""

import shutil
import uuid

import pytest
from conftest import records
from pyspark.sql import functions as F

from kerbline.operators import bi
from kerbline.operators.bi_daily import DAY, DailyBI
from kerbline.plans import feeds


@pytest.fixture(scope="module")
def dims(spark, small_sf):
    return feeds.zone_dim(spark, small_sf).cache(), feeds.date_dim(spark, small_sf).cache(), feeds.weather_dim(spark, small_sf).cache()


def test_refreshed_answers_equal_the_full_queries(spark, small_sf, tmp_path, dims):
    zone, date, weather = dims
    home = str(tmp_path / "fact")
    days = feeds.fact(spark, small_sf).withColumn(DAY, F.to_date("pickup_datetime"))
    days.repartition(DAY).write.partitionBy(DAY).parquet(home)
    daily = DailyBI(spark, f"daily_{uuid.uuid4().hex[:8]}")

    def check():
        fact = spark.read.parquet(home)
        for got, want in (
            (daily.borough_flows(zone), bi.borough_flows(fact, zone)), (daily.top_pickup_zones(zone, 7), bi.top_pickup_zones(fact, zone, 7)),
            (daily.temporal_patterns(date), bi.temporal_patterns(fact, date)), (daily.weather_impact(weather), bi.weather_impact(fact, weather)),
            (daily.kpi_summary(), bi.kpi_summary(fact)),
        ):
            assert records(got) == records(want) and got.columns == want.columns

    every = sorted(str(r[0]) for r in spark.read.parquet(home).select(DAY).distinct().collect())
    assert daily.refresh(spark.read.parquet(home)) == every
    check()
    assert daily.refresh(spark.read.parquet(home)) == []
    # One day gets other trips, one is gone.
    some = spark.read.parquet(home).filter(F.col(DAY) == every[3]).limit(2).drop(DAY).collect()
    schema = spark.read.parquet(home).drop(DAY).schema
    spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{home}/{DAY}={every[3]}")
    shutil.rmtree(f"{home}/{DAY}={every[5]}")
    assert daily.refresh(spark.read.parquet(home)) == [every[3]]
    check()


def test_only_changed_days_are_read(spark, small_sf, tmp_path):
    home = str(tmp_path / "fact")
    feeds.fact(spark, small_sf).withColumn(DAY, F.to_date("pickup_datetime")).write.partitionBy(DAY).parquet(home)
    fact = spark.read.parquet(home)
    day = fact.select(F.min(DAY)).first()[0]
    plan = fact.filter(F.col(DAY).isin([F.lit(str(day)).cast("date")]))._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert str(day.toordinal() - 719163) in filters or str(day) in filters


def test_no_trips(spark, small_sf, tmp_path):
    empty = feeds.fact(spark, small_sf).withColumn(DAY, F.to_date("pickup_datetime")).limit(0)
    daily = DailyBI(spark, f"daily_{uuid.uuid4().hex[:8]}")
    assert daily.refresh(empty) == []
    assert records(daily.kpi_summary()) == records(bi.kpi_summary(empty))
