"""Readers, writers and the layer build from landed files to dashboards."""

import datetime as dt
import json
import uuid

import pytest
from conftest import records
from pyspark.sql import functions as F, types as T

from kerbline.operators import advisory_text, rollup
from kerbline.functions.keys import sighting_key
from kerbline.plans import feeds
from kerbline.plans.layers import BI_TABLES, Layers
from kerbline.sources import readers, tables


def test_lookup_by_extension(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Bronx"), (2, "Queens")], "LocationID int, Borough string")
    (tmp_path / "z.csv").write_text("LocationID,Borough\n1,Bronx\n2,Queens\n")
    (tmp_path / "z.txt").write_text("LocationID,Borough\n1,Bronx\n2,Queens\n")
    (tmp_path / "z.json").write_text('{"LocationID": 1, "Borough": "Bronx"}\n{"LocationID": 2, "Borough": "Queens"}\n')
    rows.write.parquet(str(tmp_path / "z.parquet"))
    for name in ("z.csv", "z.txt", "z.json", "z.parquet"):
        got = readers.read_lookup(spark, str(tmp_path / name))
        assert records(got.selectExpr("int(LocationID)", "Borough")) == [(1, "Bronx"), (2, "Queens")], name
    typed = readers.read_lookup(spark, str(tmp_path / "z.csv"), "LocationID string, Borough string")
    assert typed.schema["LocationID"].dataType == T.StringType()


def test_weather_documents_with_unequal_arrays(spark, tmp_path):
    doc = {"latitude": 40.7, "longitude": -73.9, "timezone": "America/New_York", "elevation": 10.0, "hourly": {
        "time": ["2026-03-01T00:00", "2026-03-01T01:00", "broken"], "temperature_2m": [1.5, None], "precipitation": [0.0, 0.1, 0.2],
        "rain": [0.0], "snowfall": [], "weather_code": [3, 61, 71], "wind_speed_10m": [1.0, 2.0, 3.0]}}
    (tmp_path / "w.json").write_text(json.dumps(doc, indent=2))
    got = readers.weather_observations(readers.read_weather_documents(spark, str(tmp_path))).orderBy("precipitation").collect()
    assert [r.observation_time for r in got] == [dt.datetime(2026, 3, 1), dt.datetime(2026, 3, 1, 1), None]
    assert [r.temperature_2m for r in got] == [1.5, None, None] and {r.latitude for r in got} == {40.7}
    assert [r.snowfall for r in got] == [None] * 3 and [r.weather_code for r in got] == [3, 61, 71]


def test_pages_are_read_whole(spark, tmp_path):
    (tmp_path / "a.html").write_text('<h2 id="q">Queens</h2>\n<h3>Place</h3>\n<p>one\nline</p>')
    entries = advisory_text.extract_page_entries(readers.read_pages(spark, str(tmp_path))).collect()
    assert len(entries) == 1 and entries[0].advisory_text == "one line" and entries[0].page_id.endswith("a.html")


def test_writers(spark):
    name = f"t_{uuid.uuid4().hex[:8]}"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    tables.write_table(rows, name)
    assert tables.write_table(rows.withColumn("w", F.lit(1.0)), name).columns == ["k", "v", "w"]  # schema replaced
    report = tables.write_table_reporting(rows, name, "k", partition_by=("v",))
    assert report == {"rows_loaded": 2, "first_time": 1, "last_time": 2}
    schema = T.StructType([T.StructField("a", T.StringType(), True, {"comment": "note"})])
    made = tables.ensure_table(spark, f"{name}_e", schema)
    assert made.count() == 0 and made.schema["a"].metadata.get("comment") == "note"
    tables.ensure_table_like(rows, f"{name}_e")  # exists: left alone
    assert spark.table(f"{name}_e").columns == ["a"]
    with pytest.raises(tables.EmptyBatchError, match="empty"):
        tables.require_rows(rows.limit(0), "empty")
    assert tables.require_rows(rows, "x") is rows
    assert "TakeOrderedAndProject" in tables.preview(rows, ("k",))._jdf.queryExecution().executedPlan().toString()


def test_version_is_read_while_the_next_is_written(spark):
    name = f"v_{uuid.uuid4().hex[:8]}"
    tables.publish_version(spark.range(3).toDF("k"), name)
    tables.publish_version(spark.table(name).unionByName(spark.range(3, 5).toDF("k")), name)
    assert records(spark.table(name)) == [(i,) for i in range(5)]


def test_all_layers(spark, small_sf):
    """Landed batches to BI and validation tables; a second identical load changes nothing."""
    layers = Layers(spark, *feeds.WINDOW, prefix=f"k{uuid.uuid4().hex[:6]}_", history_buckets=4)
    months = dict(zip(("raw.green_01_2024", "raw.green_02_2024", "raw.green_03_2024"), feeds.trip_months(spark, small_sf)))
    entries = feeds.scrape_entries(spark, small_sf).drop("source_system", "batch_id").withColumn("advisory_sk", sighting_key())
    inputs = (months, feeds.weather_raw(spark, small_sf).drop("borough"), feeds.zones_raw(spark, small_sf), entries)
    layers.run(*inputs, batch_id="b1")

    assert layers.table("clean.green_taxi").count() == feeds.trips(spark, small_sf).count()
    stored = layers.table("bi_visualization.borough_flow_analytics")
    from kerbline.plans.catalog import CATALOG
    assert records(stored) == records(CATALOG["BI-1a_borough_flows"][0](spark, small_sf))
    impact = layers.table("bi_visualization.traffic_advisory_and_incident_impact")
    assert records(impact) == records(CATALOG["BI-4_advisory_impact"][0](spark, small_sf))
    quality = layers.table("validation.clean_layer_quality")
    assert quality.count() == 69 and rollup.status_totals(quality).first().total_checks == 69
    assert layers.table("validation.mart_layer_quality").filter("dataset = 'kpi_summary' AND status = 'PASS'").count() == 1

    before = records(layers.table("clean.traffic_advisory").drop("ingested_at"))
    raw_rows = layers.table("raw.traffic_advisory").count()
    layers.land_scrape(entries, "advisory_pages", "b2")
    layers.merge_advisories()
    assert layers.table("raw.traffic_advisory").count() == raw_rows
    assert records(layers.table("clean.traffic_advisory").drop("ingested_at")) == before
    assert records(layers.merge_advisories(rebuild=True).drop("ingested_at")) == before

    outputs = layers.bi_outputs()
    assert set(outputs) == set(BI_TABLES)
    assert layers.table("validation.mart_layer_quality").filter("`column` = 'total_trips'").count() == len(BI_TABLES)
    totals = layers.table("dq_visualization.clean_status_totals").first()
    assert totals.total_checks == 69 and totals.pass_checks + totals.warn_checks + totals.fail_checks == 69
    assert layers.table("dq_visualization.mart_by_dataset_status").agg({"check_count": "sum"}).first()[0] == (
        layers.table("validation.mart_layer_quality").count())

    plan = outputs["traffic_advisory_and_incident_impact"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((isnull(pickup_date" in plan.replace("#", " #").replace(" #", "#") or "PartitionFilters: [(isnull(pickup_date" in plan
    profiled = layers.profile_raw()
    assert {r.table_name for r in profiled.select("table_name").distinct().collect()} == {
        "green_01_2024", "green_02_2024", "green_03_2024", "weather", "taxi_zones", "traffic_advisory"}
    with pytest.raises(tables.EmptyBatchError):
        layers.land_scrape(entries.limit(0), "advisory_pages", "b3")


def _scrapes(spark, small_sf):
    entries = feeds.scrape_entries(spark, small_sf).drop("source_system", "batch_id").withColumn("advisory_sk", sighting_key())
    days = sorted(r.scrape_date for r in entries.select("scrape_date").distinct().collect())
    return entries.cache(), days


def test_every_landed_scrape_is_merged(spark, small_sf):
    """Several scrapes between merges, and one that lands late, give what a rebuild gives."""
    layers = Layers(spark, *feeds.WINDOW, prefix=f"k{uuid.uuid4().hex[:6]}_")
    layers.prepare()
    entries, days = _scrapes(spark, small_sf)
    assert len(days) >= 4
    late = days[-2]

    def history():
        return records(layers.table("clean.traffic_advisory").drop("ingested_at"))

    layers.land_scrape(entries.filter(F.col("scrape_date") == days[0]), "pages", "b1")
    layers.merge_advisories()
    layers.land_scrape(entries.filter((F.col("scrape_date") > days[0]) & (F.col("scrape_date") != late)), "pages", "b2")
    layers.merge_advisories()
    merged = history()
    layers.merge_advisories(rebuild=True)
    assert merged == history()
    layers.merge_advisories()
    assert merged == history()  # nothing is pending
    layers.land_scrape(entries.filter(F.col("scrape_date") == late), "pages", "b3")
    layers.merge_advisories()
    with_late = history()
    assert with_late != merged
    layers.merge_advisories(rebuild=True)
    assert with_late == history()
    seen = layers.table("clean.traffic_advisory").agg(F.sum("times_seen")).first()[0]
    assert seen == layers.table("raw.traffic_advisory").count()


def test_lost_rebuild_leaves_the_old_version(spark):
    name = f"v_{uuid.uuid4().hex[:8]}"
    tables.publish_version(spark.range(3).toDF("k"), name)
    broken = spark.range(2).select(F.raise_error(F.lit("lost")).cast("long").alias("k"))
    with pytest.raises(Exception, match="lost"):
        tables.publish_version(broken, name)
    assert records(spark.table(name)) == [(0,), (1,), (2,)]
    tables.publish_version(spark.range(1).toDF("k"), name)
    assert records(spark.table(name)) == [(0,)]
