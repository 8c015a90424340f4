"""Query catalogue: one entry per operator, each over whole given tables.

``CATALOG[name] = (spark query, SQL that must return the same rows, or None)``. Names
start with the operator id of the survey.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kerbline.functions.keys import advisory_key, sighting_key
from kerbline.functions.numeric import percentage
from kerbline.functions.text import date_mentions, first_mention, last_mention, split_segment
from kerbline.functions.timekeys import date_hour_key
from kerbline.operators import (
    advisory_text as text,
    bi,
    check_state,
    clean,
    dedup,
    evolution,
    history as hist,
    mart,
    profile,
    profile_sketch,
    quality,
    rollup,
    rules,
    sighting_state as states,
)
from kerbline.operators.bi_daily import DAY, DailyBI
from kerbline.plans import feeds, oracle as o
from kerbline.plans.layers import BI_TABLES
from kerbline.session import checkpoint_dir
from kerbline.sources import readers, tables
from kerbline.sources.cells import CellTable
from kerbline.streaming import sightings as streaming

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}

STAR_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        CATALOG[name] = (fn, sql)
        return fn

    return register


NOW_SQL = f"TIMESTAMP_NTZ '{feeds.NOW}'"
TODAY_SQL = f"DATE '{feeds.TODAY}'"


# --- sources and sinks --------------------------------------------------------------------


@query("SRC-1_parquet_batches", o.check_rows(
    f"SELECT '{t}' AS batch, COUNT(*) AS rows_loaded FROM {t}" for t in STAR_TABLES))
def parquet_batches(spark, sf_dir):
    frames = readers.read_parquet_batches(spark, {t: f"{sf_dir}/{t}.parquet" for t in STAR_TABLES})
    stamped = [df.select(F.lit(name).alias("batch")) for name, df in frames.items()]
    return tables.load_report(dedup.union_by_name(stamped), ("batch",))


@query("SRC-2_lookup_file", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def lookup_file(spark, sf_dir):
    return readers.read_lookup(spark, f"{sf_dir}/nation.parquet")


_OBSERVATIONS = """
SELECT observation_time, temperature_2m, precipitation, rain, snowfall, weather_code, wind_speed_10m,
       latitude, longitude, timezone, elevation
FROM place_weather_raw WHERE observation_time IS NOT NULL"""


@query("SRC-3_parallel_arrays", o.statement(_OBSERVATIONS, "place_weather_raw"))
def parallel_arrays(spark, sf_dir):
    return readers.weather_observations(feeds.weather_documents(spark, sf_dir))


@query("SRC-4_local_time", """
SELECT o_orderkey, o_orderdate AS order_time, CAST(NULL AS TIMESTAMP) AS malformed_time FROM orders""")
def local_time(spark, sf_dir):
    as_text = feeds.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm").alias("iso"),
        F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyy")).alias("bad"),
    )
    return as_text.select(
        "o_orderkey",
        readers.parse_local_time("iso").alias("order_time"),
        readers.parse_local_time("bad").alias("malformed_time"),
    )


@query("SRC-5_page_entries", o.statement("SELECT * FROM page_entries", "page_entries"))
def page_entries(spark, sf_dir):
    return text.extract_page_entries(feeds.pages_marked(spark, sf_dir))


@query("SRC-6_provenance", """
SELECT *, 'order_feed' AS source_system, 'b1' AS batch_id, true AS has_load_time FROM orders""")
def provenance(spark, sf_dir):
    stamped = tables.with_provenance(feeds.table(spark, sf_dir, "orders"), "order_feed", "b1")
    return stamped.withColumn("has_load_time", F.col("ingested_at").isNotNull()).drop("ingested_at")


@query("SRC-7_explicit_schema", """
SELECT r_regionkey AS location_id, r_name AS borough, n AS zones
FROM (SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY 1) JOIN region ON n_regionkey = r_regionkey""")
def explicit_schema(spark, sf_dir):
    # A handful of declared records (one per known region name) joined to whole tables.
    declared = tables.records_frame(
        spark, [(name,) for name in feeds.BOROUGH_OF_REGION], "borough string"
    )
    per_region = feeds.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("zones"))
    region = feeds.table(spark, sf_dir, "region")
    return (
        region.join(declared, F.col("r_name") == F.col("borough"))
        .join(per_region, F.col("r_regionkey") == F.col("n_regionkey"))
        .select(F.col("r_regionkey").alias("location_id"), "borough", "zones")
    )


def _place(spark: SparkSession, name: str) -> str:
    """Empty folder for a table that a query stores, shared on a cluster; what an earlier run
    or session left there goes."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    path = f"{checkpoint_dir(spark, spark.conf.get('spark.sql.warehouse.dir'))}/kerbline-tables/{name}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return path


@query("SNK-1_table_roundtrip", o.statement("SELECT * FROM fact", "fact"))
def table_roundtrip(spark, sf_dir):
    """Written twice with different schemas to the shared folder, then read back."""
    run = "kerbline_snk_1"
    path = _place(spark, run)
    fact = feeds.fact(spark, sf_dir)
    tables.write_table(fact.select("pu_location_id"), run, path=path)
    return tables.write_table(fact, run, path=path)


@query("SNK-2_table_from_query", o.statement("SELECT * FROM dim_date", "dim_date"))
def table_from_query(spark, sf_dir):
    run = "kerbline_snk_2"
    path = _place(spark, run)
    return tables.write_table(feeds.date_dim(spark, sf_dir), run, path=path)


@query("SNK-3_view", o.statement("SELECT pickup_hour, COUNT(*) AS trips FROM fact GROUP BY pickup_hour", "fact"))
def view(spark, sf_dir):
    tables.register_view(feeds.fact(spark, sf_dir), "kerbline_fact_view")
    return spark.sql("SELECT pickup_hour, COUNT(*) AS trips FROM kerbline_fact_view GROUP BY pickup_hour")


@query("SNK-4_ensure_table", "SELECT * FROM orders")
def ensure_table(spark, sf_dir):
    """An empty table made from the schema of a query takes exactly that query's rows."""
    run = "kerbline_snk_4"
    path = _place(spark, run)
    orders = feeds.table(spark, sf_dir, "orders")
    tables.ensure_table_like(orders, run, path)
    orders.write.insertInto(run)
    return tables.ensure_table_like(orders, run, path)


_LAYER_TABLES = dict(zip(tables.LAYERS, ("region", "nation", "customer", "supplier", "part", "orders")))


@query("SNK-5_layer_namespaces", o.check_rows(
    f"SELECT '{layer}' AS layer, '{t}' AS table_name, COUNT(*) AS rows_stored FROM {t}" for layer, t in _LAYER_TABLES.items()))
def layer_namespaces(spark, sf_dir):
    """Every layer is created under a prefix and takes a table, which is read back by its name."""
    prefix = "kerbline_snk_5_"
    tables.ensure_schemas(spark, prefix=prefix)
    counts = []
    for layer, table in _LAYER_TABLES.items():
        name = f"{prefix}{layer}.{table}"
        stored = tables.write_table(feeds.table(spark, sf_dir, table), name, path=_place(spark, name))
        counts.append(stored.agg(F.count(F.lit(1)).alias("rows_stored")).select(
            F.lit(layer).alias("layer"), F.lit(table).alias("table_name"), "rows_stored"))
    return dedup.union_by_name(counts)


@query("SNK-7_row_guard", "SELECT o_orderstatus, COUNT(*) AS orders FROM orders GROUP BY o_orderstatus")
def row_guard(spark, sf_dir):
    orders = tables.require_rows(feeds.table(spark, sf_dir, "orders"), "no orders landed")
    return orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"))


@query("SNK-6_load_report", o.statement("""
SELECT batch_id, COUNT(*) AS rows_loaded, MIN(scraped_at_iso) AS first_time, MAX(scraped_at_iso) AS last_time
FROM advisories GROUP BY batch_id""", "advisories"))
def load_report(spark, sf_dir):
    return tables.load_report(feeds.advisories_raw(spark, sf_dir), time_col="scraped_at_iso")


@query("SNK-8_preview", """
SELECT event_id, ts, value FROM events ORDER BY value DESC, event_id LIMIT 20""")
def preview(spark, sf_dir):
    events = feeds.table(spark, sf_dir, "events").select("event_id", "ts", "value")
    return tables.preview(events, (F.desc("value"), "event_id"))


# --- text extraction ------------------------------------------------------------------------


@query("TXT-1_page_blocks", o.statement("SELECT page_id, pos, tag, block_id, text FROM blocks", "blocks"))
def page_blocks(spark, sf_dir):
    return text.exploded_blocks(text.page_blocks(feeds.pages_marked(spark, sf_dir)), "page_id")


@query("TXT-2_sections", o.statement("""
SELECT page_id, CAST(section_no AS INTEGER) AS section_no, MIN(section_id) AS section_id,
       MIN(section_name) AS section_name, CAST(COUNT(*) - 1 AS INTEGER) AS n_blocks
FROM carried GROUP BY page_id, section_no""", "carried"))
def sections(spark, sf_dir):
    cut = text.with_section(text.page_blocks(feeds.pages_marked(spark, sf_dir)))
    return cut.select("page_id", "section_no", "section_id", "section_name", F.size("blocks").alias("n_blocks"))


def _locations(spark, sf_dir):
    return text.with_location(text.with_section(text.page_blocks(feeds.pages_marked(spark, sf_dir))))


@query("TXT-3_locations", o.statement("""
SELECT page_id, CAST(section_no AS INTEGER) AS section_no, CAST(location_no AS INTEGER) AS location_no,
       MIN(location_name) AS location_name, CAST(COUNT(*) - 1 AS INTEGER) AS n_blocks
FROM carried WHERE location_no > 0 GROUP BY page_id, section_no, location_no""", "carried"))
def locations(spark, sf_dir):
    return _locations(spark, sf_dir).select(
        "page_id", "section_no", "location_no", "location_name", F.size("blocks").alias("n_blocks")
    )


@query("TXT-4_labels", o.statement("""
SELECT page_id, pos, open_label FROM placed WHERE NOT is_label""", "placed"))
def labels(spark, sf_dir):
    return text.with_label(_locations(spark, sf_dir)).select("page_id", "open_label", F.inline("blocks")).select(
        "page_id", "pos", "open_label"
    )


@query("TXT-5_entry_type", o.statement("""
SELECT page_id, pos, entry_type FROM placed WHERE NOT is_label""", "placed"))
def entry_type(spark, sf_dir):
    return text.with_entry_type(text.with_label(_locations(spark, sf_dir))).select("page_id", "pos", "entry_type")


@query("TXT-6_noise", o.statement("""
SELECT page_id, pos, tag, text FROM placed
WHERE NOT is_label AND text <> '' AND (tag = 'li' OR text NOT LIKE '*Note%')""", "placed"))
def noise(spark, sf_dir):
    rows = text.with_entry_type(text.with_label(_locations(spark, sf_dir)))
    return text.drop_noise(rows).select("page_id", "pos", "tag", "text")


@query("TXT-7_date_mentions", o.statement(f"""
SELECT page_id, pos, CAST(len(d) AS INTEGER) AS n_dates, d[1] AS first_date, d[-1] AS last_date
FROM (SELECT *, {o.dates_in('text')} AS d FROM blocks)""", "blocks"))
def mentions(spark, sf_dir):
    blocks = text.exploded_blocks(text.page_blocks(feeds.pages_marked(spark, sf_dir)), "page_id")
    return blocks.withColumn("_d", date_mentions("text")).select(
        "page_id", "pos", F.size("_d").alias("n_dates"),
        first_mention(F.col("_d")).alias("first_date"), last_mention(F.col("_d")).alias("last_date"),
    )


@query("TXT-8_week", o.statement("SELECT * FROM weeks", "weeks"))
def week(spark, sf_dir):
    blocks = text.page_blocks(feeds.pages_marked(spark, sf_dir))
    return text.with_week(blocks).select("page_id", "advisory_week_text", "advisory_week_start", "advisory_week_end")


@query("TXT-9_segments", o.statement(f"""
SELECT page_id, pos, CASE WHEN {o._split} THEN trim(regexp_extract(text, '{o.STREET_SEGMENT}', 1)) ELSE text END AS street,
       CASE WHEN {o._split} THEN trim(regexp_extract(text, '{o.STREET_SEGMENT}', 2)) END AS from_street,
       CASE WHEN {o._split} THEN trim(regexp_extract(text, '{o.STREET_SEGMENT}', 3)) END AS to_street
FROM blocks WHERE tag = 'li'""", "blocks"))
def segments(spark, sf_dir):
    items = text.exploded_blocks(text.page_blocks(feeds.pages_marked(spark, sf_dir)), "page_id").filter("tag = 'li'")
    return items.select("page_id", "pos", split_segment("text").alias("_s")).select("page_id", "pos", "_s.*")


@query("TXT-10_link_items", o.statement(f"""
SELECT page_id, pos, text FROM placed WHERE tag = 'li' AND (open_label IS NOT NULL OR {o._split})""", "placed"))
def link_items(spark, sf_dir):
    rows = text.with_entry_type(text.with_label(_locations(spark, sf_dir)))
    return text.drop_link_items(rows).filter("tag = 'li'").select("page_id", "pos", "text")


@query("TXT-11_page_shape", o.statement("""
SELECT w.page_id, coalesce(s.n, 0) AS sections, coalesce(e.locations, 0) AS locations, coalesce(e.entries, 0) AS entries,
       coalesce(e.split, 0) AS segments_split, w.advisory_week_start AS week_start, w.advisory_week_end AS week_end
FROM weeks w
LEFT JOIN (SELECT page_id, COUNT(DISTINCT section_no) AS n FROM carried GROUP BY 1) s ON s.page_id = w.page_id
LEFT JOIN (SELECT page_id, COUNT(DISTINCT location_name) AS locations, COUNT(*) AS entries, COUNT(from_street) AS split
           FROM page_entries GROUP BY 1) e ON e.page_id = w.page_id""", "page_entries", "carried"))
def page_shape(spark, sf_dir):
    return text.page_shape(feeds.pages_marked(spark, sf_dir))


# --- keys, dedup, history ---------------------------------------------------------------------

_ENTRY_KEYS = ("scrape_date", "section_id", "location_name", "detail_label", "advisory_text", "scraped_at_iso")


@query("KEY-1_sighting_key", o.statement(
    f"SELECT {', '.join(_ENTRY_KEYS)}, advisory_sk FROM entries", "entries"))
def key_sighting(spark, sf_dir):
    return feeds.scrape_entries(spark, sf_dir).select(*_ENTRY_KEYS, sighting_key().alias("advisory_sk"))


@query("KEY-2_advisory_key", o.statement(
    f"SELECT {', '.join(_ENTRY_KEYS)}, {o._BK} AS closure_bk FROM entries", "entries"))
def key_advisory(spark, sf_dir):
    return feeds.scrape_entries(spark, sf_dir).select(*_ENTRY_KEYS, advisory_key().alias("closure_bk"))


@query("KEY-3_dedup_scrape", o.statement("SELECT * FROM advisories", "advisories"))
def dedup_scrape(spark, sf_dir):
    return feeds.advisories_raw(spark, sf_dir)


@query("KEY-3_dedup_order_lines", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey, l_suppkey,
    l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem) WHERE rn = 1""")
def dedup_order_lines(spark, sf_dir):
    order = (F.desc("l_shipdate"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
             "l_returnflag", "l_linestatus")
    return dedup.dedup_latest(feeds.table(spark, sf_dir, "lineitem"), ("l_orderkey", "l_linenumber"), order)


_OLD = "2024-01-15"


@query("HIST-1_insert_new", o.statement("SELECT * FROM advisories", "advisories"))
def insert_new(spark, sf_dir):
    """Scrapes up to a date are held; all scrapes are loaded on top, twice."""
    landed = feeds.advisories_raw(spark, sf_dir)
    held = landed.filter(F.col("scrape_date") <= _OLD)
    once = hist.insert_new(held, landed, "advisory_sk")
    return hist.insert_new(once, landed, "advisory_sk")


@query("HIST-2_latest_batch", o.statement(
    "SELECT * FROM advisories WHERE scrape_date = (SELECT MAX(scrape_date) FROM advisories)", "advisories"))
def latest_batch(spark, sf_dir):
    return hist.latest_batch(feeds.advisories_raw(spark, sf_dir))


@query("HIST-3_stage", o.statement("SELECT * FROM sightings", "sightings"))
def stage(spark, sf_dir):
    return hist.stage_history(feeds.advisories_raw(spark, sf_dir))


@query("HIST-4_apply_sightings", o.statement("SELECT * FROM history", "history"))
def apply_sightings(spark, sf_dir):
    """Early scrapes built in one go, later ones applied on top, then all applied again."""
    seen = feeds.sightings(spark, sf_dir)
    early = hist.rebuild_history(seen.filter(F.col("scrape_dt") < _OLD))
    return hist.apply_sightings(early, seen).drop("ingested_at")


@query("HIST-4_late_scrapes", o.statement("SELECT * FROM history", "history"))
def late_scrapes(spark, sf_dir):
    """Late scrapes first, the early ones land behind them, one day again: the state does not depend on the order."""
    seen = feeds.sightings(spark, sf_dir)
    held = states.merge_state(states.empty_state(spark), seen.filter(F.col("scrape_dt") >= _OLD))
    held = states.merge_state(held, seen.filter(F.col("scrape_dt") < _OLD))
    return states.as_history(states.merge_state(held, hist.latest_batch(seen, "scrape_dt"))).drop("ingested_at")


@query("HIST-4_cell_upsert", o.statement("SELECT * FROM history", "history"))
def cell_upsert(spark, sf_dir):
    """Late scrapes stored in cells, the early ones merged into them, the newest one again."""
    seen = feeds.sightings(spark, sf_dir)
    name = "kerbline_hist_4_cells"
    spark.sql(f"DROP VIEW IF EXISTS {name}")
    cells = CellTable(spark, name, _place(spark, f"{name}_files"), hist.KEY, "is_current", 16)
    for part in (seen.filter(F.col("scrape_dt") >= _OLD), seen.filter(F.col("scrape_dt") < _OLD), hist.latest_batch(seen, "scrape_dt")):
        streaming.merge_sightings(cells, part)
    return states.as_history(cells.read()).drop("ingested_at")


@query("HIST-5_close_missing", o.statement("SELECT closure_bk, is_current FROM history", "history"))
def close_missing(spark, sf_dir):
    held = feeds.history(spark, sf_dir)
    reopened = held.withColumn("is_current", F.lit(True))
    latest = held.agg(F.max("last_seen_scrape").alias("d")).scalar()
    return hist.close_missing(reopened, latest).select("closure_bk", "is_current")


@query("HIST-6_rebuild", o.statement("SELECT * FROM history", "history"))
def rebuild(spark, sf_dir):
    return feeds.history(spark, sf_dir).drop("ingested_at")


@query("HIST-7_summary", o.statement("""
SELECT COUNT(*) AS rows_total, COUNT(*) FILTER (WHERE is_current) AS rows_current,
       COUNT(DISTINCT first_seen_scrape) AS scrapes_held FROM history""", "history"))
def summary(spark, sf_dir):
    return hist.history_summary(feeds.history(spark, sf_dir))


@query("HIST-8_scrape_report", o.statement("""
SELECT scrape_date, COUNT(*) AS rows_landed, COUNT(DISTINCT advisory_sk) AS distinct_keys,
       COUNT(DISTINCT location_name) AS locations FROM advisories GROUP BY scrape_date""", "advisories"))
def scrape_report(spark, sf_dir):
    return hist.scrape_report(feeds.advisories_raw(spark, sf_dir))


@query("HIST-8_idempotency", o.statement("""
SELECT 'raw rows per scrape date' AS measure, scrape_date AS grouping, COUNT(*) AS rows_held,
       COUNT(DISTINCT advisory_sk) AS distinct_keys FROM advisories GROUP BY scrape_date
UNION ALL
SELECT 'clean rows by times_seen', CAST(times_seen AS VARCHAR), COUNT(*), COUNT(DISTINCT closure_bk)
FROM history GROUP BY times_seen""", "history", "advisories"))
def idempotency(spark, sf_dir):
    return hist.idempotency_report(feeds.advisories_raw(spark, sf_dir), feeds.history(spark, sf_dir))


@query("HIST-9_shown_as_of", o.statement(f"""
SELECT * FROM advisories
WHERE scrape_date = (SELECT MAX(scrape_date) FROM advisories WHERE scrape_date <= '{feeds.AS_OF}')""", "advisories"))
def shown_as_of(spark, sf_dir):
    return hist.shown_as_of(feeds.advisories_raw(spark, sf_dir), feeds.AS_OF)


@query("HIST-9_history_as_of", o.statement(f"""
SELECT * FROM history WHERE DATE '{feeds.AS_OF}' BETWEEN first_seen_scrape AND last_seen_scrape""", "history"))
def history_as_of(spark, sf_dir):
    return hist.history_as_of(feeds.history(spark, sf_dir), feeds.AS_OF).drop("ingested_at")


@query("HIST-9_current_only", o.statement("SELECT * FROM history WHERE is_current", "history"))
def current_only(spark, sf_dir):
    return hist.current_only(feeds.history(spark, sf_dir)).drop("ingested_at")


_SCRAPES = "SELECT scrape_dt, lag(scrape_dt) OVER (ORDER BY scrape_dt) AS before_dt FROM (SELECT DISTINCT scrape_dt FROM sightings)"


@query("HIST-9_validity", o.statement(f"""
SELECT f.closure_bk, f.scrape_dt AS valid_from, f.valid_to,
       (SELECT COUNT(*) FROM sightings s WHERE s.closure_bk = f.closure_bk AND s.scrape_dt >= f.scrape_dt
        AND (f.valid_to IS NULL OR s.scrape_dt < f.valid_to)) AS scrapes
FROM (SELECT s.closure_bk, s.scrape_dt, (
        SELECT MIN(d.scrape_dt) FROM (SELECT DISTINCT scrape_dt FROM sightings) d WHERE d.scrape_dt > s.scrape_dt
        AND NOT EXISTS (SELECT 1 FROM sightings x WHERE x.closure_bk = s.closure_bk AND x.scrape_dt = d.scrape_dt)) AS valid_to
      FROM sightings s JOIN ({_SCRAPES}) d USING (scrape_dt)
      WHERE NOT EXISTS (SELECT 1 FROM sightings p WHERE p.closure_bk = s.closure_bk AND p.scrape_dt = d.before_dt)) f""", "sightings"))
def validity(spark, sf_dir):
    return states.validity(states.merge_state(states.empty_state(spark), feeds.sightings(spark, sf_dir)))


@query("HIST-9_asked", o.statement("""
SELECT a.closure_bk, a.day, EXISTS (
  SELECT 1 FROM sightings s WHERE s.closure_bk = a.closure_bk
  AND s.scrape_dt = (SELECT MAX(scrape_dt) FROM sightings WHERE scrape_dt <= a.day)) AS shown
FROM (SELECT DISTINCT closure_bk, CAST(scrape_dt + CAST(k AS INTEGER) AS DATE) AS day
      FROM sightings, (VALUES (-1), (0), (3), (9), (200)) v(k)) a""", "sightings"))
def asked(spark, sf_dir):
    """Around each sighting: whether the page showed the advisory the day before, then, and some days after."""
    seen = feeds.sightings(spark, sf_dir)
    intervals = states.validity(states.merge_state(states.empty_state(spark), seen))
    asks = seen.select("closure_bk", F.expr("explode(transform(array(-1, 0, 3, 9, 200), k -> date_add(scrape_dt, k)))").alias("day")).distinct()
    return states.asked(intervals, asks)


# --- cleaning ---------------------------------------------------------------------------------

_DOUBLES = ("RatecodeID", "passenger_count", "trip_distance", "fare_amount", "extra", "mta_tax", "tip_amount", "tolls_amount",
            "ehail_fee", "improvement_surcharge", "total_amount", "payment_type", "trip_type", "congestion_surcharge",
            "cbd_congestion_fee")
_RAW_COLUMNS = ", ".join((
    "VendorID", "lpep_pickup_datetime", "lpep_dropoff_datetime", "store_and_fwd_flag",
    "CAST(PULocationID AS INTEGER) AS PULocationID", "CAST(DOLocationID AS INTEGER) AS DOLocationID",
    *(f"CAST({c} AS DOUBLE) AS {c}" for c in _DOUBLES)))


@query("CLN-1_union_months", o.statement(f"SELECT {_RAW_COLUMNS} FROM trips_raw", "trips_raw"))
def union_months(spark, sf_dir):
    return clean.union_months(feeds.trip_months(spark, sf_dir))


@query("CLN-1_evolved_months", """
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_quantity AS DOUBLE) AS l_quantity, CASE WHEN l_linenumber % 3 = 1 THEN NULL ELSE l_tax END AS l_tax,
       CAST(l_partkey AS BIGINT) AS l_partkey, CASE WHEN l_linenumber % 3 = 2 THEN l_shipdate END AS l_shipdate
FROM lineitem""")
def evolved_months(spark, sf_dir):
    """Order lines in three batches of different types and columns."""
    lines = feeds.table(spark, sf_dir, "lineitem")
    part = lambda k, *columns: lines.filter(f"l_linenumber % 3 = {k}").selectExpr(*columns)
    return evolution.union_evolved([
        part(0, "l_orderkey", "CAST(l_quantity AS INT) AS l_quantity", "l_tax", "l_partkey"),
        part(1, "CAST(l_orderkey AS STRING) AS l_orderkey", "l_quantity", "CAST(l_partkey AS INT) AS l_partkey"),
        part(2, "CAST(l_orderkey AS INT) AS L_ORDERKEY", "CAST(l_quantity AS SMALLINT) AS l_quantity", "l_tax", "l_partkey", "l_shipdate"),
    ])


@query("CLN-2_duration", o.statement("SELECT *, minutes AS trip_duration_min FROM trips_timed".replace(
    "*", "lpep_pickup_datetime, lpep_dropoff_datetime"), "trips_timed"))
def duration(spark, sf_dir):
    return clean.with_duration(feeds.trips_raw(spark, sf_dir)).select(
        "lpep_pickup_datetime", "lpep_dropoff_datetime", "trip_duration_min")


@query("CLN-3_hard_excludes", o.statement(f"SELECT {_RAW_COLUMNS} FROM trips_excluded", "trips_excluded"))
def hard_excludes(spark, sf_dir):
    return clean.hard_excludes(feeds.trips_raw(spark, sf_dir), *feeds.WINDOW)[1]


@query("CLN-4_kept_trips", o.statement(f"SELECT {_RAW_COLUMNS} FROM trips_kept", "trips_kept"))
def kept_trips(spark, sf_dir):
    return clean.hard_excludes(feeds.trips_raw(spark, sf_dir), *feeds.WINDOW)[0]


@query("CLN-5_typed_trips", o.statement("SELECT * FROM trips_typed", "trips_typed"))
def typed_trips(spark, sf_dir):
    kept, _ = clean.hard_excludes(clean.with_duration(feeds.trips_raw(spark, sf_dir)), *feeds.WINDOW)
    return clean.apply_types(kept)


@query("CLN-6_flags", o.statement("SELECT * FROM trips", "trips"))
def flags(spark, sf_dir):
    return feeds.trips(spark, sf_dir)


@query("CLN-7_for_measure", o.statement("""
SELECT 'flows' AS measure, COUNT(*) AS trips FROM trips WHERE NOT flag_no_real_dropoff
UNION ALL SELECT 'distance', COUNT(*) FROM trips WHERE NOT flag_no_real_dropoff
UNION ALL SELECT 'speed', COUNT(*) FROM trips WHERE NOT flag_no_real_dropoff AND NOT flag_zero_duration_nonzero_distance
UNION ALL SELECT 'duration', COUNT(*) FROM trips WHERE NOT flag_zero_duration_nonzero_distance
UNION ALL SELECT 'revenue', COUNT(*) FROM trips WHERE NOT flag_negative_fare
UNION ALL SELECT 'tips', COUNT(*) FROM trips WHERE NOT flag_negative_tip
UNION ALL SELECT 'passengers', COUNT(*) FROM trips WHERE NOT flag_zero_passengers AND NOT flag_vendor6_incomplete
UNION ALL SELECT 'metadata', COUNT(*) FROM trips WHERE NOT flag_vendor6_incomplete""", "trips"))
def for_measure(spark, sf_dir):
    trips = feeds.trips(spark, sf_dir)
    return clean.measure_counts(trips)


@query("CLN-8_weather", o.statement("SELECT * FROM place_weather", "place_weather"))
def weather(spark, sf_dir):
    return clean.clean_weather(feeds.weather_raw(spark, sf_dir, by_place=True))


@query("CLN-9_zones", o.statement("SELECT * FROM zones", "zones"))
def zones(spark, sf_dir):
    return clean.clean_zones(feeds.zones_raw(spark, sf_dir))


@query("CLN-10_advisory_clean", o.statement("SELECT * FROM history", "history"))
def advisory_clean(spark, sf_dir):
    """All scrapes that landed after an early merge are merged together, then nothing is pending."""
    raw = feeds.advisories_raw(spark, sf_dir)
    early = hist.rebuild_history(hist.stage_history(raw.filter(F.col("scrape_date") < _OLD), unique=True))
    merged = hist.apply_sightings(early, hist.stage_history(hist.pending_scrapes(raw, early), unique=True))
    return merged.drop("ingested_at")


# --- mart -------------------------------------------------------------------------------------


@query("DIM-1_dim_advisory", o.statement("SELECT * FROM dim_advisory", "dim_advisory"))
def dim_advisory(spark, sf_dir):
    return feeds.advisory_dim(spark, sf_dir)


@query("DIM-2_dim_date", o.statement("SELECT * FROM dim_date", "dim_date"))
def dim_date(spark, sf_dir):
    return feeds.date_dim(spark, sf_dir)


@query("DIM-3_dim_weather", o.statement("SELECT * FROM dim_weather", "dim_weather"))
def dim_weather(spark, sf_dir):
    return feeds.weather_dim(spark, sf_dir)


_FOLDED = ", ".join(
    f"{o.rounded(f'AVG(CAST({m} AS DECIMAL(18,4)))')} AS {m}"
    for m in ("temperature_2m", "precipitation", "rain", "snowfall", "wind_speed_10m"))


@query("DIM-3_dim_weather_folded", o.statement(f"""
SELECT date_hour_key, observation_date, observation_hour, {_FOLDED}, CAST(MAX(weather_code) AS INTEGER) AS weather_code
FROM (SELECT w.*, {o.hour_key('observation_time')} AS date_hour_key, CAST(observation_time AS DATE) AS observation_date,
             CAST(hour(observation_time) AS INTEGER) AS observation_hour FROM place_weather w)
GROUP BY 1, 2, 3""", "place_weather"))
def dim_weather_folded(spark, sf_dir):
    several = clean.clean_weather(feeds.weather_raw(spark, sf_dir, by_place=True))
    return mart.dim_weather(several, average_locations=True)


@query("DIM-4_dim_zone", o.statement("SELECT * FROM dim_zone", "dim_zone"))
def dim_zone(spark, sf_dir):
    return feeds.zone_dim(spark, sf_dir)


@query("DIM-5_date_hour_key", f"""
SELECT date_hour_key, COUNT(*) AS events FROM (SELECT {o.hour_key('ts')} AS date_hour_key FROM events) GROUP BY 1""")
def hour_keys(spark, sf_dir):
    events = feeds.table(spark, sf_dir, "events")
    return events.groupBy(date_hour_key("ts").alias("date_hour_key")).agg(F.count(F.lit(1)).alias("events"))


@query("FCT-1_fact_trip", o.statement("SELECT * FROM fact", "fact"))
def fact_trip(spark, sf_dir):
    return feeds.fact(spark, sf_dir)


# --- BI ---------------------------------------------------------------------------------------


def _flows_sql(fact: str) -> str:
    return f"""
SELECT pz.borough AS pickup_borough, dz.borough AS dropoff_borough, COUNT(*) AS total_trips,
       {o.total('trip_distance')} AS total_distance_miles, {o.total('total_amount')} AS total_revenue
FROM {fact} f JOIN dim_zone pz ON f.pu_location_id = pz.location_id JOIN dim_zone dz ON f.do_location_id = dz.location_id
GROUP BY pz.borough, dz.borough"""


def _zones_sql(fact: str) -> str:
    return f"""
SELECT borough AS pickup_borough, zone AS pickup_zone, COUNT(*) AS total_trips,
       {o.mean('trip_distance')} AS avg_trip_distance_miles, {o.total('total_amount')} AS total_revenue
FROM {fact} JOIN dim_zone ON pu_location_id = location_id GROUP BY borough, zone"""


@query("BI-1a_borough_flows", o.statement(_flows_sql("fact"), "fact", "dim_zone"))
def borough_flows(spark, sf_dir):
    return bi.borough_flows(feeds.fact(spark, sf_dir), feeds.zone_dim(spark, sf_dir))


def _order_fact(spark, sf_dir):
    return mart.fact_trip(feeds.order_trips(spark, sf_dir), 1440.0, 1440.0 * 180)


@query("BI-1a_borough_flows_orders", o.statement(_flows_sql("order_fact"), "order_fact", "dim_zone"))
def borough_flows_orders(spark, sf_dir):
    return bi.borough_flows(_order_fact(spark, sf_dir), feeds.zone_dim(spark, sf_dir))


@query("BI-1b_pickup_zones", o.statement(_zones_sql("fact"), "fact", "dim_zone"))
def pickup_zones(spark, sf_dir):
    return bi.top_pickup_zones(feeds.fact(spark, sf_dir), feeds.zone_dim(spark, sf_dir))


@query("BI-1b_top_pickup_zones_orders", o.statement(
    _zones_sql("order_fact") + " ORDER BY total_trips DESC, pickup_borough NULLS FIRST, pickup_zone NULLS FIRST LIMIT 10",
    "order_fact", "dim_zone"))
def top_pickup_zones_orders(spark, sf_dir):
    return bi.top_pickup_zones(_order_fact(spark, sf_dir), feeds.zone_dim(spark, sf_dir), k=10)


@query("BI-2_temporal_patterns", o.statement(f"""
SELECT f.pickup_hour, d.is_weekend, COUNT(*) AS total_trips, CAST(SUM(passenger_count) AS BIGINT) AS total_passengers,
       {o.mean('trip_duration_min')} AS avg_duration_minutes, {o.mean('fare_amount')} AS avg_fare_amount
FROM fact f JOIN dim_date d ON f.pickup_date_hour_key = d.date_hour_key
GROUP BY f.pickup_hour, d.is_weekend""", "fact", "dim_date"))
def temporal_patterns(spark, sf_dir):
    return bi.temporal_patterns(feeds.fact(spark, sf_dir), feeds.date_dim(spark, sf_dir))


_CONDITION = """CASE WHEN snowfall > 0 THEN 'Snow' WHEN precipitation > 0 THEN 'Rain/Precipitation' ELSE 'Clear/Dry' END"""


@query("BI-3_weather_impact", o.statement(f"""
SELECT {_CONDITION} AS weather_condition,
       {o.rounded('CAST(SUM(CAST(temperature_2m AS DECIMAL(18,4))) AS DOUBLE) / NULLIF(COUNT(temperature_2m), 0)', 1)} AS avg_temperature_c,
       COUNT(*) AS total_trips, {o.mean('trip_distance')} AS avg_distance_miles,
       {o.mean('trip_duration_min')} AS avg_duration_minutes
FROM fact JOIN dim_weather ON pickup_date_hour_key = date_hour_key GROUP BY 1""", "fact", "dim_weather"))
def weather_impact(spark, sf_dir):
    return bi.weather_impact(feeds.fact(spark, sf_dir), feeds.weather_dim(spark, sf_dir))


def _advisory_sql(end: str) -> str:
    return f"""
SELECT borough, coalesce(picked_type, 'None') AS advisory_type, COUNT(*) AS total_trips,
       {o.mean('trip_duration_min')} AS avg_duration_minutes, {o.mean('total_amount')} AS avg_total_fare
FROM (SELECT z.borough, f.trip_duration_min, f.total_amount, a.advisory_type AS picked_type,
             ROW_NUMBER() OVER (PARTITION BY f.pu_location_id, f.do_location_id, f.pickup_datetime, f.dropoff_datetime
               ORDER BY a.effective_from DESC NULLS LAST, a.advisory_id, f.total_amount NULLS FIRST, f.trip_duration_min) AS pos
      FROM fact f JOIN dim_zone z ON f.pu_location_id = z.location_id
      LEFT JOIN dim_advisory a ON lower(trim(a.borough)) = lower(trim(z.borough))
           AND f.pickup_datetime >= a.effective_from AND f.pickup_datetime {end})
WHERE pos = 1 GROUP BY borough, picked_type"""


@query("BI-4_advisory_impact", o.statement(_advisory_sql("<= a.effective_to"), "fact", "dim_zone", "dim_advisory"))
def advisory_impact(spark, sf_dir):
    return bi.advisory_impact(
        feeds.fact(spark, sf_dir), feeds.zone_dim(spark, sf_dir), feeds.advisory_dim(spark, sf_dir), days=feeds.WINDOW)


@query("BI-4_advisory_impact_whole_days", o.statement(
    _advisory_sql("< a.effective_to + INTERVAL 1 DAY"), "fact", "dim_zone", "dim_advisory"))
def advisory_impact_whole_days(spark, sf_dir):
    return bi.advisory_impact(
        feeds.fact(spark, sf_dir), feeds.zone_dim(spark, sf_dir), feeds.advisory_dim(spark, sf_dir), inclusive_end=True)


@query("BI-5_kpi_summary", o.statement(f"""
SELECT COUNT(*) AS total_trips, CAST(SUM(passenger_count) AS BIGINT) AS total_passengers,
       {o.total('total_amount')} AS total_revenue_usd, {o.mean('fare_amount')} AS avg_fare_usd,
       {o.mean('trip_distance')} AS avg_distance_miles, {o.mean('trip_duration_min')} AS avg_duration_minutes,
       {o.rounded(f"CAST(SUM({o.exact('total_amount')}) AS DOUBLE) / NULLIF(CAST(SUM({o.exact('trip_distance')}) AS DOUBLE), 0)")} AS revenue_per_mile
FROM fact""", "fact"))
def kpi_summary(spark, sf_dir):
    return bi.kpi_summary(feeds.fact(spark, sf_dir))


@query("BI-5_kpi_by_day", o.statement(f"""
SELECT COUNT(*) AS total_trips, CAST(SUM(passenger_count) AS BIGINT) AS total_passengers,
       {o.total('total_amount')} AS total_revenue_usd, {o.mean('fare_amount')} AS avg_fare_usd,
       {o.mean('trip_distance')} AS avg_distance_miles, {o.mean('trip_duration_min')} AS avg_duration_minutes,
       {o.rounded(f"CAST(SUM({o.exact('total_amount')}) AS DOUBLE) / NULLIF(CAST(SUM({o.exact('trip_distance')}) AS DOUBLE), 0)")} AS revenue_per_mile
FROM fact""", "fact"))
def kpi_by_day(spark, sf_dir):
    """The fact stored by day, reduced to daily partial sums; some days' files are written later and refreshed alone."""
    name = "kerbline_bi_daily"
    home = _place(spark, f"{name}_fact")
    for kind in ("pairs", "hours"):
        _place(spark, f"{name}_{kind}")
    daily = DailyBI(spark, name, _place(spark, f"{name}_sums"))
    rows = feeds.fact(spark, sf_dir).withColumn(DAY, F.to_date("pickup_datetime"))
    for some in (F.dayofmonth(DAY) % 5 != 0, F.dayofmonth(DAY) % 5 == 0):
        rows.filter(some).repartition(DAY).write.mode("append").partitionBy(DAY).parquet(home)
        daily.refresh(spark.read.parquet(home))
    return daily.kpi_summary()


@query("BI-6_endpoint_weather", o.statement(f"""
SELECT f.*, pz.borough AS pickup_borough, dz.borough AS dropoff_borough,
       pw.weather_condition AS pickup_condition, pw.temperature_2m AS pickup_temperature,
       dw.weather_condition AS dropoff_condition, dw.temperature_2m AS dropoff_temperature
FROM fact f
LEFT JOIN dim_zone pz ON pu_location_id = pz.location_id LEFT JOIN dim_zone dz ON do_location_id = dz.location_id
LEFT JOIN (SELECT *, {_CONDITION} AS weather_condition FROM dim_place_weather) pw ON lower(pw.borough) = lower(pz.borough)
     AND pw.observation_date = CAST(f.pickup_datetime AS DATE) AND pw.observation_hour = f.pickup_hour
LEFT JOIN (SELECT *, {_CONDITION} AS weather_condition FROM dim_place_weather) dw ON lower(dw.borough) = lower(dz.borough)
     AND dw.observation_date = CAST(f.dropoff_datetime AS DATE) AND dw.observation_hour = f.dropoff_hour""",
    "fact", "dim_zone", "dim_place_weather"))
def endpoint_weather(spark, sf_dir):
    return bi.endpoint_weather(
        feeds.fact(spark, sf_dir), feeds.zone_dim(spark, sf_dir), feeds.place_weather_dim(spark, sf_dir))


# --- profiling --------------------------------------------------------------------------------


def _profile_sql(table: str, columns: dict[str, str], rows: str | None = None) -> str:
    rows = rows or table

    def one(column: str, kind: str) -> str:
        return f"""
SELECT '{table}' AS table_name, '{column}' AS column_name, '{kind}' AS data_type, COUNT(*) AS total_rows,
       COUNT(*) - COUNT({column}) AS null_count,
       {o.rounded(f'100.0 * (COUNT(*) - COUNT({column})) / NULLIF(COUNT(*), 0)')} AS null_percentage,
       COUNT(DISTINCT {column}) AS distinct_count,
       {o.rounded(f'100.0 * COUNT(DISTINCT {column}) / NULLIF(COUNT(*), 0)')} AS distinct_percentage,
       CAST(MIN({column}) AS VARCHAR) AS min_value, CAST(MAX({column}) AS VARCHAR) AS max_value,
       (SELECT CAST({column} AS VARCHAR) FROM {rows} WHERE {column} IS NOT NULL GROUP BY {column}
        ORDER BY COUNT(*) DESC, {column} LIMIT 1) AS most_common_value
FROM {rows}"""

    return "\nUNION ALL\n".join(one(c, t) for c, t in columns.items())


_COLUMNS = {
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double",
                 "c_mktsegment": "string"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
    "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int",
             "p_retailprice": "double"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
               "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"},
    "lineitem": {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
                 "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
                 "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"},
    "events": {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
               "value": "double", "props": "string"},
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
    "embeddings": {"vec_id": "bigint", "embedding": "array<int>", "label": "int"},
    "pages": {"page_id": "bigint", "url": "string", "html": "string"},
    "benchmark": {"item_id": "bigint", "text": "string"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
    "conversations": {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"},
}
#: Vectors are profiled in whole thousandths, which both engines spell alike.
_THOUSANDTHS = """(SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS INTEGER)) AS embedding
FROM embeddings)"""


@query("PRF-1_profile_lineitem", _profile_sql("lineitem", _COLUMNS["lineitem"]))
def profile_lineitem(spark, sf_dir):
    return profile.profile(feeds.table(spark, sf_dir, "lineitem"), "lineitem")


_SKETCHED = ("l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


@query("PRF-1_sketch_batches", "\nUNION ALL ".join(f"""
SELECT 'lineitem' AS table_name, '{c}' AS column_name, SUM(n) AS total_rows, SUM(n) FILTER (v IS NULL) IS NOT NULL AS has_nulls,
       COUNT(v) AS distinct_count, MAX(n) AS most_common_rows, CAST(MIN(v) AS VARCHAR) AS min_value, CAST(MAX(v) AS VARCHAR) AS max_value
FROM (SELECT {c} AS v, COUNT(*) AS n FROM lineitem GROUP BY 1)""" for c in _SKETCHED))
def sketch_batches(spark, sf_dir):
    """Order lines in four batches, each sketched by itself; columns of few values, for which merged sketches are exact."""
    lines = feeds.table(spark, sf_dir, "lineitem").select(*_SKETCHED)
    batches = [(f"batch {k}", lines.filter(f"l_linenumber % 4 = {k}")) for k in range(4)]
    found = profile_sketch.estimates(profile_sketch.sketch_batches(batches, "lineitem"))
    return found.select("table_name", "column_name", "total_rows", (F.col("null_count") > 0).alias("has_nulls"), "distinct_count",
                        "most_common_rows", "min_value", "max_value")


@query("PRF-2_profile_all", "\nUNION ALL\n".join(
    _profile_sql(t, c, _THOUSANDTHS if t == "embeddings" else None) for t, c in _COLUMNS.items()))
def profile_all(spark, sf_dir):
    """Every column of all fourteen tables."""
    frames = {t: feeds.table(spark, sf_dir, t) for t in _COLUMNS}
    frames["embeddings"] = frames["embeddings"].withColumn("embedding", F.transform(
        "embedding", lambda x: F.floor(x.cast("double") * 1000).cast("int")))
    return profile.profile_all(frames)


# --- data quality -----------------------------------------------------------------------------


@query("DQ-1_rule_engine", o.check_rows([
    o.check_row("l_shipdate", "Completeness", o._count("lineitem", "l_shipdate IS NULL"), o._count("lineitem"), "fail"),
    o.check_row("l_quantity", "Validity", o._count("lineitem", "l_quantity > 45"), o._count("lineitem"), "percent"),
    o.check_row("l_discount", "Accuracy", o._count("lineitem", "l_discount > 0.099"), o._count("lineitem"), "percent"),
    o.check_row("l_returnflag", "Validity", o._count("lineitem", "l_returnflag NOT IN ('A', 'N')"), o._count("lineitem"), "warn"),
]))
def rule_engine(spark, sf_dir):
    c = F.col
    return quality.run_checks(feeds.table(spark, sf_dir, "lineitem"), [
        quality.passes("l_shipdate", "Completeness", c("l_shipdate").isNotNull(), quality.FAIL_ON_ANY),
        quality.passes("l_quantity", "Validity", c("l_quantity") <= 45, quality.BY_PERCENT),
        quality.fails("l_discount", "Accuracy", c("l_discount") > 0.099, quality.BY_PERCENT),
        quality.passes("l_returnflag", "Validity", c("l_returnflag").isin("A", "N"), quality.WARN_ON_ANY),
    ])


@query("DQ-2_trip_checks", o.statement(o.check_rows(o.trip_check_rows()), "trips"))
def trip_checks(spark, sf_dir):
    return rules.trip_checks(feeds.trips(spark, sf_dir), *feeds.WINDOW)


_LINE_CHECKS = (
    quality.passes("l_quantity", "Validity", "l_quantity <= 45", quality.WARN_ON_ANY),
    quality.passes("l_discount", "Accuracy", "l_discount <= 0.09", quality.BY_PERCENT),
    quality.fails("l_tax", "Validity", "l_tax > 1", quality.FAIL_ON_ANY),
    quality.fails("l_shipdate", "Timeliness", "l_shipdate < TIMESTAMP_NTZ '1992-01-10'", quality.tolerated(3)),
)


@query("DQ-1_merged_batches", o.check_rows((
    o.check_row("l_quantity", "Validity", o._count("lineitem", "NOT l_quantity <= 45"), o._count("lineitem"), "warn"),
    o.check_row("l_discount", "Accuracy", o._count("lineitem", "NOT l_discount <= 0.09"), o._count("lineitem"), "percent"),
    o.check_row("l_tax", "Validity", o._count("lineitem", "l_tax > 1"), o._count("lineitem"), "fail"),
    o.check_row("l_shipdate", "Timeliness", o._count("lineitem", "l_shipdate < TIMESTAMP '1992-01-10'"), o._count("lineitem"), "tolerated"))))
def merged_checks(spark, sf_dir):
    """Order lines in four batches, whose check counts are added up."""
    lines = feeds.table(spark, sf_dir, "lineitem")
    states = [check_state.check_counts(lines.filter(f"l_linenumber % 4 = {k}"), _LINE_CHECKS, "lines", f"b{k}") for k in range(4)]
    return check_state.merged_results(dedup.union_by_name(states), _LINE_CHECKS)


@query("DQ-3_iqr_bounds", """
SELECT greatest(0.0, q1 - 1.5 * (q3 - q1)) AS lower, q3 + 1.5 * (q3 - q1) AS upper
FROM (SELECT quantile_disc(value, 0.25) AS q1, quantile_disc(value, 0.75) AS q3 FROM events)""")
def iqr_bounds(spark, sf_dir):
    return quality.iqr_bounds(feeds.table(spark, sf_dir, "events"), "value")


_RANKED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("DQ-3_order_statistics", "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {i} AS place, CAST(quantile_disc({c}, {share}) AS DOUBLE) AS value FROM lineitem"
    for c in _RANKED for i, share in enumerate((0.01, 0.25, 0.5, 0.75, 0.999))))
def order_statistics(spark, sf_dir):
    """Exact quantiles of four columns in one scan."""
    found = quality.order_statistics(feeds.table(spark, sf_dir, "lineitem"), _RANKED, (0.01, 0.25, 0.5, 0.75, 0.999))
    return found.select("column", F.posexplode("q").alias("place", "value"))


_COPIED = "(SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 7)"


@query("DQ-4_duplicate_rows", o.check_row(
    "ALL_COLUMNS", "Uniqueness", f"(SELECT COUNT(*) FROM {_COPIED}) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {_COPIED}))",
    o._count(_COPIED), "fail"))
def duplicate_rows(spark, sf_dir):
    """Whole order lines, some of which are there twice."""
    lines = feeds.table(spark, sf_dir, "lineitem")
    return quality.duplicate_rows(lines.union(lines.filter("l_linenumber = 7")))


@query("DQ-5_weather_checks", o.statement(o.check_rows(o.weather_check_rows("place_weather")), "place_weather"))
def weather_checks(spark, sf_dir):
    return rules.weather_checks(clean.clean_weather(feeds.weather_raw(spark, sf_dir, by_place=True)), NOW_SQL)


@query("DQ-6_zone_checks", o.statement(o.check_rows(o.zone_check_rows()), "zones"))
def zone_checks(spark, sf_dir):
    raw = feeds.zones_raw(spark, sf_dir)
    return rules.zone_checks(raw, clean.clean_zones(raw))


@query("DQ-7_advisory_checks", o.statement(o.check_rows(o.advisory_check_rows()), "history", "advisories"))
def advisory_checks(spark, sf_dir):
    return rules.advisory_checks(feeds.advisories_raw(spark, sf_dir), feeds.history(spark, sf_dir), TODAY_SQL)


@query("DQ-8_missing_keys", """
SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def missing_keys(spark, sf_dir):
    return quality.missing_keys(
        feeds.table(spark, sf_dir, "orders"), feeds.table(spark, sf_dir, "supplier"), "o_custkey", "s_suppkey")


@query("DQ-9_floor_check", o.check_rows([
    o.check_row("user_id", "Validity", "CASE WHEN (SELECT COUNT(DISTINCT user_id) FROM events) > 20 THEN 0 ELSE 1 END",
                "SELECT COUNT(DISTINCT user_id) FROM events", "percent"),
    o.check_row("event_type", "Validity", "CASE WHEN (SELECT COUNT(DISTINCT event_type) FROM events) > 20 THEN 0 ELSE 1 END",
                "SELECT COUNT(DISTINCT event_type) FROM events", "percent"),
]))
def floor_check(spark, sf_dir):
    events = feeds.table(spark, sf_dir, "events")
    return dedup.union_by_name([
        quality.floor_check(events, "user_id", 20, "user_id"),
        quality.floor_check(events, "event_type", 20, "event_type"),
    ])


_POLICY_SQL = f"""
SELECT l_returnflag, failed_rows, total_rows, {o._STATUS['fail']} AS strict, {o._STATUS['warn']} AS lenient,
       {o._STATUS['percent']} AS by_percent, {o._STATUS['placeholder']} AS placeholder, {o._STATUS['tolerated']} AS tolerated
FROM (SELECT l_returnflag, COUNT(*) FILTER (WHERE l_quantity > 48) AS failed_rows, COUNT(*) AS total_rows
      FROM lineitem GROUP BY 1)"""


@query("DQ-10_status_policies", _POLICY_SQL)
def status_policies(spark, sf_dir):
    counts = feeds.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count_if(F.col("l_quantity") > 48).alias("failed_rows"), F.count(F.lit(1)).alias("total_rows"))
    named = {
        "strict": quality.FAIL_ON_ANY, "lenient": quality.WARN_ON_ANY, "by_percent": quality.BY_PERCENT,
        "placeholder": quality.PLACEHOLDER, "tolerated": quality.tolerated(3),
    }
    return counts.select(
        "l_returnflag", "failed_rows", "total_rows",
        *[quality.status("failed_rows", "total_rows", policy).alias(name) for name, policy in named.items()])


@query("DQ-11_percentage", f"""
SELECT c_nationkey, {o.rounded('100.0 * COUNT(*) FILTER (WHERE c_acctbal < 0) / NULLIF(COUNT(*), 0)')} AS negative_pct,
       CAST(NULL AS DOUBLE) AS empty_pct
FROM customer GROUP BY c_nationkey""")
def percentages(spark, sf_dir):
    per = feeds.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.count_if(F.col("c_acctbal") < 0).alias("bad"), F.count(F.lit(1)).alias("n"))
    return per.select(
        "c_nationkey", percentage("bad", "n").alias("negative_pct"),
        percentage("bad", "n - n").alias("empty_pct"))


def clean_layer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of the clean layer in the shared shape."""
    zones = feeds.zones_raw(spark, sf_dir)
    return rollup.unify({
        "Green Taxi": rules.trip_checks(feeds.trips(spark, sf_dir), *feeds.WINDOW),
        "Weather": rules.weather_checks(clean.clean_weather(feeds.weather_raw(spark, sf_dir)), NOW_SQL),
        "Taxi Zones": rules.zone_checks(zones, clean.clean_zones(zones)),
        "Traffic Advisory": rules.advisory_checks(
            feeds.advisories_raw(spark, sf_dir), feeds.history(spark, sf_dir), TODAY_SQL),
    })


def _unified(body: str) -> str:
    return o.statement(body, *o.UNIFIED_NEEDS, dq=o.unified_rows())


@query("DQ-12_unified", _unified("SELECT * FROM dq"))
def unified(spark, sf_dir):
    return clean_layer_quality(spark, sf_dir)


@query("DQ-13_by_severity", _unified("SELECT * FROM dq"))
def by_severity(spark, sf_dir):
    return rollup.order_by_severity(clean_layer_quality(spark, sf_dir))


@query("DQ-14_status_totals", _unified("""
SELECT COUNT(*) FILTER (WHERE status = 'PASS') AS pass_checks, COUNT(*) FILTER (WHERE status = 'WARN') AS warn_checks,
       COUNT(*) FILTER (WHERE status = 'FAIL') AS fail_checks, COUNT(*) AS total_checks FROM dq"""))
def status_totals(spark, sf_dir):
    return rollup.status_totals(clean_layer_quality(spark, sf_dir))


@query("DQ-15_by_dataset_status", _unified(
    "SELECT dataset, status, COUNT(*) AS check_count FROM dq GROUP BY dataset, status"))
def by_dataset_status(spark, sf_dir):
    return rollup.by_dataset_status(clean_layer_quality(spark, sf_dir))


@query("DQ-15_by_status", _unified("SELECT status, COUNT(*) AS checks FROM dq GROUP BY status"))
def by_status(spark, sf_dir):
    return rollup.by_status(clean_layer_quality(spark, sf_dir))


@query("DQ-16_by_dimension", _unified(
    "SELECT data_quality_check, COUNT(*) AS check_count FROM dq GROUP BY data_quality_check"))
def by_dimension(spark, sf_dir):
    return rollup.by_dimension(clean_layer_quality(spark, sf_dir))


@query("DQ-17_issues", _unified(
    "SELECT * FROM dq WHERE status IN ('FAIL', 'WARN') AND dataset IN ('Weather', 'Green Taxi')"))
def issues(spark, sf_dir):
    return rollup.issues(clean_layer_quality(spark, sf_dir), datasets=("Weather", "Green Taxi"))


@query("DQ-18_mart_checks", o.statement(
    o.check_rows(o.mart_check_rows()), "fact", "dim_zone", "dim_date", "dim_weather", "dim_advisory"))
def mart_checks(spark, sf_dir):
    fact, zone, date = (f(spark, sf_dir) for f in (feeds.fact, feeds.zone_dim, feeds.date_dim))
    dims = {
        "dim_zone": zone, "dim_date": date, "dim_weather": feeds.weather_dim(spark, sf_dir),
        "dim_advisory": feeds.advisory_dim(spark, sf_dir),
    }
    weather, advisory = dims["dim_weather"], dims["dim_advisory"]
    outputs = dict(zip(BI_TABLES, (
        bi.borough_flows(fact, zone), bi.top_pickup_zones(fact, zone), bi.temporal_patterns(fact, date),
        bi.weather_impact(fact, weather), bi.advisory_impact(fact, zone, advisory, days=feeds.WINDOW), bi.kpi_summary(fact),
    )))
    return rules.mart_checks(fact, dims, outputs)


_URGENT = "o_orderpriority = '1-URGENT'"


@query("DQ-19_reconcile", o.check_rows([
    o.check_row("complete batch", "Completeness", "SELECT 0", o._count("orders"), "fail"),
    o.check_row("short batch", "Completeness", o._count("orders", _URGENT), o._count("orders"), "fail"),
]))
def reconcile(spark, sf_dir):
    """Orders landed whole, and landed without some of them, against their source."""
    source = feeds.table(spark, sf_dir, "orders")
    batches = {"complete": source, "short": source.filter(f"NOT ({_URGENT})")}
    found = []
    for kind, batch in batches.items():
        name = f"kerbline_dq_19_{kind}"
        landed = tables.write_table(tables.with_provenance(batch, "orders", "b1"), name, path=_place(spark, name))
        found.append(quality.reconcile(source, landed, f"{kind} batch"))
    return dedup.union_by_name(found)


@query("DQ-19_schema_drift", """
SELECT 'n_keys' AS "column", 'customer' AS batch, 'bigint' AS data_type, COUNT(*) AS batch_rows FROM customer
UNION ALL SELECT 'n_keys', 'supplier', CAST(NULL AS VARCHAR), COUNT(*) FROM supplier""")
def schema_drift(spark, sf_dir):
    """Two batches that differ in one column, with the rows each batch holds."""
    customer = feeds.table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("n_keys"))
    supplier = feeds.table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    sizes = dedup.union_by_name([
        df.agg(F.count(F.lit(1)).alias("batch_rows")).select(F.lit(name).alias("batch"), "batch_rows")
        for name, df in (("customer", customer), ("supplier", supplier))
    ])
    return quality.schema_drift({"customer": customer, "supplier": supplier}).join(sizes, "batch").select(
        "column", "batch", "data_type", "batch_rows")
