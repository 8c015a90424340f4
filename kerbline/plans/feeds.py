"""Adapters that shape the given test tables into the engine's inputs.

The given tables hold no trips, weather, zones or advisories, so each adapter derives
them row by row (or by a grouped hour) from whole tables, with enough odd rows - NULLs,
reversed times, unknown codes, repeated entries - for every rule to have hits. The same
derivations in SQL are in ``plans.oracle``.

=============  ===============================================================
zones          ``nation`` joined to ``region``
trips          ``events``, one trip per event
order trips    ``lineitem`` joined to ``orders``, ``customer``, ``supplier``
weather        ``events`` by hour (and by place)
scrapes        ``events``, one advisory entry per event, one scrape per week
pages          ``pages`` with headings and labels added to their markup
=============  ===============================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kerbline.functions.keys import sighting_key
from kerbline.functions.numeric import rounded
from kerbline.operators.clean import clean_trips, clean_weather, clean_zones
from kerbline.operators.history import load_scrape, rebuild_history, stage_history
from kerbline.operators.mart import dim_advisory, dim_date, dim_weather, dim_zone, fact_trip

#: Pickup window of the trips; some events fall before and after it.
WINDOW = ("2024-01-03", "2024-01-29")
#: "Now" and "today" of the timeliness rules.
NOW = "2024-01-25 00:00:00"
TODAY = "2024-01-20"
AS_OF = "2024-01-17"

BOROUGH_OF_REGION = {"AFRICA": "bronx", "AMERICA": " brooklyn ", "ASIA": "MANHATTAN", "EUROPE": "queens",
                     "MIDDLE EAST": "staten island"}
ODD_ZONES = {3: "SOHO", 7: "jfk airport", 11: "N/A", 13: "Unknown", 17: "DUMBO/VINEGAR HILL"}
SECTIONS = (("bronx", "Bronx/Manhattan"), ("brooklyn", "Brooklyn/Queens"), ("manhattan", "Manhattan"),
            (None, "Queens"), ("staten", "Staten Island"), ("crossings", "East River Bridge Crossings"))
PLACES = ("Bronx", "Brooklyn", "Manhattan", "Queens", "Staten Island")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choose(index: str, values) -> str:
    """SQL text: the value at ``index`` of a short fixed tuple."""
    listed = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"get(array({listed}), int({index}))"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "ts", "user_id", "event_type", "value",
        "cast(date_trunc('second', ts) AS timestamp_ntz) AS t",
        # props is {"k": n}. Sliced, not parsed: filters on trips are pushed below this
        # projection and would parse the JSON once for every mention of k.
        "int(substr(props, 7, length(props) - 7)) AS k",
        "bigint(rint(value * 100)) AS cents",
    )


def _computed_once(df: DataFrame, *columns: str) -> DataFrame:
    """Project ``columns`` ("expression AS name") so that each is computed once per row.

    Filters on a plain projection are pushed below it with every mention replaced by the
    whole expression. A one-row generator is not looked through; stored tables, whose
    columns these adapters stand for, need nothing of the kind.
    """
    return df.selectExpr(f"inline(array(struct({', '.join(columns)})))")


# --- zones ------------------------------------------------------------------------------


def zones_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    boroughs = " ".join(f"WHEN '{name}' THEN '{spelling}'" for name, spelling in BOROUGH_OF_REGION.items())
    odd = " ".join(f"WHEN {key} THEN '{name}'" for key, name in ODD_ZONES.items())
    usual = _choose("n_nationkey % 3", ("boro zone", " YELLOW zone", "Airports"))
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).selectExpr(
        "if(n_nationkey = 23, 'x23', string(n_nationkey + 1)) AS LocationID",
        f"CASE n_nationkey WHEN 5 THEN ' ewr ' WHEN 24 THEN NULL ELSE CASE r_name {boroughs} END END AS Borough",
        f"CASE n_nationkey {odd} ELSE replace(n_name, '_', ' ') END AS Zone",
        f"CASE n_nationkey WHEN 9 THEN 'EWR' WHEN 14 THEN 'N/A' WHEN 21 THEN 'Night Zone' ELSE {usual} END AS service_zone",
    )


# --- trips ------------------------------------------------------------------------------


def trips_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    reported = "event_type <> 'error'"  # errors stand for the vendor whose metadata is missing
    fare = "CASE k WHEN 90 THEN -value WHEN 85 THEN NULL ELSE value * 2 END"
    tip = "if(k = 84, -1.0D, value * (k % 4) / 7)"
    seconds = (
        "CASE k WHEN 99 THEN -3600 WHEN 98 THEN 60 WHEN 96 THEN 59 WHEN 95 THEN 86400 WHEN 94 THEN 86401 "
        "ELSE cents * (k % 5) END"
    )
    return _computed_once(
        _events(spark, sf_dir),
        "CASE event_type WHEN 'view' THEN 1L WHEN 'signup' THEN 7L WHEN 'error' THEN 6L ELSE 2L END AS VendorID",
        "if(k <> 97, t, NULL) AS lpep_pickup_datetime",
        f"if(k <> 88, timestampadd(SECOND, {seconds}, t), NULL) AS lpep_dropoff_datetime",
        f"if({reported}, 'N', NULL) AS store_and_fwd_flag",
        f"double(if({reported}, if(k = 89, 99, k % 8), NULL)) AS RatecodeID",
        "int(user_id % 26 + 1) AS PULocationID",
        "if(k = 83, 264, k % 27 + 1) AS DOLocationID",
        f"double(if({reported}, k % 7, NULL)) AS passenger_count",
        "CASE WHEN k = 92 THEN 111005.95D WHEN k = 91 THEN NULL WHEN k % 10 = 0 THEN 0D ELSE value END AS trip_distance",
        f"{fare} AS fare_amount",
        "0.5D AS extra",
        "0.5D AS mta_tax",
        f"{tip} AS tip_amount",
        "if(k = 82, 6.94D, 0D) AS tolls_amount",
        "double(NULL) AS ehail_fee",
        "1.0D AS improvement_surcharge",
        f"{fare} + {tip} + 2 AS total_amount",
        f"double(if({reported}, k % 7, NULL)) AS payment_type",
        f"double(if({reported}, k % 3, NULL)) AS trip_type",
        f"if({reported}, 2.75D, NULL) AS congestion_surcharge",
        "0.75D AS cbd_congestion_fee",
    )


def trip_months(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The trips in three batches by event time that together hold every trip."""
    trips = trips_raw(spark, sf_dir)
    ts, first, second = "lpep_pickup_datetime", "TIMESTAMP_NTZ '2024-01-11'", "TIMESTAMP_NTZ '2024-01-21'"
    return [
        trips.filter(f"{ts} < {first}"),
        trips.filter(f"{ts} >= {first} AND {ts} < {second}"),
        trips.filter(f"{ts} >= {second} OR {ts} IS NULL"),
    ]


def order_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as trips from the customer's to the supplier's zone."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    joined = (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return joined.select(
        F.col("o_orderdate").alias("lpep_pickup_datetime"),
        F.col("l_shipdate").alias("lpep_dropoff_datetime"),
        (F.col("c_nationkey") + 1).alias("PULocationID"),
        (F.col("s_nationkey") + 1).alias("DOLocationID"),
        F.col("l_linenumber").alias("passenger_count"),
        F.col("l_quantity").alias("trip_distance"),
        F.col("l_extendedprice").alias("fare_amount"),
        F.col("l_extendedprice").alias("total_amount"),
    )


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_trips([trips_raw(spark, sf_dir)], *WINDOW)


# --- weather ----------------------------------------------------------------------------


def weather_raw(spark: SparkSession, sf_dir: str, by_place: bool = False) -> DataFrame:
    """Hourly observations from the events of each hour (and place)."""
    place = "int(user_id % 5)" if by_place else "2"
    hours = _events(spark, sf_dir).groupBy(
        F.expr("cast(date_trunc('hour', ts) AS timestamp_ntz) AS h"), F.expr(f"{place} AS p")
    ).agg(
        F.expr("sum(cents) AS c"), F.expr("count(1) AS n"), F.expr("min(k) AS lo"), F.expr("max(k) AS hi")
    )
    return hours.selectExpr(
        "if(NOT (lo = 7 AND hi = 97), h, NULL) AS observation_time",
        f"{rounded('c / (n * 100) - 40', 1)} AS temperature_2m",
        "if(lo % 3 = 0, lo / 10, 0D) AS precipitation",
        "if(hi % 11 <> 0, (lo % 4 - 1) / 10, NULL) AS rain",
        "CASE WHEN lo % 5 = 0 THEN (hi % 7) / 10 WHEN lo % 5 <> 1 THEN 0D END AS snowfall",
        "bigint(hi) AS weather_code",
        "c / 100 AS wind_speed_10m",
        "(403.5D + p * 1.5D) / 10 AS latitude",
        "-73.95D AS longitude",
        "' America/New_York ' AS timezone",
        "10D AS elevation",
        f"{_choose('p', PLACES)} AS borough",
    )


def weather_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observations as columnar documents: one per place and day, arrays of its hours."""
    rows = weather_raw(spark, sf_dir, by_place=True).filter("observation_time IS NOT NULL")
    measures = ("temperature_2m", "precipitation", "rain", "snowfall", "weather_code", "wind_speed_10m")
    slots = F.array_sort(F.collect_list(F.struct(
        F.date_format("observation_time", "yyyy-MM-dd'T'HH:mm").alias("time"), *measures
    )))
    per_day = rows.groupBy(
        "latitude", "longitude", "timezone", "elevation", F.col("observation_time").cast("date").alias("day")
    ).agg(slots.alias("s"))  # at most 24 slots: one row per place and hour goes in
    return per_day.select(
        "latitude", "longitude", "timezone", "elevation",
        F.struct(*[F.col(f"s.{f}").alias(f) for f in ("time", *measures)]).alias("hourly"),
    )


# --- advisories -------------------------------------------------------------------------


def scrape_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw advisory entries, with repeats inside and across the weekly scrapes."""
    undated = "event_type IN ('click', 'signup')"
    street, begin, end = "concat('Street ', k % 5)", "concat('Avenue ', k % 5)", "concat('Avenue 1', k % 5)"
    week = "date(date_trunc('week', ts))"
    entries = _events(spark, sf_dir).selectExpr(
        f"{_choose('user_id % 6', [s[0] for s in SECTIONS])} AS section_id",
        f"{_choose('user_id % 6', [s[1] for s in SECTIONS])} AS section_name",
        "concat('Location ', user_id) AS location_name",
        "CASE WHEN k = 87 THEN NULL WHEN event_type = 'purchase' THEN 'event' ELSE 'construction' END AS entry_type",
        "CASE event_type WHEN 'click' THEN 'Route' WHEN 'signup' THEN 'Formation' END AS detail_label",
        f"if({undated}, concat({street}, ' between ', {begin}, ' and ', {end}), concat(event_type, ' work ', k % 5)) AS advisory_text",
        f"if({undated}, {street}, NULL) AS street_name",
        f"if({undated}, {begin}, NULL) AS from_street",
        f"if({undated}, {end}, NULL) AS to_street",
        f"if({undated}, NULL, string(date(ts))) AS date_first_mentioned",
        f"if({undated}, NULL, string(date_add(date(ts), if(k = 86, -1, k % 4)))) AS date_last_mentioned",
        f"if({undated}, 0, 2) AS n_dates_mentioned",
        f"string({week}) AS advisory_week_start",
        f"string(date_add({week}, 6)) AS advisory_week_end",
        "'' AS advisory_week_text",
        "'https://example.org/advisories' AS source_url",
        "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS scraped_at_iso",
        f"string({week}) AS scrape_date",
        "'advisory_feed' AS source_system",
        f"concat('batch_', {week}) AS batch_id",
    )
    return entries.withColumn("advisory_sk", sighting_key())


def advisories_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw advisory table: every scrape landed, unique by sighting key."""
    return load_scrape(scrape_entries(spark, sf_dir), None)


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_history(advisories_raw(spark, sf_dir), unique=True)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuild_history(sightings(spark, sf_dir))


def pages_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages with advisory markup: a week header, sections, locations, labels and
    dated sentences around the text they already have."""
    number = F.col("page_id")
    day = (number % 28 + 1).cast("string")
    html = F.col("html")
    html = F.replace(html, F.lit("<nav>"), F.concat(
        F.lit("<h2>Weekly Traffic Advisory for Monday January "), day,
        F.lit("th, 2024 to FEBRUARY 3, 2024</h2><p>Lead text</p>"
              '<h2 id="nav">East River Bridge Crossings</h2><h3>Navigation</h3>'),
        F.when(number % 3 != 0, "<strong>Route:</strong>").otherwise(""),
    ))
    html = F.regexp_replace(html, '<li><a href="/([^"]*)">([^<]*)</a></li>', F.concat(
        F.when(number % 5 == 0, "<li><p>$2&rsquo;s ").otherwise("<li>$2&#146;s "),
        F.when(number % 2 == 0, "between").otherwise("bet"), F.lit(" $1 &ndash; &#38;lt; and $2"),
        F.when(number % 5 == 0, "</p></li>").otherwise("</li>"),
    ))
    html = F.replace(html, F.lit("<h1>"), F.lit('<h2 id="article">'))
    html = F.replace(html, F.lit("</h1>"), F.lit(
        "</h2><p>No place yet</p><h4>Body</h4><p>*Note: skipped</p><h3>Festivals, Parades and Events</h3>"
    ))
    html = F.replace(html, F.lit("</p>"), F.concat(
        F.lit(" from March 2nd, 2024 to March "), (number % 35).cast("string"), F.lit(", 2024</p>")
    ))
    return table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html"))


# --- mart -------------------------------------------------------------------------------


def zone_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dim_zone(clean_zones(zones_raw(spark, sf_dir)))


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact_trip(trips(spark, sf_dir))


def date_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dim_date(trips(spark, sf_dir))


def weather_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dim_weather(clean_weather(weather_raw(spark, sf_dir)))


def place_weather_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dim_weather(weather_raw(spark, sf_dir, by_place=True), by_location=True)


def advisory_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dim_advisory(history(spark, sf_dir))
