"""Rule sets of the four clean tables and of the mart."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.functions.keys import advisory_key
from kerbline.operators.bi import distinct_trips
from kerbline.operators.clean import DROPOFF, PICKUP
from kerbline.operators.history import latest_batch
from kerbline.operators.quality import (
    BY_PERCENT,
    FAIL_ON_ANY,
    PLACEHOLDER,
    WARN_ON_ANY,
    Check,
    duplicate_rows,
    fails,
    iqr_bounds,
    key_duplicates,
    passes,
    run_checks,
    tolerated,
)

# --- fixed values ---------------------------------------------------------------------
VENDORS = (1, 2, 7)
RATE_CODES = (1, 2, 3, 4, 5, 6, 99)
PAYMENT_TYPES = (1, 2, 3, 4, 5, 6)
TRIP_TYPES = (1, 2)
KNOWN_ZONES = (1, 263)
LONG_TRIP_MINUTES = 180
LONG_TRIP_MILES = 100
CITY_BOX = {"latitude": (40.4, 41.0), "longitude": (-74.3, -73.6)}
CITY_TIMEZONE = "America/New_York"
WMO_CODES = (0, 1, 2, 3, 45, 48, 51, 53, 55, 56, 57, 61, 63, 65, 66, 67, 71, 73, 75, 77, 80, 81, 82, 85, 86,
             95, 96, 99)
ZONE_IDS = (1, 265)
UNMAPPED_ZONES = (264, 265)
PLACEHOLDERS = ("Unknown", "N/A", "N/a")
ZONE_NAME_PLACEHOLDERS = ("Unknown", "N/A")
BOROUGHS = ("Manhattan", "Brooklyn", "Queens", "Bronx", "Staten Island", "EWR")
SERVICE_ZONES = ("Yellow Zone", "Boro Zone", "Airports", "EWR")
REPEATED_ZONE_NAMES = 3
ADVISORY_BOROUGHS = ("Manhattan", "Brooklyn", "Queens", "Bronx", "Staten Island", "Crossings")
LOCATION_FLOOR = 20
ADVISORY_OUTPUT = "traffic_advisory_and_incident_impact"
# --------------------------------------------------------------------------------------


def _stack(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _listed(values: Sequence[int | str]) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


# --- trips ------------------------------------------------------------------------------


def trip_rules(window_start: str, window_end: str, lower: Column, upper: Column) -> list[Check]:
    """The 25 row rules on cleaned trips."""
    start, end = f"TIMESTAMP_NTZ '{window_start}'", f"TIMESTAMP_NTZ '{window_end}'"
    low_zone, high_zone = KNOWN_ZONES

    def known(column: str, values: Sequence[int]) -> str:
        return f"{column} IN {_listed(values)} OR {column} IS NULL"

    required = (PICKUP, DROPOFF, "PULocationID", "DOLocationID", "total_amount")
    return [
        *[passes(c, "Completeness", f"{c} IS NOT NULL", FAIL_ON_ANY) for c in required],
        passes("ehail_fee", "Completeness", "ehail_fee IS NOT NULL", WARN_ON_ANY),
        fails("VendorID_6_Metadata", "Completeness", "VendorID = 6 AND RatecodeID IS NULL", WARN_ON_ANY),
        *[passes(c, "Validity", f"{c} BETWEEN {low_zone} AND {high_zone}", WARN_ON_ANY)
          for c in ("PULocationID", "DOLocationID")],
        passes("VendorID", "Validity", known("VendorID", VENDORS), WARN_ON_ANY),
        passes("RatecodeID", "Validity", known("RatecodeID", RATE_CODES), FAIL_ON_ANY),
        passes("payment_type", "Validity", known("payment_type", PAYMENT_TYPES), FAIL_ON_ANY),
        passes("trip_type", "Validity", known("trip_type", TRIP_TYPES), FAIL_ON_ANY),
        passes("passenger_count", "Validity", "passenger_count > 0", WARN_ON_ANY),
        passes(PICKUP, "Timeliness", f"{PICKUP} >= {start} AND {PICKUP} < {end}", FAIL_ON_ANY),
        passes(PICKUP, "Timeliness", f"{PICKUP} >= {start}", WARN_ON_ANY),
        passes(DROPOFF, "Consistency", f"{DROPOFF} >= {PICKUP}", FAIL_ON_ANY),
        fails("trip_duration_min", "Consistency", "trip_duration_min = 0 AND trip_distance > 0", WARN_ON_ANY),
        fails("trip_duration_min", "Consistency", "trip_duration_min = 0 AND trip_distance = 0 AND fare_amount > 0", WARN_ON_ANY),
        passes("trip_duration_min", "Consistency", f"trip_duration_min <= {LONG_TRIP_MINUTES}", WARN_ON_ANY),
        *[passes(c, "Accuracy", f"{c} >= 0", WARN_ON_ANY) for c in ("fare_amount", "total_amount", "tip_amount")],
        passes("trip_distance", "Accuracy", f"trip_distance <= {LONG_TRIP_MILES}", WARN_ON_ANY),
        passes("trip_distance", "Accuracy", F.col("trip_distance").between(lower, upper), WARN_ON_ANY),
    ]


def trip_checks(trips: DataFrame, window_start: str, window_end: str, accuracy: int | None = None) -> DataFrame:
    """All 26 trip checks: the row rules in one scan, plus whole-row duplicates.

    Quartile bounds enter as one scalar subquery; they are exact unless ``accuracy`` asks for a
    sketch.
    """
    bounds = iqr_bounds(trips, "trip_distance", accuracy).select(F.struct("lower", "upper").alias("b")).scalar()
    rules = trip_rules(window_start, window_end, bounds["lower"], bounds["upper"])
    return _stack([run_checks(trips, rules, empty_percentage=0.0), duplicate_rows(trips)])


# --- weather ----------------------------------------------------------------------------


def weather_rules(now: str = "localtimestamp()", box: dict[str, tuple[float, float]] = CITY_BOX) -> list[Check]:
    """The 19 row rules on cleaned weather; ``now`` (SQL) bounds the observation time."""

    def missing(column: str) -> Check:
        return fails(column, "Completeness", f"{column} IS NULL", BY_PERCENT)

    def outside(column: str, low: float, high: float) -> str:
        return f"{column} NOT BETWEEN {low}D AND {high}D"

    return [
        fails("elevation", "Validity", f"elevation IS NULL OR {outside('elevation', -500, 9000)}", BY_PERCENT),
        *[fails(axis, "Accuracy", f"{axis} IS NULL OR {outside(axis, *box[axis])}", BY_PERCENT)
          for axis in ("latitude", "longitude")],
        missing("observation_time"),
        fails("observation_time", "Timeliness", f"observation_time > {now}", BY_PERCENT),
        *[check for c in ("precipitation", "rain", "snowfall")
          for check in (missing(c), fails(c, "Accuracy", f"{c} < 0", BY_PERCENT))],
        missing("temperature_2m"),
        fails("temperature_2m", "Validity", outside("temperature_2m", -90, 60), BY_PERCENT),
        missing("timezone"),
        fails("timezone", "Consistency", f"timezone <> '{CITY_TIMEZONE}'", BY_PERCENT),
        missing("weather_code"),
        fails("weather_code", "Validity", f"weather_code NOT IN {_listed(WMO_CODES)}", BY_PERCENT),
        missing("wind_speed_10m"),
        fails("wind_speed_10m", "Validity", outside("wind_speed_10m", 0, 500), BY_PERCENT),
    ]


def weather_checks(weather: DataFrame, now: str = "localtimestamp()") -> DataFrame:
    """All 20 weather checks; the grain check counts repeated groups, not rows."""
    grain = key_duplicates(weather, ("latitude", "longitude", "observation_time"))
    repeated = run_checks(grain, [Check(
        "latitude, longitude, observation_time", "Uniqueness", "sum(repeated_keys)", BY_PERCENT, "sum(rows)",
    )])
    return _stack([run_checks(weather, weather_rules(now)), repeated])


# --- zones --------------------------------------------------------------------------------

_REPEATS = "sum(rows - distinct_keys)"
_NON_NULL_REPEATS = "sum(rows - distinct_keys - null_keys)"


def zone_checks(
    raw: DataFrame,
    clean: DataFrame,
    boroughs: Sequence[str] = BOROUGHS,
    service_zones: Sequence[str] = SERVICE_ZONES,
) -> DataFrame:
    """All 13 zone checks over the raw and the clean lookup."""
    low_id, high_id = ZONE_IDS

    def unexplained_null(column: str) -> Check:
        return fails(column, "Completeness", f"{column} IS NULL AND location_id NOT IN {_listed(UNMAPPED_ZONES)}", FAIL_ON_ANY)

    def placeholder(column: str, values: Sequence[str]) -> Check:
        return fails(column, "Validity", f"{column} IN {_listed(values)}", PLACEHOLDER)

    def unknown_value(column: str, values: Sequence[str]) -> Check:
        return fails(column, "Validity", f"{column} NOT IN {_listed((*values, *PLACEHOLDERS))}", FAIL_ON_ANY)

    row_checks = run_checks(clean, [
        fails("location_id", "Completeness", "location_id IS NULL", FAIL_ON_ANY),
        fails("location_id", "Accuracy", f"location_id NOT BETWEEN {low_id} AND {high_id}", FAIL_ON_ANY),
        unexplained_null("borough"),
        placeholder("borough", PLACEHOLDERS),
        unknown_value("borough", boroughs),
        unexplained_null("zone"),
        placeholder("zone", ZONE_NAME_PLACEHOLDERS),
        unexplained_null("service_zone"),
        placeholder("service_zone", PLACEHOLDERS),
        unknown_value("service_zone", service_zones),
    ])
    # Measured against the clean rows; NULL (not an error) when there are none.
    clean_rows = clean.agg(F.expr("nullif(count(1), 0) AS n")).scalar()
    castable = run_checks(
        raw, [fails("location_id", "Validity", "try_cast(string(LocationID) AS int) IS NULL", FAIL_ON_ANY)], total=clean_rows
    )
    repeated_id = run_checks(key_duplicates(clean, ("location_id",)), [
        Check("location_id", "Uniqueness", _REPEATS, FAIL_ON_ANY, "sum(rows)"),
    ])
    repeated_name = run_checks(key_duplicates(clean, ("zone",)), [
        Check("zone", "Uniqueness", _NON_NULL_REPEATS, tolerated(REPEATED_ZONE_NAMES), "sum(rows)"),
    ])
    return _stack([row_checks, castable, repeated_id, repeated_name])


# --- advisories ---------------------------------------------------------------------------


def advisory_checks(
    raw: DataFrame, history: DataFrame, today: str = "current_date()", location_floor: int = LOCATION_FLOOR
) -> DataFrame:
    """All 10 advisory checks, within and across the raw and the clean layer.

    ``today`` is a SQL expression that bounds the scrape date.
    """
    # One aggregation per layer and key: per raw key, per history key, per key of the newest scrape.
    per_raw_key = raw.groupBy("advisory_sk").agg(
        F.expr("count(1) AS _n"), F.expr(f"count_if(try_cast(scrape_date AS date) > {today}) AS _ahead"),
    )
    raw_rows = run_checks(per_raw_key, [
        Check("advisory_sk (raw)", "Uniqueness", "coalesce(sum(_n), 0) - count(advisory_sk)", FAIL_ON_ANY, "coalesce(sum(_n), 0)"),
        Check("scrape_date (raw)", "Timeliness", "coalesce(sum(_ahead), 0)", FAIL_ON_ANY, "coalesce(sum(_n), 0)"),
    ])
    batches = raw.agg(F.expr("count(DISTINCT scrape_date) AS n")).scalar()
    per_key = history.groupBy("closure_bk").agg(
        F.expr("count(1) AS _n"),
        F.expr("count_if(closure_bk IS NULL) AS _no_key"),
        F.expr("count_if(effective_from > effective_to) AS _reversed"),
        F.expr(f"count_if(borough NOT IN {_listed(ADVISORY_BOROUGHS)}) AS _elsewhere"),
        F.count_if(F.col("times_seen") > batches).alias("_too_often"),
    )
    clean_rows = run_checks(per_key, [
        Check(column, dimension, failed, policy, "coalesce(sum(_n), 0)") for column, dimension, failed, policy in (
            ("closure_bk", "Uniqueness", "coalesce(sum(_n), 0) - count(closure_bk)", FAIL_ON_ANY),
            ("closure_bk", "Completeness", "coalesce(sum(_no_key), 0)", FAIL_ON_ANY),
            ("effective_from, effective_to", "Validity", "coalesce(sum(_reversed), 0)", BY_PERCENT),
            ("borough", "Validity", "coalesce(sum(_elsewhere), 0)", BY_PERCENT),
            ("times_seen", "Consistency", "coalesce(sum(_too_often), 0)", FAIL_ON_ANY),
        )
    ])
    # The location is part of the advisory key, so this is one row per key of the newest scrape.
    held = history.select("closure_bk").distinct().withColumn("_held", F.lit(True))
    newest = latest_batch(raw).groupBy(advisory_key().alias("closure_bk"), "location_name").agg(
        F.expr("count(1) AS _n")).join(held, "closure_bk", "left")
    locations = "count(DISTINCT location_name)"
    shown = run_checks(newest, [
        Check("ALL_COLUMNS (raw, latest scrape)", "Completeness", "CASE WHEN count(1) > 0 THEN 0 ELSE 1 END",
              FAIL_ON_ANY, "coalesce(sum(_n), 0)"),
        Check("location_name (raw)", "Validity", f"CASE WHEN {locations} > {location_floor} THEN 0 ELSE 1 END",
              BY_PERCENT, locations),
        Check("closure_bk", "Accuracy", "count_if(_held IS NULL)", FAIL_ON_ANY, "count(1)"),
    ])
    return _stack([shown, raw_rows, clean_rows])


# --- mart ---------------------------------------------------------------------------------


def mart_checks(
    fact: DataFrame,
    dims: dict[str, DataFrame],
    outputs: dict[str, DataFrame] | None = None,
    min_minutes: float = 1.0,
    max_minutes: float = 1440.0,
) -> DataFrame:
    """Mart quality rows (with ``dataset``): NULL keys, duration range, references to the
    dimensions, key uniqueness of the dimensions, and BI outputs against the fact.

    ``dims`` maps ``dim_zone``, ``dim_date``, ``dim_weather``, ``dim_advisory`` to frames
    (any may be absent). ``outputs`` maps a BI output with ``total_trips`` to the frame; it
    must be non-empty and account for exactly as many trips as the fact, the advisory output
    for as many as the fact has without repeats of one trip. A weather output that counts
    trips several times, for hours with several observations, fails.

    The fact is reduced to its three keys in one aggregation, to which the dimensions' keys
    are joined; row rules and all references are sums over it.
    """
    keys = ("pu_location_id", "do_location_id", "pickup_date_hour_key")
    references = [
        (key, dim, dim_key) for key, dim, dim_key in (
            ("pu_location_id", "dim_zone", "location_id"),
            ("do_location_id", "dim_zone", "location_id"),
            ("pickup_date_hour_key", "dim_date", "date_hour_key"),
            ("pickup_date_hour_key", "dim_weather", "date_hour_key"),
        ) if dim in dims
    ]
    reduced = fact.groupBy(*keys).agg(
        F.expr("count(1) AS _n"),
        F.expr(f"count_if(NOT (trip_duration_min BETWEEN {min_minutes}D AND {max_minutes}D)) AS _off"),
    )
    for i, (key, dim, dim_key) in enumerate(references):
        known = dims[dim].select(F.col(dim_key).alias(key)).distinct().withColumn(f"_known_{i}", F.lit(True))
        reduced = reduced.join(known, key, "left")

    def share(column: str, dimension: str, rows: str, policy: Policy) -> Check:
        return Check(column, dimension, f"coalesce(sum({rows}), 0)", policy, "coalesce(sum(_n), 0)")

    parts = [("fact_trip", run_checks(reduced, [
        *[share(key, "Completeness", f"IF({key} IS NULL, _n, 0)", FAIL_ON_ANY) for key in keys],
        share("trip_duration_min", "Validity", "_off", FAIL_ON_ANY),
        *[share(f"{key} -> {dim}", "Consistency", f"IF({key} IS NOT NULL AND _known_{i} IS NULL, _n, 0)", BY_PERCENT)
          for i, (key, dim, _) in enumerate(references)],
    ]))]
    dim_keys = {"dim_zone": "location_id", "dim_date": "date_hour_key", "dim_weather": "date_hour_key",
                "dim_advisory": "advisory_id"}
    for dim, key in dim_keys.items():
        if dim in dims:
            parts.append((dim, run_checks(key_duplicates(dims[dim], (key,)), [
                Check(key, "Uniqueness", _NON_NULL_REPEATS, FAIL_ON_ANY, "sum(rows)"),
                Check(key, "Completeness", "sum(null_keys)", FAIL_ON_ANY, "sum(rows)"),
            ])))
    fact_rows = fact.agg(F.expr("count(1) AS n")).scalar()
    for name, output in (outputs or {}).items():
        expected = fact_rows if name != ADVISORY_OUTPUT else distinct_trips(fact).agg(F.expr("count(1) AS n")).scalar()
        counted = output.agg(F.expr("coalesce(sum(total_trips), 0) AS counted")).withColumn("expected", expected)
        parts.append((name, run_checks(counted, [
            Check("total_trips", "Accuracy", "sum(abs(counted - expected))", BY_PERCENT, "sum(expected)"),
        ])))
    return _stack([df.select(F.lit(dataset).alias("dataset"), "*") for dataset, df in parts])
