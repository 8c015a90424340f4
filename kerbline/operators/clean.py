"""Cleaning: trips, weather observations and zones (raw to typed, flagged rows)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from kerbline.functions.timekeys import elapsed_minutes
from kerbline.operators.dedup import keep_unless
from kerbline.operators.evolution import union_evolved

PICKUP, DROPOFF = "lpep_pickup_datetime", "lpep_dropoff_datetime"

# --- fixed values: trip typing and zone spelling ------------------------------------
INT_CODES = ("VendorID", "RatecodeID", "PULocationID", "DOLocationID", "passenger_count",
             "payment_type", "trip_type")
MONEY = ("fare_amount", "extra", "mta_tax", "tip_amount", "tolls_amount", "ehail_fee",
         "improvement_surcharge", "total_amount", "congestion_surcharge", "cbd_congestion_fee")
DISTANCE_CAP = 100_000
KEPT_UPPER = ("EWR",)
ZONE_SPELLING = {"SOHO": "SoHo", "LAGUARDIA AIRPORT": "LaGuardia Airport", "JFK AIRPORT": "JFK Airport",
                 "DUMBO/VINEGAR HILL": "DUMBO/Vinegar Hill"}
# ------------------------------------------------------------------------------------


def union_months(months: Sequence[DataFrame]) -> DataFrame:
    """Monthly trip tables as one, matched by column name, under the least common type of each column."""
    return union_evolved(months)


def with_duration(df: DataFrame, start: str = PICKUP, end: str = DROPOFF, out: str = "trip_duration_min") -> DataFrame:
    return df.withColumn(out, elapsed_minutes(start, end))


def hard_exclude_rules(window_start: str, window_end: str, distance_cap: float = DISTANCE_CAP) -> list[str]:
    """Conditions under which a row is no usable trip: pickup outside ``[start, end)``,
    drop-off before pickup, or a distance beyond the cap."""
    return [
        f"{PICKUP} < TIMESTAMP_NTZ '{window_start}'",
        f"{PICKUP} >= TIMESTAMP_NTZ '{window_end}'",
        f"{DROPOFF} < {PICKUP}",
        f"trip_distance > {distance_cap}D",
    ]


def hard_excludes(
    df: DataFrame, window_start: str, window_end: str, distance_cap: float = DISTANCE_CAP
) -> tuple[DataFrame, DataFrame]:
    """``(kept, excluded)`` trips; together they are exactly the input rows."""
    rules = hard_exclude_rules(window_start, window_end, distance_cap)
    return keep_unless(df, *rules), df.filter(" OR ".join(rules))


def trip_types() -> dict[str, str]:
    """Type of every trip column that needs one, as ``name -> SQL expression``."""
    spec = {c: f"int({c})" for c in INT_CODES}
    spec |= {c: f"cast({c} AS timestamp_ntz)" for c in (PICKUP, DROPOFF)}
    spec |= {c: f"round(double({c}), 2)" for c in ("trip_distance", *MONEY)}
    spec["trip_duration_min"] = "cast(trip_duration_min AS decimal(10,2))"
    spec["store_and_fwd_flag"] = "string(store_and_fwd_flag)"
    return spec


def apply_types(df: DataFrame, spec: Mapping[str, str] | None = None) -> DataFrame:
    """Apply a type spec in one projection; columns without an entry pass through."""
    spec = trip_types() if spec is None else spec
    return df.selectExpr(*[f"{spec.get(c, f'`{c}`')} AS `{c}`" for c in df.columns])


#: The six row flags. Flagged rows stay; a flag is never NULL.
TRIP_FLAGS = {
    "flag_vendor6_incomplete": "VendorID = 6 AND RatecodeID IS NULL",
    "flag_zero_duration_nonzero_distance": "trip_duration_min = 0 AND trip_distance <> 0",
    "flag_no_real_dropoff": "trip_duration_min = 0 AND trip_distance = 0 AND fare_amount > 0",
    "flag_negative_fare": "coalesce(fare_amount < 0, false) OR coalesce(total_amount < 0, false)",
    "flag_negative_tip": "tip_amount < 0",
    "flag_zero_passengers": "passenger_count = 0",
}


def with_flags(df: DataFrame) -> DataFrame:
    return df.selectExpr("*", *[f"coalesce({rule}, false) AS {name}" for name, rule in TRIP_FLAGS.items()])


#: Flags whose rows a measure must leave out.
MEASURE_EXCLUDES = {
    "flows": ("flag_no_real_dropoff",),
    "distance": ("flag_no_real_dropoff",),
    "speed": ("flag_no_real_dropoff", "flag_zero_duration_nonzero_distance"),
    "duration": ("flag_zero_duration_nonzero_distance",),
    "revenue": ("flag_negative_fare",),
    "tips": ("flag_negative_tip",),
    "passengers": ("flag_zero_passengers", "flag_vendor6_incomplete"),
    "metadata": ("flag_vendor6_incomplete",),
}


def for_measure(df: DataFrame, measure: str) -> DataFrame:
    """Rows a measure may use, by the flags of :func:`with_flags`."""
    return df.filter(" AND ".join(f"NOT {flag}" for flag in MEASURE_EXCLUDES[measure]))


def measure_counts(df: DataFrame) -> DataFrame:
    """Rows each measure may use, all measures in one scan."""
    usable = {m: " AND ".join(f"NOT {flag}" for flag in flags) for m, flags in MEASURE_EXCLUDES.items()}
    counted = df.agg(*[F.expr(f"count_if({rule}) AS {m}") for m, rule in usable.items()])
    return counted.selectExpr(f"stack({len(usable)}, {', '.join(f"'{m}', {m}" for m in usable)}) AS (measure, trips)")


def clean_trips(
    months: Sequence[DataFrame], window_start: str, window_end: str, distance_cap: float = DISTANCE_CAP
) -> DataFrame:
    """Raw monthly trips to typed and flagged trips. Row-local throughout: no shuffle."""
    trips = with_duration(union_months(months))
    kept, _ = hard_excludes(trips, window_start, window_end, distance_cap)
    return with_flags(apply_types(kept))


def clean_weather(df: DataFrame) -> DataFrame:
    """Distinct, typed hourly observations that have a time."""
    return df.filter("observation_time IS NOT NULL").selectExpr(
        "elevation", "latitude", "longitude", "observation_time", "precipitation", "rain", "snowfall",
        "temperature_2m", "trim(timezone) AS timezone", "int(weather_code) AS weather_code", "wind_speed_10m",
    ).distinct()


def title_case(column: str, exceptions: Mapping[str, str]) -> str:
    """SQL text: title case split on blanks, except for names with a spelling of their own."""
    text = f"trim(string({column}))"
    own = " ".join(f"WHEN '{upper}' THEN '{spelling}'" for upper, spelling in exceptions.items())
    return f"CASE upper({text}) {own} ELSE initcap({text}) END"


def clean_zones(df: DataFrame) -> DataFrame:
    """Zone lookup with an INT id and uniform spelling; a malformed id becomes NULL."""
    upper = {name: name for name in KEPT_UPPER}
    return df.selectExpr(
        "try_cast(string(LocationID) AS int) AS location_id",
        f"{title_case('Borough', upper)} AS borough",
        f"{title_case('Zone', ZONE_SPELLING)} AS zone",
        f"{title_case('service_zone', upper)} AS service_zone",
    )
