"""Dimensional build: four dimensions and the trip fact. All row-local but dim_date."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kerbline.functions.numeric import rounded
from kerbline.functions.timekeys import date_hour_key, minutes_between
from kerbline.operators.clean import DROPOFF, PICKUP


def dim_advisory(history: DataFrame) -> DataFrame:
    """Advisories with a validity window; undated ones get the week they were first seen."""
    return history.filter(F.col("closure_bk").isNotNull()).select(
        F.col("closure_bk").alias("advisory_id"),
        "section_id",
        F.col("entry_type").alias("advisory_type"),
        F.col("advisory_text").alias("description"),
        "borough", "location_name", "street_name", "from_street", "to_street",
        F.coalesce("effective_from", "advisory_week_start").alias("effective_from"),
        F.coalesce("effective_to", "advisory_week_end").alias("effective_to"),
    )


def dim_date(trips: DataFrame, ts: str = PICKUP) -> DataFrame:
    """One row per hour that has a pickup. Distinct over the truncated hour (8 bytes per
    row to shuffle, combined map-side); the calendar columns are derived afterwards."""
    hours = trips.filter(f"{ts} IS NOT NULL").selectExpr(f"cast(date_trunc('hour', {ts}) AS timestamp_ntz) AS _h").distinct()
    return hours.select(date_hour_key("_h").alias("date_hour_key"), F.expr("date(_h) AS full_date"),
                        F.expr("hour(_h) AS pickup_hour"), F.expr("year(_h) AS year"), F.expr("month(_h) AS month"),
                        F.expr("day(_h) AS day"), F.expr("date_format(_h, 'EEEE') AS day_of_week"),
                        F.expr("dayofweek(_h) IN (1, 7) AS is_weekend"))


_WEATHER_MEASURES = ("temperature_2m", "precipitation", "rain", "snowfall", "weather_code", "wind_speed_10m")


def dim_weather(weather: DataFrame, by_location: bool = False, average_locations: bool = False) -> DataFrame:
    """Hourly weather by date-hour key.

    ``by_location`` keeps a ``borough`` column of the input for endpoint weather.
    ``average_locations`` folds several places of one hour into one row, which keeps
    trips from being multiplied when a feed holds more than one place.
    """
    place = ["borough"] if by_location else []
    rows = weather.filter("observation_time IS NOT NULL").select(
        date_hour_key("observation_time").alias("date_hour_key"),
        F.expr("date(observation_time) AS observation_date"),
        F.expr("hour(observation_time) AS observation_hour"),
        *place,
        *_WEATHER_MEASURES,
    )
    if not average_locations:
        return rows
    return rows.groupBy("date_hour_key", "observation_date", "observation_hour", *place).agg(
        *[
            F.expr(f"max({m}) AS {m}" if m == "weather_code" else f"{rounded(f'avg(cast({m} AS decimal(18,4)))')} AS {m}")
            for m in _WEATHER_MEASURES
        ]
    )


def dim_zone(zones: DataFrame) -> DataFrame:
    return zones.filter(F.col("location_id").isNotNull()).select("location_id", "borough", "zone", "service_zone")


def fact_trip(trips: DataFrame, min_minutes: float = 1.0, max_minutes: float = 1440.0) -> DataFrame:
    """Trips between ``min_minutes`` and ``max_minutes`` long (unrounded), mart columns only."""
    minutes = minutes_between(PICKUP, DROPOFF)
    return trips.filter(
        f"{PICKUP} IS NOT NULL AND {DROPOFF} IS NOT NULL AND {minutes} BETWEEN {min_minutes}D AND {max_minutes}D"
    ).select(
        F.expr("PULocationID AS pu_location_id"),
        F.expr("DOLocationID AS do_location_id"),
        date_hour_key(PICKUP).alias("pickup_date_hour_key"),
        F.expr(f"{PICKUP} AS pickup_datetime"),
        F.expr(f"{DROPOFF} AS dropoff_datetime"),
        F.expr(f"hour({PICKUP}) AS pickup_hour"),
        F.expr(f"hour({DROPOFF}) AS dropoff_hour"),
        "passenger_count",
        "trip_distance",
        # Whole seconds over 60 are never half way between two hundredths.
        F.expr(f"rint({minutes} * 100) / 100 AS trip_duration_min"),
        "fare_amount",
        "total_amount",
    )
