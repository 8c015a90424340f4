"""BI questions over the mart.

Shape of every query here: reduce the fact by its join key first, then join, then
merge. The fact is read once with the columns in use and combined map-side, so what
is shuffled and joined is one row per zone pair or hour - the join has no hot keys and
needs no broadcast hint, and the group-by strings are never touched per trip.

``dim_zone.location_id`` is unique by its grain; ``mart_checks`` verifies it. Stored
order is no guarantee, so the sort is the last step of each query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.functions.numeric import mean, partials, round_half_up, total
from kerbline.operators.joins import BROADCAST_ROWS, lookup_join, within_rows

TRIPS = "_trips"


def _count() -> Column:
    return F.count(F.lit(1)).alias(TRIPS)


def borough_flows(fact: DataFrame, zone: DataFrame) -> DataFrame:
    """Trips, distance and revenue per pickup and drop-off borough, busiest first."""
    return flows_of(fact.groupBy("pu_location_id", "do_location_id").agg(_count(), *partials("trip_distance", "total_amount")), zone)


def flows_of(pairs: DataFrame, zone: DataFrame) -> DataFrame:
    """Borough flows from trips reduced by zone pair (and anything else, such as the day)."""
    pickup = zone.select(F.col("location_id").alias("pu_location_id"), F.col("borough").alias("pickup_borough"))
    dropoff = zone.select(F.col("location_id").alias("do_location_id"), F.col("borough").alias("dropoff_borough"))
    return (
        pairs.join(pickup, "pu_location_id")
        .join(dropoff, "do_location_id")
        .groupBy("pickup_borough", "dropoff_borough")
        .agg(
            F.sum(TRIPS).alias("total_trips"),
            total("trip_distance", "total_distance_miles"),
            total("total_amount", "total_revenue"),
        )
        .orderBy(F.desc("total_trips"), "pickup_borough", "dropoff_borough")
    )


def top_pickup_zones(fact: DataFrame, zone: DataFrame, k: int | None = None) -> DataFrame:
    """Trips, mean distance and revenue per pickup zone, busiest first, optionally the top k."""
    return zones_of(fact.groupBy("pu_location_id").agg(_count(), *partials("trip_distance", "total_amount")), zone, k)


def zones_of(by_id: DataFrame, zone: DataFrame, k: int | None = None) -> DataFrame:
    """Top pickup zones from trips reduced by pickup zone (and anything else)."""
    names = zone.select(
        F.col("location_id").alias("pu_location_id"),
        F.col("borough").alias("pickup_borough"),
        F.col("zone").alias("pickup_zone"),
    )
    ranked = (
        by_id.join(names, "pu_location_id")
        .groupBy("pickup_borough", "pickup_zone")
        .agg(
            F.sum(TRIPS).alias("total_trips"),
            mean("trip_distance", "avg_trip_distance_miles"),
            total("total_amount", "total_revenue"),
        )
        .orderBy(F.desc("total_trips"), "pickup_borough", "pickup_zone")
    )
    return ranked if k is None else ranked.limit(k)


def temporal_patterns(fact: DataFrame, date: DataFrame) -> DataFrame:
    """Trips, passengers, mean duration and mean fare per hour of day and weekend flag."""
    return patterns_of(fact.groupBy("pickup_date_hour_key", "pickup_hour").agg(
        _count(), F.sum("passenger_count").alias("_passengers"), *partials("trip_duration_min", "fare_amount")), date)


def patterns_of(by_hour: DataFrame, date: DataFrame) -> DataFrame:
    """Temporal patterns from trips reduced by pickup hour."""
    days = date.select(F.col("date_hour_key").alias("pickup_date_hour_key"), "is_weekend")
    return (
        by_hour.join(days, "pickup_date_hour_key")
        .groupBy("pickup_hour", "is_weekend")
        .agg(
            F.sum(TRIPS).alias("total_trips"),
            F.sum("_passengers").alias("total_passengers"),
            mean("trip_duration_min", "avg_duration_minutes"),
            mean("fare_amount", "avg_fare_amount"),
        )
        .orderBy("is_weekend", "pickup_hour")
    )


def weather_condition() -> Column:
    """Snow before rain before clear; unknown measures count as clear."""
    return F.expr(
        "CASE WHEN snowfall > 0 THEN 'Snow' WHEN precipitation > 0 THEN 'Rain/Precipitation' ELSE 'Clear/Dry' END"
    )


def weather_impact(fact: DataFrame, weather: DataFrame) -> DataFrame:
    """Trips, mean temperature, distance and duration per weather condition at pickup.

    An hour with several weather rows counts its trips once per row, as a plain join does.
    """
    return impact_of(fact.groupBy("pickup_date_hour_key").agg(_count(), *partials("trip_distance", "trip_duration_min")), weather)


def impact_of(by_hour: DataFrame, weather: DataFrame) -> DataFrame:
    """Weather impact from trips reduced by pickup hour."""
    hours = weather.select(
        F.col("date_hour_key").alias("pickup_date_hour_key"),
        weather_condition().alias("weather_condition"),
        "temperature_2m",
    )
    weighted = f"double(sum(cast(temperature_2m AS decimal(18,4)) * {TRIPS}))"
    weight = f"sum(CASE WHEN temperature_2m IS NOT NULL THEN {TRIPS} END)"
    return (
        by_hour.join(hours, "pickup_date_hour_key")
        .groupBy("weather_condition")
        .agg(
            round_half_up(f"try_divide({weighted}, {weight})", 1).alias("avg_temperature_c"),
            F.sum(TRIPS).alias("total_trips"),
            mean("trip_distance", "avg_distance_miles"),
            mean("trip_duration_min", "avg_duration_minutes"),
        )
        .orderBy(F.desc("total_trips"), "weather_condition")
    )


#: What tells one trip from another.
TRIP_IDENTITY = ("pu_location_id", "do_location_id", "pickup_datetime", "dropoff_datetime")


def distinct_trips(fact: DataFrame) -> DataFrame:
    """The identities of the trips; trips equal in both zones and both times count once."""
    return fact.select(*TRIP_IDENTITY).distinct()


def advisories_by_day(advisory: DataFrame, first_day: Column, last_day: Column, inclusive_end: bool = False) -> DataFrame:
    """Which advisory is in force per borough and day, ``first_day`` to ``last_day``.

    At most one row per borough and calendar day however many advisories there are:
    windows are clipped to the days asked for, spread over days and reduced map-side to
    the most recent one (ties: smallest id). ``at_midnight`` differs from ``in_day`` on
    the last day of a window, which ends at 00:00 unless ``inclusive_end``.
    """
    days = F.sequence(
        F.greatest(F.col("effective_from"), first_day), F.least(F.col("effective_to"), last_day)
    )
    open_windows = advisory.filter(
        (F.col("effective_from") <= F.col("effective_to"))
        & (F.col("effective_from") <= last_day)
        & (F.col("effective_to") >= first_day)
    )
    spread = open_windows.select(
        F.lower(F.trim("borough")).alias("_borough_key"),
        F.struct(
            (-F.unix_date("effective_from")).alias("recency"), "advisory_id", "advisory_type"
        ).alias("_pick"),
        "effective_to",
        F.explode(days).alias("_day"),
    )
    in_day = F.lit(True) if inclusive_end else F.col("_day") < F.col("effective_to")
    return spread.groupBy("_borough_key", "_day").agg(
        F.min(F.when(in_day, F.col("_pick"))).alias("in_day"),
        F.min("_pick").alias("at_midnight"),
    )


def advisory_impact(
    fact: DataFrame, zone: DataFrame, advisory: DataFrame, inclusive_end: bool = False,
    days: tuple[str, str] | None = None,
) -> DataFrame:
    """Trips, mean duration and mean total per borough and type of the advisory in force.

    A trip is told apart by its two zones and two times; trips equal in all four count
    once, with the smallest total. It gets the most recent advisory whose window holds
    the pickup time in its pickup borough, or 'None'.

    The range join is replaced by an equi-join: the advisory depends on borough, day and
    on whether the pickup is at midnight sharp, so trips are first reduced to those and
    meet a per-day lookup of at most one row each. ``days`` are the first and last day of
    the pickups asked for (trips without a pickup time stay in); a fact stored by
    ``pickup_date`` is read for these days only. Without them the span of the fact is
    looked up.
    """
    if days is not None:
        day = F.col("pickup_date") if "pickup_date" in fact.columns else F.col("pickup_datetime").cast("date")
        fact = fact.filter(day.isNull() | day.between(*(F.lit(d).cast("date") for d in days)))
    trips = fact.groupBy(*TRIP_IDENTITY).agg(
        F.min(F.struct("total_amount", "trip_duration_min")).alias("_t")
    )
    ts = F.col("pickup_datetime")
    by_day = trips.select(
        "pu_location_id",
        ts.cast("date").alias("_day"),
        (ts == ts.cast("date").cast("timestamp_ntz")).alias("_midnight"),
        F.col("_t.total_amount").alias("total_amount"),
        F.col("_t.trip_duration_min").alias("trip_duration_min"),
    ).groupBy("pu_location_id", "_day", "_midnight").agg(_count(), *partials("trip_duration_min", "total_amount"))

    boroughs = zone.select(
        F.col("location_id").alias("pu_location_id"), "borough", F.lower(F.trim("borough")).alias("_borough_key")
    )
    if days is None:
        span = fact.selectExpr("date(pickup_datetime) AS d").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
        first, last = span.select("lo").scalar(), span.select("hi").scalar()
    else:
        first, last = (F.lit(d).cast("date") for d in days)
    lookup = advisories_by_day(advisory, first, last, inclusive_end)
    chosen = F.when(F.col("_midnight"), F.col("at_midnight")).otherwise(F.col("in_day"))
    return (
        by_day.join(boroughs, "pu_location_id")
        .join(lookup, ["_borough_key", "_day"], "left")
        # Grouped by the type itself: trips without an advisory and a type that is
        # literally 'None' stay two groups.
        .groupBy("borough", chosen["advisory_type"].alias("_type"))
        .agg(
            F.sum(TRIPS).alias("total_trips"),
            mean("trip_duration_min", "avg_duration_minutes"),
            mean("total_amount", "avg_total_fare"),
        )
        .select(
            "borough",
            F.coalesce("_type", F.lit("None")).alias("advisory_type"),
            "total_trips", "avg_duration_minutes", "avg_total_fare",
        )
        .orderBy("borough", "advisory_type", "total_trips")
    )


def kpi_summary(fact: DataFrame) -> DataFrame:
    """One row of headline figures; revenue per mile is NULL without miles."""
    return kpi_of(fact.agg(_count(), F.sum("passenger_count").alias("_passengers"), *partials(*_KPI_MEASURES)))


_KPI_MEASURES = ("total_amount", "fare_amount", "trip_distance", "trip_duration_min")


def kpi_of(reduced: DataFrame) -> DataFrame:
    """Headline figures from trips reduced by anything."""
    sums = [F.sum(f"{m}__{part}").alias(f"{m}__{part}") for m in _KPI_MEASURES for part in ("sum", "n")]
    merged = reduced.agg(F.coalesce(F.sum(TRIPS), F.lit(0)).alias(TRIPS), F.sum("_passengers").alias("total_passengers"), *sums)

    def avg(measure: str) -> Column:
        return round_half_up(f"try_divide({measure}__sum, {measure}__n * 100)")

    return merged.select(
        F.col(TRIPS).alias("total_trips"),
        "total_passengers",
        round_half_up("total_amount__sum / 100").alias("total_revenue_usd"),
        avg("fare_amount").alias("avg_fare_usd"),
        avg("trip_distance").alias("avg_distance_miles"),
        avg("trip_duration_min").alias("avg_duration_minutes"),
        round_half_up("try_divide(total_amount__sum, trip_distance__sum)").alias("revenue_per_mile"),
    )


def endpoint_weather(
    fact: DataFrame, zone: DataFrame, weather: DataFrame, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Trips with the weather at both ends, found by borough, date and hour of each end.

    Output is one row per trip, so the fact cannot be reduced first: the weather side is
    broadcast when counted small enough, otherwise joined with salted keys. It must hold
    one row per borough and hour.
    """
    small_zone, small_weather = within_rows(zone, max_rows), within_rows(weather, max_rows)

    def end_of_trip(df: DataFrame, end: str, place: str, ts: str) -> DataFrame:
        zones = zone.select(
            F.col("location_id").alias(place), F.col("borough").alias(f"{end}_borough"),
            F.lower(F.trim("borough")).alias(f"_{end}_key"),
        )
        seen = weather.select(
            F.lower(F.trim("borough")).alias(f"_{end}_key"),
            F.col("observation_date").alias(f"_{end}_date"),
            F.col("observation_hour").alias(f"_{end}_hour"),
            weather_condition().alias(f"{end}_condition"),
            F.col("temperature_2m").alias(f"{end}_temperature"),
        )
        located = lookup_join(df, zones, [place], max_rows=max_rows, small=small_zone).withColumns({
            f"_{end}_date": F.col(ts).cast("date"), f"_{end}_hour": F.hour(ts),
        })
        keys = [f"_{end}_key", f"_{end}_date", f"_{end}_hour"]
        return lookup_join(located, seen, keys, max_rows=max_rows, small=small_weather).drop(*keys)

    both = end_of_trip(fact, "pickup", "pu_location_id", "pickup_datetime")
    return end_of_trip(both, "dropoff", "do_location_id", "dropoff_datetime")
