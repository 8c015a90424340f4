"""Row rules of cleaning and mart on hand-made trap rows."""

import datetime as dt
import decimal

import pytest
from conftest import records
from pyspark.sql import functions as F

from kerbline.operators import bi, clean, dedup, mart
from kerbline.operators.joins import lookup_join

TRIP = (
    "VendorID long, lpep_pickup_datetime timestamp_ntz, lpep_dropoff_datetime timestamp_ntz, store_and_fwd_flag string, "
    "RatecodeID double, PULocationID int, DOLocationID int, passenger_count double, trip_distance double, "
    "fare_amount double, extra double, mta_tax double, tip_amount double, tolls_amount double, ehail_fee double, "
    "improvement_surcharge double, total_amount double, payment_type double, trip_type double, "
    "congestion_surcharge double, cbd_congestion_fee double"
)
START, END = "2026-03-01", "2026-06-01"
BASE = dt.datetime(2026, 3, 5, 10, 0, 0)


def trip(start=BASE, seconds=600, **over):
    end = None if start is None or seconds is None else start + dt.timedelta(seconds=seconds)
    row = {
        "VendorID": 2, "lpep_pickup_datetime": start, "lpep_dropoff_datetime": end, "store_and_fwd_flag": "N",
        "RatecodeID": 1.0, "PULocationID": 1, "DOLocationID": 2, "passenger_count": 1.0, "trip_distance": 2.5,
        "fare_amount": 10.0, "extra": 0.5, "mta_tax": 0.5, "tip_amount": 0.0, "tolls_amount": 0.0, "ehail_fee": None,
        "improvement_surcharge": 1.0, "total_amount": 12.0, "payment_type": 1.0, "trip_type": 1.0,
        "congestion_surcharge": 2.75, "cbd_congestion_fee": 0.75,
    }
    row.update(over)
    return tuple(row.values())


def trips(spark, *rows):
    return spark.createDataFrame(list(rows), TRIP)


def test_hard_excludes_keep_unknowns(spark):
    rows = trips(
        spark,
        trip(dt.datetime(2008, 12, 31, 23, 0)), trip(dt.datetime(2026, 2, 28, 23, 59)), trip(dt.datetime(2026, 6, 1)),
        trip(seconds=-60), trip(trip_distance=111005.95), trip(trip_distance=100000.0),
        trip(trip_distance=None), trip(None), trip(), trip(),
    )
    kept, excluded = clean.hard_excludes(rows, START, END)
    assert (kept.count(), excluded.count()) == (5, 5)
    assert records(kept) == records(rows.exceptAll(excluded))


def test_difference_by_filter_needs_no_shuffle_and_prunes_files(spark, tmp_path):
    trips(spark, trip()).write.parquet(str(tmp_path / "t"))
    kept, _ = clean.hard_excludes(spark.read.parquet(str(tmp_path / "t")), START, END)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    pushed = plan.split("PushedFilters:")[1]
    assert "GreaterThanOrEqual(lpep_pickup_datetime" in pushed


def test_types_and_flags(spark):
    rows = trips(
        spark,
        trip(VendorID=6, RatecodeID=None, passenger_count=None, payment_type=None, trip_type=None, store_and_fwd_flag=None),
        trip(seconds=0), trip(seconds=0, trip_distance=0.0, DOLocationID=264),
        trip(fare_amount=-1.0), trip(total_amount=-1.0, fare_amount=None), trip(tip_amount=-2.0), trip(passenger_count=0.0),
        trip(fare_amount=1.005, trip_distance=2.675), trip(seconds=None),
    )
    got = clean.clean_trips([rows], START, END)
    kinds = dict(got.dtypes)
    assert kinds["RatecodeID"] == "int" and kinds["trip_duration_min"] == "decimal(10,2)"
    set_flags = [[f for f in clean.TRIP_FLAGS if r[f]] for r in got.collect()]
    assert sorted(set_flags, key=str) == sorted([
        ["flag_vendor6_incomplete"], ["flag_zero_duration_nonzero_distance"], ["flag_no_real_dropoff"],
        ["flag_negative_fare"], ["flag_negative_fare"], ["flag_negative_tip"], ["flag_zero_passengers"], [], []], key=str)
    assert got.filter("fare_amount = 1.01 AND trip_distance = 2.68").count() == 1
    assert all(r[f] is not None for r in got.collect() for f in clean.TRIP_FLAGS)
    assert clean.for_measure(got, "passengers").count() == 7


def test_months_union_by_name(spark):
    march, april = trips(spark, trip()), trips(spark, trip(PULocationID=9))
    shuffled = april.select(*reversed(april.columns))
    assert records(clean.union_months([march, shuffled]), "PULocationID") == [(1,), (9,)]


def test_fact_duration_bounds(spark):
    rows = trips(spark, trip(seconds=60), trip(seconds=59), trip(seconds=86400), trip(seconds=86401), trip(seconds=None))
    fact = mart.fact_trip(clean.clean_trips([rows], START, END))
    assert records(fact, "trip_duration_min") == [(1.0,), (1440.0,)]
    assert fact.first().pickup_date_hour_key == 2026030510


@pytest.mark.parametrize("seconds", [61, 100, 3599, 12345, 86399])
def test_fact_duration_rounding(spark, seconds):
    fact = mart.fact_trip(trips(spark, trip(seconds=seconds)))
    exact = (decimal.Decimal(seconds) / 60).quantize(decimal.Decimal("0.01"), decimal.ROUND_HALF_UP)
    assert fact.first().trip_duration_min == float(exact)


def test_zone_spelling(spark):
    raw = spark.createDataFrame(
        [("1", " ewr ", "SOHO", "EWR"), ("2", "QUEENS", "JFK AIRPORT", "airports"), ("x", "n/a", "DUMBO/VINEGAR HILL", "boro zone"),
         ("265", None, "a/b c", "N/A")],
        "LocationID string, Borough string, Zone string, service_zone string")
    assert records(clean.clean_zones(raw)) == [
        (1, "EWR", "SoHo", "EWR"), (2, "Queens", "JFK Airport", "Airports"), (265, None, "A/b C", "N/a"),
        (None, "N/a", "DUMBO/Vinegar Hill", "Boro Zone")]
    assert mart.dim_zone(clean.clean_zones(raw)).count() == 3


def test_weather_clean(spark):
    hour = dt.datetime(2026, 3, 1, 5)
    raw = spark.createDataFrame(
        [(hour, 1.0, 0.0, 0.0, 0.0, 3, 1.0, 40.7, -73.9, " America/New_York ", 10.0)] * 2
        + [(None, 1.0, 0.0, 0.0, 0.0, 3, 1.0, 40.7, -73.9, "America/New_York", 10.0)],
        "observation_time timestamp_ntz, temperature_2m double, precipitation double, rain double, snowfall double, "
        "weather_code long, wind_speed_10m double, latitude double, longitude double, timezone string, elevation double")
    got = clean.clean_weather(raw).collect()
    assert len(got) == 1 and got[0].timezone == "America/New_York"
    assert mart.dim_weather(clean.clean_weather(raw)).first().date_hour_key == 2026030105


def test_dedup_is_deterministic_under_copies(spark):
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 2), (1, "a", 2), (2, "z", 1)], "k int, v string, o int")
    assert records(dedup.dedup_latest(rows, ("k",), (F.desc("o"), "v"))) == [(1, "a", 2), (2, "z", 1)]
    plan = dedup.dedup_latest(rows, ("k",), ("o", "v"))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


# --- BI ---------------------------------------------------------------------------------


FACT = ("pu_location_id int, do_location_id int, pickup_date_hour_key int, pickup_datetime timestamp_ntz, "
        "dropoff_datetime timestamp_ntz, pickup_hour int, dropoff_hour int, passenger_count int, trip_distance double, "
        "trip_duration_min double, fare_amount double, total_amount double")
ADVISORY = "advisory_id string, advisory_type string, borough string, effective_from date, effective_to date"
ZONE = "location_id int, borough string, zone string, service_zone string"


def ride(at, minutes=10, pu=1, do=2, total=10.0, miles=1.0):
    end = at + dt.timedelta(minutes=minutes)
    key = int(at.strftime("%Y%m%d%H"))
    return (pu, do, key, at, end, at.hour, end.hour, 1, miles, float(minutes), total, total)


@pytest.fixture
def zone(spark):
    return spark.createDataFrame([(1, "Bronx", "A", "b"), (2, " queens", "B", "b")], ZONE)


def day(n, hour=0, minute=0):
    return dt.datetime(2026, 3, n, hour, minute)


def test_advisory_window_ends_at_midnight(spark, zone):
    fact = spark.createDataFrame(
        [ride(day(4, 23)), ride(day(5)), ride(day(6, 12)), ride(day(7)), ride(day(7, 0, 1)), ride(day(8, 9))], FACT)
    advisory = spark.createDataFrame([("a", "construction", " BRONX ", dt.date(2026, 3, 5), dt.date(2026, 3, 7))], ADVISORY)
    counts = {r.advisory_type: r.total_trips for r in bi.advisory_impact(fact, zone, advisory).collect()}
    assert counts == {"construction": 3, "None": 3}
    counts = {r.advisory_type: r.total_trips for r in bi.advisory_impact(fact, zone, advisory, inclusive_end=True).collect()}
    assert counts == {"construction": 4, "None": 2}


def test_advisory_choice_and_identity(spark, zone):
    """Most recent advisory wins, ties by id; equal trips count once; NULL and 'None' stay apart."""
    fact = spark.createDataFrame(
        [ride(day(5, 10), total=30.0), ride(day(5, 10), total=20.0), ride(day(6, 10)), ride(day(9, 10)), ride(day(6, 10), pu=2)], FACT)
    advisory = spark.createDataFrame([
        ("c", "event", "Bronx", dt.date(2026, 3, 1), dt.date(2026, 3, 31)),
        ("b", "late", "bronx", dt.date(2026, 3, 5), dt.date(2026, 3, 6)),
        ("a", "early", "Bronx", dt.date(2026, 3, 5), dt.date(2026, 3, 6)),
        ("r", "reversed", "Bronx", dt.date(2026, 3, 9), dt.date(2026, 3, 6)),
        ("u", "undated", "Bronx", None, None),
        ("n", None, "Bronx", dt.date(2026, 3, 6), dt.date(2026, 3, 8)),
        ("x", "None", "Queens", dt.date(2026, 3, 6), dt.date(9999, 12, 31)),
    ], ADVISORY)
    got = [tuple(r) for r in bi.advisory_impact(fact, zone, advisory).collect()]
    assert sorted(got) == [
        (" queens", "None", 1, 10.0, 10.0), ("Bronx", "None", 1, 10.0, 10.0),
        ("Bronx", "early", 1, 10.0, 20.0), ("Bronx", "event", 1, 10.0, 10.0)]


def test_advisory_impact_equals_plain_range_join(spark, zone):
    """The per-day lookup against the range join it replaces, on many random windows."""
    import random

    rng = random.Random(7)
    fact = spark.createDataFrame(
        [ride(day(rng.randint(1, 28), rng.choice([0, 0, 7, 23]), rng.choice([0, 0, 59])), rng.randint(1, 99), rng.choice([1, 2]),
              rng.choice([1, 2]), rng.randint(1, 50) / 4) for _ in range(400)], FACT)
    advisory = spark.createDataFrame(
        [(f"id{i}", rng.choice(["construction", "event", None]), rng.choice(["bronx", "Queens ", "Crossings"]),
          *(lambda f: (f, f + dt.timedelta(days=rng.randint(-1, 6))))(dt.date(2026, 3, rng.randint(1, 28)))) for i in range(60)], ADVISORY)
    for view, df in (("f", fact), ("z", zone), ("a", advisory)):
        df.createOrReplaceTempView(f"plain_{view}")
    plain = spark.sql("""
        SELECT borough, coalesce(t, 'None') advisory_type, count(*) total_trips FROM (
          SELECT z.borough, a.advisory_type t, row_number() OVER (
            PARTITION BY pu_location_id, do_location_id, pickup_datetime, dropoff_datetime
            ORDER BY a.effective_from DESC NULLS LAST, a.advisory_id) rn
          FROM plain_f f JOIN plain_z z ON pu_location_id = location_id
          LEFT JOIN plain_a a ON lower(trim(a.borough)) = lower(trim(z.borough))
            AND pickup_datetime BETWEEN a.effective_from AND a.effective_to) WHERE rn = 1 GROUP BY borough, t""")
    assert records(bi.advisory_impact(fact, zone, advisory), "borough", "advisory_type", "total_trips") == records(plain)


def test_fact_is_reduced_before_joins(spark, zone):
    """Every join of the BI queries sits above an aggregation of the fact."""
    fact = spark.createDataFrame([ride(day(5, 10))], FACT)
    for df in (bi.borough_flows(fact, zone), bi.top_pickup_zones(fact, zone)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        last_join = plan.rindex("Join ")
        assert "Aggregate" in plan[last_join:]


def test_weather_fan_out_and_unknown_weather(spark):
    fact = spark.createDataFrame([ride(day(5, 10)), ride(day(5, 10), minutes=20), ride(day(5, 11))], FACT)
    weather = spark.createDataFrame(
        [(2026030510, 4.0, 1.0, 0.0), (2026030510, 6.0, 0.0, 2.0), (2026030511, None, None, None)],
        "date_hour_key int, temperature_2m double, precipitation double, snowfall double")
    got = {r.weather_condition: (r.avg_temperature_c, r.total_trips, r.avg_duration_minutes) for r in bi.weather_impact(fact, weather).collect()}
    assert got == {"Rain/Precipitation": (4.0, 2, 15.0), "Snow": (6.0, 2, 15.0), "Clear/Dry": (None, 1, 10.0)}


def test_kpi_over_nothing_and_zero_miles(spark):
    nothing = spark.createDataFrame([], FACT)
    assert tuple(bi.kpi_summary(nothing).first()) == (0, None, None, None, None, None, None)
    still = spark.createDataFrame([ride(day(5), miles=0.0)], FACT)
    assert bi.kpi_summary(still).first().revenue_per_mile is None


@pytest.mark.parametrize("max_rows", [100, 1])
def test_lookup_join_both_ways(spark, max_rows):
    """Broadcast below the bound, salted shuffle join beyond it: same rows, hot key included."""
    facts = spark.range(500).selectExpr("id", "if(id % 3 = 0, 7, int(id % 20)) AS k").unionAll(
        spark.range(5).selectExpr("id", "int(NULL) AS k"))
    lookup = spark.range(10).selectExpr("int(id) AS k", "concat('v', id) AS v")
    got = lookup_join(facts, lookup, ["k"], "left", max_rows=max_rows, salts=8)
    assert records(got, "id", "k", "v") == records(facts.join(lookup, "k", "left"), "id", "k", "v")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("Broadcast" in plan) or max_rows == 1


def test_hot_key_leaves_the_map_side_as_one_row(spark):
    """A third of the trips in one zone pair: what is shuffled is one row per pair and task."""
    rides = [ride(day(5, 10), pu=1 if i % 3 else 2, do=1) for i in range(900)]
    fact = spark.createDataFrame(rides, FACT).repartition(4)
    zones = spark.createDataFrame([(1, "Bronx", "A", "b"), (2, "Queens", "B", "b")], ZONE)
    flows = bi.borough_flows(fact, zones)
    plan = flows._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "partial_sum" in plan
    assert records(flows, "pickup_borough", "total_trips") == [("Bronx", 600), ("Queens", 300)]
