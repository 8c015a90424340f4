"""Advisory history that keeps every sighting: scrapes may arrive in any order, and as-of reads are exact.

A state row is a history row plus ``seen``, the sorted scrape dates on which the page
showed the advisory. Everything else in the row follows from them, so a merge recomputes
touched keys only and a late, repeated or reordered scrape ends in the same state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from kerbline.operators.history import _ATTRIBUTES, HISTORY_SCHEMA, KEY

SEEN = T.ArrayType(T.StructType([
    T.StructField("scrape_dt", T.DateType()), T.StructField("effective_to", T.DateType()), T.StructField("batch_id", T.StringType())]))
STATE_SCHEMA = T.StructType([*HISTORY_SCHEMA.fields, T.StructField("seen", SEEN)])
#: Days of a bucket in which intervals and asked days meet.
BUCKET_DAYS = 32


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE_SCHEMA)


def _folded(sightings: DataFrame) -> DataFrame:
    """Per advisory: its attributes on the first of these scrapes, and all of them in order."""
    return sightings.filter("scrape_dt IS NOT NULL").groupBy(KEY).agg(
        F.min_by(F.struct(*_ATTRIBUTES), "scrape_dt").alias("_first"),
        F.array_sort(F.collect_list(F.struct("scrape_dt", "effective_to", "batch_id"))).cast(SEEN).alias("_seen"),
    )


def merge_state(state: DataFrame, sightings: DataFrame, latest: Column | None = None, now: Column | None = None) -> DataFrame:
    """State after the staged ``sightings`` (one or several scrapes, of any dates).

    A scrape date that a row already holds changes nothing, so replays are harmless. An
    earlier date than the first moves the first sighting and brings its attributes along.
    ``latest`` is the newest scrape date of all (default: the newest on either side); rows
    not seen then are closed. Sightings without a scrape date are left out.
    """
    now = F.current_timestamp() if now is None else now
    if latest is None:
        latest = F.greatest(
            sightings.agg(F.max("scrape_dt").alias("d")).scalar(), state.agg(F.max("last_seen_scrape").alias("d")).scalar())
    joined = state.select(*HISTORY_SCHEMA.fieldNames(), F.col("seen").alias("_old")).join(_folded(sightings), KEY, "full_outer")
    old = F.coalesce(F.col("_old"), F.array().cast(SEEN))
    dates = F.transform(old, lambda s: s["scrape_dt"])
    fresh = F.filter(F.coalesce(F.col("_seen"), F.array().cast(SEEN)), lambda s: ~F.array_contains(dates, s["scrape_dt"]))
    joined = joined.withColumns({"_fresh": fresh, "_kept": old})
    joined = joined.withColumn("seen", F.array_sort(F.concat("_kept", "_fresh")))
    earlier = F.col("_old").isNull() | F.coalesce(F.get("_fresh", F.lit(0))["scrape_dt"] < F.col("first_seen_scrape"), F.lit(False))
    newest = F.element_at("seen", -1)
    ends = F.filter(F.transform("seen", lambda s: s["effective_to"]), lambda d: d.isNotNull())
    shown = newest["scrape_dt"] >= latest
    touched = (F.size("_fresh") > 0) | (F.col("is_current") != shown)
    values = {c: F.when(earlier, F.col(f"_first.{c}")).otherwise(F.col(c)) for c in _ATTRIBUTES}
    values |= {
        KEY: F.col(KEY), "effective_to": F.try_element_at(ends, F.lit(-1)),
        "first_seen_scrape": F.get("seen", F.lit(0))["scrape_dt"], "last_seen_scrape": newest["scrape_dt"], "is_current": shown,
        "times_seen": F.size("seen").cast("int"), "batch_id": newest["batch_id"], "seen": F.col("seen"),
        "ingested_at": F.when(touched, now).otherwise(F.col("ingested_at")),
    }
    return joined.select(*[values[f.name].alias(f.name) for f in STATE_SCHEMA])


def changed_rows(state: DataFrame, sightings: DataFrame, now: Column | None = None) -> DataFrame:
    """The rows that a merge would insert or alter: new, seen again, and newly closed advisories.

    Reads the current rows, and of the closed ones those that the sightings name.
    """
    now = F.current_timestamp() if now is None else now
    current, closed = state.filter("is_current"), state.filter("NOT is_current")
    named = sightings.select(KEY).distinct()
    reach = current.unionByName(closed.join(named, KEY, "left_semi"))
    latest = F.greatest(
        sightings.agg(F.max("scrape_dt").alias("d")).scalar(), current.agg(F.max("last_seen_scrape").alias("d")).scalar())
    merged = merge_state(reach, sightings, latest, now)
    before = reach.select(F.col(KEY).alias("_key"), F.col("times_seen").alias("_times"), F.col("is_current").alias("_current"))
    same = F.col("_key").isNotNull() & (F.col("_times") == F.col("times_seen")) & (F.col("_current") == F.col("is_current"))
    return merged.join(before, F.col(KEY) == F.col("_key"), "left").filter(~same).select(*STATE_SCHEMA.fieldNames())


def as_history(state: DataFrame) -> DataFrame:
    """The state in the shape of the history."""
    return state.select(*HISTORY_SCHEMA.fieldNames())


def scrape_days(state: DataFrame) -> DataFrame:
    """Every scrape date with the next one: (scrape_dt, ordinal, next_dt). One row per scrape."""
    days = state.select(F.explode("seen.scrape_dt").alias("scrape_dt")).distinct()
    return days.selectExpr(
        "scrape_dt", "row_number() OVER (ORDER BY scrape_dt) AS ordinal", "lead(scrape_dt) OVER (ORDER BY scrape_dt) AS next_dt")


def validity(state: DataFrame) -> DataFrame:
    """(closure_bk, valid_from, valid_to, scrapes): stretches without a gap in which the page showed an advisory.

    ``valid_to`` is the date of the first scrape without it (exclusive), NULL while it is still
    shown. Sightings on neighbouring scrapes have neighbouring ordinals, so ordinal minus
    running number is the same within a stretch.
    """
    seen = state.select(KEY, F.explode("seen.scrape_dt").alias("scrape_dt")).join(scrape_days(state), "scrape_dt")
    placed = seen.withColumn("_island", F.expr(f"ordinal - row_number() OVER (PARTITION BY {KEY} ORDER BY ordinal)"))
    return placed.groupBy(KEY, "_island").agg(
        F.min("scrape_dt").alias("valid_from"), F.max_by("next_dt", "ordinal").alias("valid_to"), F.count(F.lit(1)).alias("scrapes"),
    ).select(KEY, "valid_from", "valid_to", "scrapes")


def valid_at(intervals: DataFrame, day: str) -> DataFrame:
    """Stretches in force on a day: what the last scrape up to it showed, exactly."""
    at = F.lit(day).cast("date")
    return intervals.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def asked(intervals: DataFrame, asks: DataFrame, day: str = "day", bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """The ``asks`` (closure_bk, ``day``, ...) with ``shown``: whether the page showed the advisory that day.

    Intervals are cut to the asked days and spread over buckets of days, and meet the asks
    by key and bucket: an equi-join whatever the length of an interval. A NULL key or day is
    not shown; repeated asks are answered each.
    """
    bounds = asks.agg(F.min(day).alias("low"), F.max(day).alias("high"))
    cut = intervals.filter(F.col("valid_from") <= bounds.select("high").scalar()).withColumns({
        "_from": F.greatest("valid_from", bounds.select("low").scalar()),
        "_to": F.least(F.coalesce(F.date_sub("valid_to", 1), bounds.select("high").scalar()), bounds.select("high").scalar()),
    }).filter("_from <= _to")
    number = lambda c: F.floor(F.unix_date(c) / bucket_days)
    spread = cut.withColumn("_bucket", F.explode(F.sequence(number("_from"), number("_to")))).select(KEY, "_bucket", "_from", "_to")
    # Intervals of a key do not overlap, so an ask meets at most one.
    numbered = asks.withColumn("_bucket", number(day))
    met = numbered.alias("a").join(
        spread.alias("i"),
        (F.col(f"a.{KEY}") == F.col(f"i.{KEY}")) & (F.col("a._bucket") == F.col("i._bucket")) & F.col(f"a.{day}").between(F.col("i._from"), F.col("i._to")), "left")
    return met.select(*[F.col(f"a.{c}") for c in asks.columns], F.col(f"i.{KEY}").isNotNull().alias("shown"))
