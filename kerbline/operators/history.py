"""Advisory history: idempotent loads and one row per advisory with first/last sighting.

Every function takes and returns DataFrames; ``sources.tables.publish_version`` stores
a result. With the history bucketed by ``closure_bk`` an upsert shuffles the batch only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from kerbline.functions.keys import advisory_key
from kerbline.operators.dedup import dedup_latest

HISTORY_SCHEMA = T.StructType([
    T.StructField("closure_bk", T.StringType(), True, {"comment": "advisory key: section, location, label, text"}),
    T.StructField("section_id", T.StringType()),
    T.StructField("section_name", T.StringType()),
    T.StructField("borough", T.StringType(), True, {"comment": "primary borough of the section"}),
    T.StructField("location_name", T.StringType()),
    T.StructField("entry_type", T.StringType(), True, {"comment": "construction or event"}),
    T.StructField("detail_label", T.StringType()),
    T.StructField("street_name", T.StringType()),
    T.StructField("from_street", T.StringType()),
    T.StructField("to_street", T.StringType()),
    T.StructField("advisory_text", T.StringType()),
    T.StructField("effective_from", T.DateType(), True, {"comment": "first date the text names"}),
    T.StructField("effective_to", T.DateType(), True, {"comment": "last date the text names"}),
    T.StructField("advisory_week_start", T.DateType()),
    T.StructField("advisory_week_end", T.DateType()),
    T.StructField("first_seen_scrape", T.DateType()),
    T.StructField("last_seen_scrape", T.DateType()),
    T.StructField("is_current", T.BooleanType(), True, {"comment": "false once it left the page"}),
    T.StructField("times_seen", T.IntegerType()),
    T.StructField("source_system", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("ingested_at", T.TimestampType()),
    T.StructField("batch_id", T.StringType()),
])

KEY = "closure_bk"
#: What an advisory looks like; taken from its first sighting and never changed later.
_ATTRIBUTES = (
    "section_id", "section_name", "borough", "location_name", "entry_type", "detail_label",
    "street_name", "from_street", "to_street", "advisory_text", "effective_from",
    "advisory_week_start", "advisory_week_end", "source_system", "source_url",
)


def empty_history(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], HISTORY_SCHEMA)


def insert_new(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Target plus the batch rows whose key it lacks; matched rows stay as they are.

    The batch must be unique by key (see ``dedup_latest``). Only the key column of the
    target takes part in the join.
    """
    fresh = batch.join(target.select(key), key, "left_anti").select(*target.columns)
    return target.unionByName(fresh)


def latest_batch(df: DataFrame, column: str = "scrape_date") -> DataFrame:
    """Rows of the newest batch. The scalar subquery reaches the scan as a filter value,
    so files or partitions of older batches are skipped."""
    newest = df.agg(F.max(column).alias("newest")).scalar()
    return df.filter(F.col(column) == newest)


def pending_scrapes(raw: DataFrame, history: DataFrame, column: str = "scrape_date") -> DataFrame:
    """Raw rows of every scrape later than the newest one merged into the history.

    The bound is a scalar subquery on the partition column, so merged scrapes are not read.
    """
    merged = history.agg(F.coalesce(F.max("last_seen_scrape").cast("string"), F.lit("")).alias("d")).scalar()
    return raw.filter(F.col(column) > merged)


def has_gaps(raw: DataFrame, history: DataFrame, column: str = "scrape_date") -> bool:
    """Whether scrapes up to the newest merged one hold sightings that the history lacks.

    A scrape that lands late, with an older date, cannot be folded in by date: first and last
    sightings and counts of later scrapes already stand. Each merged sighting counts once in
    ``times_seen``, so the two totals agree exactly when nothing was missed.
    """
    state = history.agg(F.max("last_seen_scrape").cast("string").alias("newest"), F.sum("times_seen").alias("counted"))
    due = raw.filter(F.col(column) <= state.select("newest").scalar()).agg(F.count(F.lit(1)).alias("n"))
    return due.select((F.col("n") != F.coalesce(state.select("counted").scalar(), F.lit(0))).alias("gap")).first()["gap"]


def primary_borough(section: Column) -> Column:
    """The first borough a section names; bridge sections count as "Crossings"."""
    return F.when(section.like("%Crossings%"), F.lit("Crossings")).otherwise(F.split(section, "/")[0])


def stage_history(raw: DataFrame, unique: bool = False) -> DataFrame:
    """Raw entries to typed sightings, at most one per advisory and scrape date.

    ``unique`` promises that the raw table is unique by sighting key, as ``load_scrape``
    leaves it; staging is then row-local. Otherwise sightings are deduplicated here.
    """

    def day(name: str) -> Column:
        return F.col(name).try_cast("date")

    staged = raw.select(
        advisory_key().alias(KEY),
        "section_id", "section_name",
        primary_borough(F.col("section_name")).alias("borough"),
        "location_name", "entry_type", "detail_label", "street_name", "from_street", "to_street",
        "advisory_text",
        day("date_first_mentioned").alias("effective_from"),
        day("date_last_mentioned").alias("effective_to"),
        day("advisory_week_start").alias("advisory_week_start"),
        day("advisory_week_end").alias("advisory_week_end"),
        day("scrape_date").alias("scrape_dt"),
        "source_system", "source_url", "batch_id",
    )
    if unique:
        return staged
    rest = [c for c in staged.columns if c not in (KEY, "scrape_dt")]
    return dedup_latest(staged, (KEY, "scrape_dt"), rest)


def apply_sightings(
    history: DataFrame, sightings: DataFrame, latest: Column | None = None, now: Column | None = None
) -> DataFrame:
    """Upsert staged sightings (one or several scrape dates) into the history.

    * A sighting newer than ``last_seen_scrape`` moves it, counts once, re-opens the
      row and brings its ``effective_to`` and batch along.
    * Any other sighting only touches the row, so a rerun changes no count.
    * An advisory not held yet is inserted from its first sighting.
    * Rows last seen before ``latest`` (default: the newest scrape on either side) are
      closed, never deleted.

    One full outer join on the key; both sides are unique by key, so no key is hot.
    """
    now = F.current_timestamp() if now is None else now
    attributes = F.struct(*[F.col(c) for c in _ATTRIBUTES])
    # The list per advisory holds one slot per scrape date of this batch.
    delta = sightings.groupBy(KEY).agg(
        F.min_by(attributes, "scrape_dt").alias("_first"),
        F.array_sort(
            F.collect_list(F.struct("scrape_dt", "effective_to", "batch_id"))
        ).alias("_seen"),
    )
    if latest is None:
        latest = F.greatest(
            sightings.agg(F.max("scrape_dt").alias("d")).scalar(),
            history.agg(F.max("last_seen_scrape").alias("d")).scalar(),
        )

    joined = history.withColumn("_held", F.lit(True)).join(delta, KEY, "full_outer")
    held, matched = F.col("_held").isNotNull(), F.col("_seen").isNotNull()
    newer = F.filter(
        F.coalesce(F.col("_seen"), F.array().cast(delta.schema["_seen"].dataType)),
        lambda s: F.col("last_seen_scrape").isNull() | (s["scrape_dt"] > F.col("last_seen_scrape")),
    )
    staged = joined.withColumn("_newer", newer)
    moved = F.size("_newer") > 0
    newest = F.try_element_at(F.col("_newer"), F.lit(-1))
    ends = F.filter(F.transform("_newer", lambda s: s["effective_to"]), lambda d: d.isNotNull())
    last_seen = F.when(moved, newest["scrape_dt"]).otherwise(F.col("last_seen_scrape"))
    still_shown = last_seen >= latest
    touched = matched | (F.col("is_current") != still_shown)

    values = {c: F.when(held, F.col(c)).otherwise(F.col(f"_first.{c}")) for c in _ATTRIBUTES}
    values |= {
        "effective_to": F.coalesce(F.try_element_at(ends, F.lit(-1)), F.col("effective_to")),
        "first_seen_scrape": F.coalesce(F.col("first_seen_scrape"), F.get("_newer", F.lit(0))["scrape_dt"]),
        "last_seen_scrape": last_seen,
        "is_current": still_shown,
        "times_seen": (F.coalesce(F.col("times_seen"), F.lit(0)) + F.size("_newer")).cast("int"),
        "ingested_at": F.when(touched, now).otherwise(F.col("ingested_at")),
        "batch_id": F.when(moved, newest["batch_id"]).otherwise(F.col("batch_id")),
        KEY: F.col(KEY),
    }
    return staged.select(*[values[f.name].alias(f.name) for f in HISTORY_SCHEMA])


def close_missing(history: DataFrame, latest: Column) -> DataFrame:
    """Close rows last seen before the newest scrape (also part of ``apply_sightings``)."""
    return history.withColumn(
        "is_current", F.when(F.col("last_seen_scrape") < latest, F.lit(False)).otherwise(F.col("is_current"))
    )


def rebuild_history(sightings: DataFrame, now: Column | None = None) -> DataFrame:
    """The whole history from all staged sightings in one aggregation.

    Equals applying every scrape in order, and repairs histories that skipped one.
    """
    now = F.current_timestamp() if now is None else now
    latest = sightings.agg(F.max("scrape_dt").alias("d")).scalar()
    attributes = F.struct(*[F.col(c) for c in _ATTRIBUTES])
    end_date = F.when(F.col("effective_to").isNotNull(), F.col("scrape_dt"))
    rolled = sightings.groupBy(KEY).agg(
        F.min_by(attributes, "scrape_dt").alias("_first"),
        F.max_by("effective_to", end_date).alias("effective_to"),
        F.min("scrape_dt").alias("first_seen_scrape"),
        F.max("scrape_dt").alias("last_seen_scrape"),
        F.count(F.lit(1)).cast("int").alias("times_seen"),
        F.max_by("batch_id", "scrape_dt").alias("batch_id"),
    )
    return rolled.select(
        KEY, "_first.*", "effective_to", "first_seen_scrape", "last_seen_scrape",
        (F.col("last_seen_scrape") >= latest).alias("is_current"),
        "times_seen", now.alias("ingested_at"), "batch_id",
    ).select(*HISTORY_SCHEMA.fieldNames())


def history_summary(history: DataFrame) -> DataFrame:
    """Rows, current rows and scrape dates that contributed a new advisory."""
    return history.agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.count_if("is_current").alias("rows_current"),
        F.countDistinct("first_seen_scrape").alias("scrapes_held"),
    )


def scrape_report(raw: DataFrame) -> DataFrame:
    """Per scrape date: rows landed, distinct keys (equal on an idempotent load), locations.

    One scan; rows without a scrape date are a group of their own.
    """
    return raw.groupBy("scrape_date").agg(
        F.count(F.lit(1)).alias("rows_landed"),
        F.countDistinct("advisory_sk").alias("distinct_keys"),
        F.countDistinct("location_name").alias("locations"),
    )


def idempotency_report(raw: DataFrame, history: DataFrame) -> DataFrame:
    """Rows held against distinct keys: raw by scrape date, clean by times seen."""

    def held(df: DataFrame, measure: str, group: str, key: str) -> DataFrame:
        return df.groupBy(F.col(group).cast("string").alias("grouping")).agg(
            F.count(F.lit(1)).alias("rows_held"), F.countDistinct(key).alias("distinct_keys")
        ).select(F.lit(measure).alias("measure"), "grouping", "rows_held", "distinct_keys")

    return held(raw, "raw rows per scrape date", "scrape_date", "advisory_sk").unionByName(
        held(history, "clean rows by times_seen", "times_seen", KEY)
    )


def shown_as_of(raw: DataFrame, day: str, column: str = "scrape_date") -> DataFrame:
    """What the page said on a day: the raw rows of the last scrape up to it (exact)."""
    known = raw.filter(F.col(column) <= F.lit(day).cast(raw.schema[column].dataType))
    return latest_batch(known, column)


def history_as_of(history: DataFrame, day: str) -> DataFrame:
    """Advisories first seen by a day and last seen on or after it. Approximate: weeks an
    advisory was off the page in between are not recorded in the history."""
    at = F.lit(day).cast("date")
    return history.filter((F.col("first_seen_scrape") <= at) & (F.col("last_seen_scrape") >= at))


def current_only(history: DataFrame) -> DataFrame:
    return history.filter("is_current")


def load_scrape(
    entries: DataFrame, raw: DataFrame | None, key: str = "advisory_sk", order: Sequence[str] = ("location_name",)
) -> DataFrame:
    """Raw load of one scrape: deduplicate in the batch, then insert what is not held."""
    tie_break = [c for c in sorted(entries.columns) if c not in (key, "ingested_at", *order)]
    batch = dedup_latest(entries, (key,), (*order, *tie_break))
    return batch if raw is None else insert_new(raw, batch, key)
