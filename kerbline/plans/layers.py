"""Layer builds: raw batches in, clean tables, mart, BI outputs and validation results out.

Each step reads stored tables of the layer before it and writes its own, so every step
can be run again alone, and dimensions are scanned with known sizes by the steps behind.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from kerbline.operators import bi, clean, history as hist, mart, profile, rollup, rules
from kerbline.sources import tables

# --- fixed values: stored table names -------------------------------------------------
RAW_WEATHER, RAW_ZONES, RAW_ADVISORY = "raw.weather", "raw.taxi_zones", "raw.traffic_advisory"
CLEAN_TRIPS, CLEAN_WEATHER = "clean.green_taxi", "clean.weather_silver"
CLEAN_ZONES, CLEAN_ADVISORY = "clean.taxi_zones", "clean.traffic_advisory"
DIMS = ("dim_advisory", "dim_date", "dim_weather", "dim_zone")
BI_TABLES = ("borough_flow_analytics", "top_pickup_zones", "temporal_patterns_and_behaviors",
             "weather_impact_analysis", "traffic_advisory_and_incident_impact", "kpi_summary")
VALIDATION = {"Green Taxi": "green_taxi_validation", "Weather": "weather_validation",
              "Taxi Zones": "taxi_zones_validation", "Traffic Advisory": "traffic_advisory_validation"}
CLEAN_QUALITY, MART_QUALITY = "validation.clean_layer_quality", "validation.mart_layer_quality"
# --------------------------------------------------------------------------------------
#: Column by which trips and the fact are stored, and files that a day is spread over.
PICKUP_DATE, FILES_PER_DAY = "pickup_date", 8


@dataclass(frozen=True)
class Layers:
    """The layers of one catalog. ``prefix`` is put in front of every schema name,
    ``history_buckets`` lays the advisory history out for shuffle-free upserts."""

    spark: SparkSession
    window_start: str
    window_end: str
    prefix: str = ""
    history_buckets: int | None = None

    def name(self, table: str) -> str:
        return f"{self.prefix}{table}"

    def table(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def publish(self, df: DataFrame, table: str, day_of: str | None = None) -> DataFrame:
        """Rebuild a table as a new version; a job that is lost half way leaves the old one readable.

        ``day_of`` names a time by whose date (``pickup_date``, last column) rows are stored.
        """
        if day_of is None:
            return tables.publish_version(df, self.name(table))
        dated = df.withColumn(PICKUP_DATE, F.col(day_of).cast("date"))
        # One writer per day and hash range, else every task opens a file for every day.
        spread = dated.repartition(PICKUP_DATE, F.pmod(F.xxhash64(*df.columns), F.lit(FILES_PER_DAY)))
        return tables.publish_version(spread, self.name(table), partition_by=(PICKUP_DATE,))

    def prepare(self) -> None:
        tables.ensure_schemas(self.spark, prefix=self.prefix)

    # -- raw -----------------------------------------------------------------------------

    def land(self, table: str, df: DataFrame, source_system: str, batch_id: str, time_col: str | None = None) -> dict:
        """Replace one raw table by a batch, as a new version; reports rows and time range of that write."""
        tables.require_rows(df, f"{table}: empty batch {batch_id}, nothing written")
        stamped = tables.with_provenance(df, source_system, batch_id)
        return tables.publish_reporting(stamped, self.name(table), time_col)

    def land_scrape(self, entries: DataFrame, source_system: str, batch_id: str) -> DataFrame:
        """Append the entries of a scrape that are not held yet."""
        tables.require_rows(entries, f"no advisory entries in {batch_id}: has the page markup changed?")
        stamped = tables.with_provenance(entries, source_system, batch_id)
        span = entries.agg(F.min("scrape_date"), F.max("scrape_date")).first()
        return tables.append_new(
            hist.load_scrape(stamped, None), self.name(RAW_ADVISORY), "advisory_sk", "scrape_date", span=tuple(span))

    # -- clean ---------------------------------------------------------------------------

    def build_clean(self, months: list[str]) -> None:
        raw_months = [self.table(m) for m in months]
        self.publish(clean.clean_trips(raw_months, self.window_start, self.window_end), CLEAN_TRIPS, clean.PICKUP)
        self.publish(clean.clean_weather(self.table(RAW_WEATHER)), CLEAN_WEATHER)
        self.publish(clean.clean_zones(self.table(RAW_ZONES)), CLEAN_ZONES)
        self.merge_advisories()

    def merge_advisories(self, rebuild: bool = False) -> DataFrame:
        """Merge every scrape landed since the last merge into the history.

        The history is rebuilt from all scrapes when there is none yet, when asked for, or
        when a scrape landed late with a date before one that is already merged.
        """
        raw, name = self.table(RAW_ADVISORY), self.name(CLEAN_ADVISORY)
        if rebuild or not self.spark.catalog.tableExists(name) or hist.has_gaps(raw, self.spark.table(name)):
            merged = hist.rebuild_history(hist.stage_history(raw, unique=True))
        else:
            held = self.spark.table(name)
            merged = hist.apply_sightings(held, hist.stage_history(hist.pending_scrapes(raw, held), unique=True))
        buckets = (self.history_buckets, hist.KEY) if self.history_buckets else None
        return tables.publish_version(merged, name, bucket_by=buckets)

    # -- mart and BI ---------------------------------------------------------------------

    def build_mart(self) -> None:
        trips = self.table(CLEAN_TRIPS)
        built = {
            "dim_advisory": mart.dim_advisory(self.table(CLEAN_ADVISORY)),
            "dim_date": mart.dim_date(trips),
            "dim_weather": mart.dim_weather(self.table(CLEAN_WEATHER)),
            "dim_zone": mart.dim_zone(self.table(CLEAN_ZONES)),
            "fact_trip": mart.fact_trip(trips),
        }
        for table, df in built.items():
            self.publish(df, f"mart.{table}", "pickup_datetime" if table == "fact_trip" else None)

    def bi_outputs(self) -> dict[str, DataFrame]:
        fact = self.table("mart.fact_trip")
        advisory, date, weather, zone = (self.table(f"mart.{d}") for d in DIMS)
        return dict(zip(BI_TABLES, (
            bi.borough_flows(fact, zone),
            bi.top_pickup_zones(fact, zone),
            bi.temporal_patterns(fact, date),
            bi.weather_impact(fact, weather),
            bi.advisory_impact(fact, zone, advisory, days=(self.window_start, self.window_end)),
            bi.kpi_summary(fact),
        )))

    def build_bi(self) -> None:
        for table, df in self.bi_outputs().items():
            self.publish(df, f"bi_visualization.{table}")

    # -- validation ----------------------------------------------------------------------

    def profile_raw(self) -> DataFrame:
        """Profile of every column of every raw table."""
        return self.publish(profile.profile_schema(self.spark, f"{self.prefix}raw"), "validation.profile_source_data")

    def validate_clean(self) -> DataFrame:
        """Run the four rule sets, store each result, and publish them as one view."""
        results = {
            "Green Taxi": rules.trip_checks(self.table(CLEAN_TRIPS), self.window_start, self.window_end),
            "Weather": rules.weather_checks(self.table(CLEAN_WEATHER)),
            "Taxi Zones": rules.zone_checks(self.table(RAW_ZONES), self.table(CLEAN_ZONES)),
            "Traffic Advisory": rules.advisory_checks(self.table(RAW_ADVISORY), self.table(CLEAN_ADVISORY)),
        }
        names = {dataset: self.name(f"validation.{table}") for dataset, table in VALIDATION.items()}
        for dataset, df in results.items():
            self.publish(df, f"validation.{VALIDATION[dataset]}")
        unified = tables.create_view(self.spark, self.name(CLEAN_QUALITY), rollup.unified_query(names))
        self.publish_rollups(unified, "clean")
        return unified

    def validate_mart(self) -> DataFrame:
        dims = {dim: self.table(f"mart.{dim}") for dim in DIMS}
        outputs = {t: self.table(f"bi_visualization.{t}") for t in BI_TABLES}
        checks = rules.mart_checks(self.table("mart.fact_trip"), dims, outputs)
        stored = self.publish(checks, MART_QUALITY)
        self.publish_rollups(stored, "mart")
        return stored

    def publish_rollups(self, results: DataFrame, layer: str) -> None:
        """The dashboard's rollups of one layer's results, stored under ``dq_visualization``."""
        for name, rolled in {
            "status_totals": rollup.status_totals(results),
            "by_dataset_status": rollup.by_dataset_status(results),
            "by_dimension": rollup.by_dimension(results),
            "issues": rollup.issues(results),
        }.items():
            self.publish(rolled, f"dq_visualization.{layer}_{name}")

    def run(self, months: Mapping[str, DataFrame], weather: DataFrame, zones: DataFrame, entries: DataFrame, batch_id: str) -> None:
        """Everything once, in dependency order. ``entries`` may hold several scrapes."""
        self.prepare()
        for table, df in months.items():
            self.land(table, df, "trip_records", batch_id, clean.PICKUP)
        self.land(RAW_WEATHER, weather, "weather_api", batch_id, "observation_time")
        self.land(RAW_ZONES, zones, "zone_lookup", batch_id)
        self.land_scrape(entries, "advisory_pages", batch_id)
        self.profile_raw()
        self.build_clean(list(months))
        self.build_mart()
        self.build_bi()
        self.validate_clean()
        self.validate_mart()

