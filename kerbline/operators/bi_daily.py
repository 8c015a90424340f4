"""BI answers from stored daily partial sums, of which only changed days are computed again.

Every measure of the BI set merges from sums of whole hundredths and counts, so trips are
reduced once per day, by zone pair and by pickup hour, and the five questions read these
two small tables. A day is recomputed when its fact files are others than those its
partial sums came from.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from kerbline.functions.numeric import partials
from kerbline.operators import bi

DAY, VERSION = "pickup_date", "_version"
MEASURES = ("trip_distance", "trip_duration_min", "fare_amount", "total_amount")
_KEYS = {"pairs": ("pu_location_id", "do_location_id"), "hours": ("pickup_date_hour_key", "pickup_hour")}


def reduced(fact: DataFrame, kind: str) -> DataFrame:
    """Trips by day and the keys of ``kind`` (``pairs`` or ``hours``): count, passengers and partial sums."""
    return fact.groupBy(DAY, *_KEYS[kind]).agg(
        F.count(F.lit(1)).alias(bi.TRIPS), F.sum("passenger_count").alias("_passengers"), *partials(*MEASURES))


def day_versions(fact: DataFrame) -> dict[str, str]:
    """For each day of a fact stored by ``pickup_date`` a digest of its files' names, sizes and times; reads no data."""
    spark = fact.sparkSession
    conf = spark._jsc.hadoopConfiguration()
    found: dict[str, list[str]] = {}
    for file in fact.inputFiles():
        day = next(p.partition("=")[2] for p in file.split("/") if p.startswith(f"{DAY}="))
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        status = path.getFileSystem(conf).getFileStatus(path)
        found.setdefault(day, []).append(f"{file} {status.getLen()} {status.getModificationTime()}")
    return {day: hashlib.sha256("\n".join(sorted(files)).encode()).hexdigest()[:16] for day, files in found.items()}


@dataclass(frozen=True)
class DailyBI:
    """Partial sums under the table names ``<name>_pairs`` and ``<name>_hours``, stored by day.

    ``folder`` puts their files outside the warehouse.
    """

    spark: SparkSession
    name: str
    folder: str | None = None

    def table(self, kind: str) -> DataFrame:
        """Partial sums of all days; days that are gone have no rows."""
        return self.spark.table(f"{self.name}_{kind}")

    def _held(self) -> dict[str, str]:
        if not self.spark.catalog.tableExists(f"{self.name}_hours"):
            return {}
        rows = self.table("hours").select(F.col(DAY).cast("string").alias("d"), VERSION).distinct().collect()  # a row a day
        return {r["d"]: r[VERSION] for r in rows}

    def refresh(self, fact: DataFrame) -> list[str]:
        """Bring the partial sums up to date with the stored ``fact``; returns the days that were computed.

        Only the partitions of these days are read. The hours are written last and hold the
        versions, so a refresh that was lost half way is done again.
        """
        now, held = day_versions(fact), self._held()
        changed = sorted(day for day, version in now.items() if held.get(day) != version)
        gone = sorted(set(held) - set(now))
        days = fact.filter(F.col(DAY).isin([_date(d) for d in changed]))
        versions = F.create_map(*[F.lit(x) for d in changed for x in (d, now[d])]) if changed else F.lit(None)
        for kind in _KEYS:
            table = f"{self.name}_{kind}"
            rows = reduced(days, kind).withColumn(VERSION, versions[F.col(DAY).cast("string")] if changed else F.lit(None).cast("string"))
            if not self.spark.catalog.tableExists(table):
                writer = rows.limit(0).write.format("parquet").partitionBy(DAY)
                (writer.option("path", f"{self.folder}/{kind}") if self.folder else writer).saveAsTable(table)
            columns = self.spark.table(table).columns
            if changed:
                self._overwrite(rows.select(*columns).repartition(DAY), table)
            for day in gone:
                none = ", ".join(f"CAST(NULL AS {rows.schema[c].dataType.simpleString()})" for c in columns if c != DAY)
                self.spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({DAY} = DATE'{day}') SELECT {none} FROM range(0)")
        return changed

    def _overwrite(self, rows: DataFrame, table: str) -> None:
        """Replace the partitions that ``rows`` has, and no others."""
        key = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "dynamic")
        try:
            rows.write.mode("overwrite").insertInto(table)
        finally:
            self.spark.conf.set(key, before)

    # -- questions ---------------------------------------------------------------------

    def borough_flows(self, zone: DataFrame) -> DataFrame:
        return bi.flows_of(self.table("pairs"), zone)

    def top_pickup_zones(self, zone: DataFrame, k: int | None = None) -> DataFrame:
        return bi.zones_of(self.table("pairs"), zone, k)

    def temporal_patterns(self, date: DataFrame) -> DataFrame:
        return bi.patterns_of(self.table("hours"), date)

    def weather_impact(self, weather: DataFrame) -> DataFrame:
        return bi.impact_of(self.table("hours"), weather)

    def kpi_summary(self) -> DataFrame:
        return bi.kpi_of(self.table("hours"))


def _date(day: str):
    return F.lit(day).cast("date")
