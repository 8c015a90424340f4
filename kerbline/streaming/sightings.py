"""Weekly scrapes as a stream: the batch operators called per micro-batch.

A scrape is naturally incremental. ``Trigger.AvailableNow`` works off what has landed and
stops; a micro-batch may hold one scrape or several, of any dates. The history keeps every
sighting (``operators.sighting_state``), so late and reordered scrapes end in the same rows,
and is stored in cells (``sources.cells``), so a micro-batch rewrites what it touches. Both
writes are idempotent: a micro-batch that is replayed after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kerbline.operators import history as hist, sighting_state as states
from kerbline.sources import tables
from kerbline.sources.cells import CellTable

BUCKETS = 64


def read_scrapes(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Stream of raw advisory entries from a folder of landed Parquet files.

    Each micro-batch is one merge into the history, so it should take in many files.
    """
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def history_cells(spark: SparkSession, history_table: str, buckets: int = BUCKETS, folder: str | None = None) -> CellTable:
    """Where the history is stored; ``folder`` (default: in the warehouse) is shared by all executors."""
    home = folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{history_table.replace('.', '__')}__cells"
    return CellTable(spark, history_table, home, hist.KEY, "is_current", buckets)


def merge_sightings(cells: CellTable, sightings: DataFrame) -> dict[str, int]:
    """Fold staged sightings into the stored history; reports the cells that were written."""
    state = cells.read() if cells.exists() else states.empty_state(cells.spark)
    return cells.upsert(states.changed_rows(state, sightings))


def merge_scrapes(
    batch: DataFrame, raw_table: str, history_table: str, buckets: int | None = None, folder: str | None = None
) -> None:
    """Load the entries of a micro-batch into the raw table and the history."""
    if batch.isEmpty():
        return
    spark = batch.sparkSession
    landed = hist.load_scrape(batch, None)
    tables.append_new(landed, raw_table, "advisory_sk", "scrape_date")
    merge_sightings(history_cells(spark, history_table, buckets or BUCKETS, folder), hist.stage_history(landed, unique=True))


def stream_scrapes(
    entries: DataFrame, raw_table: str, history_table: str, checkpoint: str, buckets: int | None = None, folder: str | None = None
) -> StreamingQuery:
    """Start the load. ``checkpoint`` and ``folder`` are folders all executors share.

    The view ``history_table`` has the history's columns and ``seen``, the scrapes behind them.
    """
    return (
        entries.writeStream.foreachBatch(lambda batch, _: merge_scrapes(batch, raw_table, history_table, buckets, folder))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
