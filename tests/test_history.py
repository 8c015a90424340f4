"""History upserts: fold, rebuild, idempotency, replay."""

import datetime as dt
import itertools
import uuid

import pytest
from conftest import records
from pyspark.sql import functions as F

from kerbline.functions.keys import sighting_key
from kerbline.operators import history as hist
from kerbline.sources import tables
from kerbline.streaming import sightings as stream

RAW = ("section_id string, section_name string, location_name string, entry_type string, detail_label string, "
       "advisory_text string, street_name string, from_street string, to_street string, date_first_mentioned string, "
       "date_last_mentioned string, n_dates_mentioned int, advisory_week_start string, advisory_week_end string, "
       "advisory_week_text string, source_url string, scraped_at_iso string, scrape_date string, source_system string, "
       "ingested_at timestamp, batch_id string")
DAYS = ["2026-09-07", "2026-09-14", "2026-09-21", "2026-09-28"]
#: Advisory -> scrapes that show it. "gap" leaves and returns.
SHOWN = {"always": [0, 1, 2, 3], "gone": [0], "gap": [0, 2], "late": [3], "twice": [1, 2]}


def entry(text, i, **over):
    row = {
        "section_id": "bronx", "section_name": "Bronx/Manhattan", "location_name": "Bridge", "entry_type": "construction",
        "detail_label": None, "advisory_text": text, "street_name": None, "from_street": None, "to_street": None,
        "date_first_mentioned": f"2026-10-0{i + 1}", "date_last_mentioned": None if i == 2 else f"2026-10-1{i}",
        "n_dates_mentioned": 2, "advisory_week_start": DAYS[i], "advisory_week_end": "2026-13-45",
        "advisory_week_text": "", "source_url": "u", "scraped_at_iso": DAYS[i], "scrape_date": DAYS[i],
        "source_system": "s", "ingested_at": None, "batch_id": f"b{i}",
    }
    row.update(over)
    return tuple(row.values())


def scrape(spark, *days):
    rows = [entry(name, i) for name, shown in SHOWN.items() for i in shown if i in days]
    return spark.createDataFrame(rows, RAW).withColumn("advisory_sk", sighting_key())


STABLE = [c for c in hist.HISTORY_SCHEMA.fieldNames() if c != "ingested_at"]


def fold(spark, *batches):
    held = hist.empty_history(spark)
    for days in batches:
        held = hist.apply_sightings(held, hist.stage_history(scrape(spark, *days)))
    return held


def test_fold_equals_rebuild(spark):
    rebuilt = records(hist.rebuild_history(hist.stage_history(scrape(spark, *range(4)))), *STABLE)
    for batches in ([(0,), (1,), (2,), (3,)], [(0, 1), (2, 3)], [(0, 1, 2, 3)], [(0,), (1, 2, 3)]):
        assert records(fold(spark, *batches), *STABLE) == rebuilt, batches


def test_history_values(spark):
    rows = {r.advisory_text: r for r in fold(spark, (0,), (1,), (2,), (3,)).collect()}
    day = dt.date.fromisoformat
    always, gap, gone = rows["always"], rows["gap"], rows["gone"]
    assert (always.times_seen, always.is_current, always.first_seen_scrape) == (4, True, day(DAYS[0]))
    assert (always.last_seen_scrape, always.batch_id, always.effective_to) == (day(DAYS[3]), "b3", dt.date(2026, 10, 13))
    assert (gap.times_seen, gap.is_current, gap.last_seen_scrape) == (2, False, day(DAYS[2]))
    assert gap.effective_to == dt.date(2026, 10, 10)  # the later sighting names no end, the old one stays
    assert always.effective_from == dt.date(2026, 10, 1) and always.advisory_week_start == day(DAYS[0])
    assert (gone.is_current, gone.times_seen, gone.borough, gone.advisory_week_end) == (False, 1, "Bronx", None)
    reopened = {r.advisory_text: r.is_current for r in fold(spark, (0,), (1,), (2,)).collect()}
    assert reopened["gap"] is True


def test_rerun_of_any_batch_changes_nothing(spark):
    once = fold(spark, (0,), (1,), (2,))
    for again in ((2,), (0,), (1,)):
        rerun = hist.apply_sightings(once, hist.stage_history(scrape(spark, *again)))
        assert records(rerun, *STABLE) == records(once, *STABLE), again


def test_skipped_batch_is_repaired_by_rebuild(spark):
    skipped = fold(spark, (0,), (2,), (3,))
    full = hist.rebuild_history(hist.stage_history(scrape(spark, *range(4))))
    assert records(skipped, "advisory_text", "times_seen") != records(full, "advisory_text", "times_seen")
    repaired = hist.apply_sightings(hist.empty_history(spark), hist.stage_history(scrape(spark, *range(4))))
    assert records(repaired, *STABLE) == records(full, *STABLE)


def test_insert_only_load_is_idempotent(spark):
    first = hist.load_scrape(scrape(spark, 0).unionAll(scrape(spark, 0)), None)
    assert first.count() == 3
    second = hist.load_scrape(scrape(spark, 0, 1), first)
    assert records(second, "advisory_sk") == records(hist.load_scrape(scrape(spark, 0, 1), second), "advisory_sk")
    assert second.count() == 5


def test_null_section_shifts_hashed_fields(spark):
    a = spark.createDataFrame([entry("t", 0, section_id=None, location_name="x")], RAW)
    b = spark.createDataFrame([entry("t", 0, section_id="x", location_name=None)], RAW)
    assert hist.stage_history(a).first().closure_bk == hist.stage_history(b).first().closure_bk


def test_boroughs(spark):
    rows = spark.createDataFrame([("Bronx/Manhattan",), ("East River Bridge Crossings",), ("Queens",), (None,)], "s string")
    assert records(rows.select(hist.primary_borough(F.col("s")))) == [("Bronx",), ("Crossings",), ("Queens",), (None,)]


def test_as_of_reads(spark):
    raw = scrape(spark, *range(4))
    assert {r.advisory_text for r in hist.shown_as_of(raw, "2026-09-16").collect()} == {"always", "twice"}
    assert hist.shown_as_of(raw, "2026-01-01").count() == 0
    held = hist.rebuild_history(hist.stage_history(raw))
    # The gap of "gap" is not recorded, so the history still counts it in.
    assert {r.advisory_text for r in hist.history_as_of(held, "2026-09-16").collect()} == {"always", "gap", "twice"}
    assert {r.advisory_text for r in hist.current_only(held).collect()} == {"always", "late"}


def test_published_versions_and_bucketed_upsert(spark):
    name = f"h_{uuid.uuid4().hex[:8]}"
    for i in range(4):
        held = spark.table(name) if i else hist.empty_history(spark)
        merged = hist.apply_sightings(held, hist.stage_history(scrape(spark, i)))
        tables.publish_version(merged, name, keep=2, bucket_by=(4, hist.KEY))
    want = hist.rebuild_history(hist.stage_history(scrape(spark, *range(4))))
    assert records(spark.table(name), *STABLE) == records(want, *STABLE)
    assert tables._versions(spark, name) == [3, 4]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = hist.apply_sightings(spark.table(name), hist.stage_history(scrape(spark, 3), unique=True))
        plan = again._jdf.queryExecution().sparkPlan().toString()
        executed = again._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan
    left_side = executed.split("SortMergeJoin")[1].split("Bucketed: true")[0]
    assert "Exchange" not in left_side


def test_append_new_skips_held_rows(spark):
    name = f"raw_{uuid.uuid4().hex[:8]}"
    for days in ((0,), (0, 1), (1,), (3, 2), (0, 1, 2, 3)):
        tables.append_new(hist.load_scrape(scrape(spark, *days), None), name, "advisory_sk", "scrape_date")
    want = hist.load_scrape(scrape(spark, *range(4)), None)
    assert records(spark.table(name), "advisory_sk", "scrape_date") == records(want, "advisory_sk", "scrape_date")


@pytest.mark.parametrize("files_per_batch", [1, 3])
def test_stream_equals_batch_and_survives_replay(spark, tmp_path, files_per_batch):
    landed, tag = str(tmp_path / "landed"), uuid.uuid4().hex[:8]
    raw, held = f"sraw_{tag}", f"shist_{tag}"
    schema = scrape(spark, 0).drop("advisory_sk").schema

    def run(checkpoint):
        entries = stream.read_scrapes(spark, landed, schema, files_per_batch).withColumn("advisory_sk", sighting_key())
        stream.stream_scrapes(entries, raw, held, str(tmp_path / checkpoint)).awaitTermination()

    for i in range(3):
        scrape(spark, i).drop("advisory_sk").coalesce(1).write.mode("append").parquet(landed)
    run("c1")
    scrape(spark, 3).drop("advisory_sk").coalesce(1).write.mode("append").parquet(landed)
    run("c1")
    want = records(hist.rebuild_history(hist.stage_history(scrape(spark, *range(4)))), *STABLE)
    assert records(spark.table(held), *STABLE) == want
    run("c2")  # lost checkpoint: everything is replayed
    assert records(spark.table(held), *STABLE) == want
    assert spark.table(raw).count() == scrape(spark, *range(4)).count()


def test_reports(spark):
    raw = hist.load_scrape(scrape(spark, *range(4)), None)
    held = hist.rebuild_history(hist.stage_history(raw, unique=True))
    assert tuple(hist.history_summary(held).first()) == (5, 2, 3)
    assert all(r.rows_landed == r.distinct_keys for r in hist.scrape_report(raw).collect())
    report = hist.idempotency_report(raw, held).collect()
    assert all(r.rows_held == r.distinct_keys for r in report)
    assert len(report) == 4 + len({r.times_seen for r in held.collect()})


def test_fold_equals_rebuild_on_every_subset_of_batches(spark):
    """All orders in which whole batches can be grouped, on one advisory seen at random."""
    splits = [s for n in (1, 2, 3) for s in itertools.combinations(range(1, 4), n)]
    want = records(hist.rebuild_history(hist.stage_history(scrape(spark, *range(4)))), "closure_bk", "times_seen", "is_current")
    for cuts in splits[:4]:
        edges = [0, *cuts, 4]
        batches = [tuple(range(a, b)) for a, b in zip(edges, edges[1:])]
        assert records(fold(spark, *batches), "closure_bk", "times_seen", "is_current") == want
