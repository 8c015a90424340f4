"""Scrapes in any order, stored in cells; exact as-of reads."""

import datetime as dt
import itertools
import uuid

import pytest
from conftest import records
from pyspark.sql import functions as F
from test_history import DAYS, STABLE, entry, scrape

from kerbline.functions.keys import sighting_key
from kerbline.operators import history as hist, sighting_state as st
from kerbline.sources.cells import CellTable
from kerbline.streaming import sightings as stream

THREE = (0, 1, 2)


def want(spark, *days):
    return records(hist.rebuild_history(hist.stage_history(scrape(spark, *days))), *STABLE)


def staged(spark, *days):
    return hist.stage_history(scrape(spark, *days))


@pytest.mark.parametrize("order", list(itertools.permutations(THREE)))
def test_any_order_of_scrapes_gives_the_rebuild(spark, order):
    held = st.empty_state(spark)
    for k in order:
        held = st.merge_state(held, staged(spark, k))
        held = spark.createDataFrame(held.collect(), st.STATE_SCHEMA)
    assert records(st.as_history(held), *STABLE) == want(spark, *THREE)
    again = st.merge_state(held, staged(spark, order[0], order[2]))
    assert records(st.as_history(again), *STABLE) == want(spark, *THREE)
    assert records(again, "ingested_at") == records(held, "ingested_at")  # a replay touches nothing


@pytest.mark.parametrize("order", list(itertools.permutations(THREE)))
def test_stream_of_any_order_and_its_replay(spark, tmp_path, order):
    landed, tag = str(tmp_path / "landed"), uuid.uuid4().hex[:8]
    raw, held = f"oraw_{tag}", f"ohist_{tag}"
    schema = scrape(spark, 0).drop("advisory_sk").schema

    def run(checkpoint):
        entries = stream.read_scrapes(spark, landed, schema, 1).withColumn("advisory_sk", sighting_key())
        stream.stream_scrapes(entries, raw, held, str(tmp_path / checkpoint), 4, str(tmp_path / "cells")).awaitTermination()

    for k in order:  # a micro-batch each
        scrape(spark, k).drop("advisory_sk").coalesce(1).write.mode("append").parquet(landed)
        run("c1")
    assert records(spark.table(held), *STABLE) == want(spark, *THREE)
    run("c2")  # lost checkpoint: everything is replayed
    assert records(spark.table(held), *STABLE) == want(spark, *THREE)


def cells(spark, tmp_path, buckets=4):
    return CellTable(spark, f"cells_{uuid.uuid4().hex[:8]}", str(tmp_path / "store"), hist.KEY, "is_current", buckets)


def test_cells_hold_what_the_full_merge_gives(spark, tmp_path):
    table = cells(spark, tmp_path)
    for k in (3, 0, 2, 1, 1):
        stream.merge_sightings(table, staged(spark, k))
    assert records(table.read(), *STABLE) == want(spark, *range(4))
    assert table.read().columns == st.STATE_SCHEMA.fieldNames()


def test_small_merge_rewrites_little(spark, tmp_path):
    """20,000 advisories, of which the last scrape showed 200: the next one shows these 200 again."""
    table = cells(spark, tmp_path, 16)

    def made(first, last, day):
        rows = [entry("", 0)]
        names = spark.range(first, last).select(F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 512)).alias("advisory_text"))
        one = spark.createDataFrame(rows, scrape(spark, 0).drop("advisory_sk").schema).drop("advisory_text", "scrape_date")
        return hist.stage_history(names.crossJoin(one).withColumn("scrape_date", F.lit(day)), unique=True)

    old = made(0, 20_000, DAYS[0])
    stream.merge_sightings(table, old)
    stream.merge_sightings(table, made(0, 200, DAYS[1]))
    before = table.sizes()
    report = stream.merge_sightings(table, made(0, 200, DAYS[2]))
    after = table.sizes()
    written = sum(size for file, size in after.items() if file not in before)
    assert 0 < written < 0.05 * sum(before.values())
    assert report["rewritten"] <= 16 and report["cells"] == 32
    full = hist.rebuild_history(old.unionByName(made(0, 200, DAYS[1])).unionByName(made(0, 200, DAYS[2])))
    assert records(table.read(), *STABLE) == records(full, *STABLE)
    assert table.vacuum() >= 1 and table.sizes() == after


def test_killed_merge_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = cells(spark, tmp_path)
    stream.merge_sightings(table, staged(spark, 0))
    before = records(table.read(), *STABLE)
    monkeypatch.setattr(CellTable, "_switch", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        stream.merge_sightings(table, staged(spark, 1))
    assert records(table.read(), *STABLE) == before
    monkeypatch.undo()
    stream.merge_sightings(table, staged(spark, 1))
    assert records(table.read(), *STABLE) == want(spark, 0, 1)
    assert table.vacuum() >= 1 and records(table.read(), *STABLE) == want(spark, 0, 1)


def test_added_files_are_folded_in_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("kerbline.sources.cells.MOST_FOLDERS", 3)
    table = CellTable(spark, f"cells_{uuid.uuid4().hex[:8]}", str(tmp_path / "store"), "k", "f", 1)
    for k in range(8):
        table.upsert(spark.createDataFrame([(k, True, "x"), (-k, None, "y")] if k else [(0, True, "x")], "k int, f boolean, v string"))
    assert max(map(len, table.live().values())) <= 3
    assert records(table.read(), "k") == sorted(((k,) for k in range(-7, 8)), key=lambda r: str(r[0]))
    table.upsert(spark.createDataFrame([(3, False, "moved"), (None, True, "z")], "k int, f boolean, v string"))
    assert [tuple(r) for r in table.read().filter("k = 3").collect()] == [(3, False, "moved")]


def test_empty_merge(spark, tmp_path):
    table = cells(spark, tmp_path)
    stream.merge_sightings(table, staged(spark, 0).limit(0))
    assert table.read().count() == 0
    stream.merge_sightings(table, staged(spark, 0))
    assert records(table.read(), *STABLE) == want(spark, 0)


def test_validity_equals_what_each_scrape_showed(spark):
    state = st.merge_state(st.empty_state(spark), staged(spark, *range(4)))
    intervals = st.validity(state)
    by_text = {(r.advisory_text, r.valid_from, r.valid_to, r.scrapes)
               for r in intervals.join(state.select(hist.KEY, "advisory_text"), hist.KEY).collect()}
    day = [dt.date.fromisoformat(d) for d in DAYS]
    assert by_text == {("always", day[0], None, 4), ("gone", day[0], day[1], 1), ("gap", day[0], day[1], 1),
                       ("gap", day[2], day[3], 1), ("late", day[3], None, 1), ("twice", day[1], day[3], 2)}
    raw = scrape(spark, *range(4))
    for at in (*DAYS, "2026-09-16", "2026-01-01", "2027-01-01"):
        shown = {r[0] for r in hist.stage_history(hist.shown_as_of(raw, at)).select(hist.KEY).collect()}
        assert {r[0] for r in st.valid_at(intervals, at).select(hist.KEY).collect()} == shown


@pytest.mark.parametrize("width", [1, 32])
def test_many_asks_at_once(spark, width):
    state = st.merge_state(st.empty_state(spark), staged(spark, *range(4)))
    intervals = st.validity(state)
    keys = [r[0] for r in state.select(hist.KEY).collect()] + ["unknown", None]
    days = [dt.date(2026, 9, 1) + dt.timedelta(days=3 * k) for k in range(20)] + [None]
    asks = spark.createDataFrame([(k, d) for k in keys for d in days] + [(keys[0], days[4])], "closure_bk string, day date")
    got = sorted(((r.closure_bk, r.day, r.shown) for r in st.asked(intervals, asks, bucket_days=width).collect()), key=str)
    raw = scrape(spark, *range(4))
    on = {d: {r[0] for r in hist.stage_history(hist.shown_as_of(raw, str(d))).select(hist.KEY).collect()} for d in days if d}
    expected = [(k, d, k is not None and d is not None and k in on[d]) for k, d in [tuple(r) for r in asks.collect()]]
    assert got == sorted(expected, key=str)
