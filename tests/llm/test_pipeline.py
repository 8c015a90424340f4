"""The pipeline on the smallest tables, each stage against a plain version of its rule."""

import corpus_pipeline as cp
from test_decontaminate import slow
from test_entropy_mix import slow_targets
from test_near_copies import slow_kept

from kerbline.llm import cotrain_quality, pseudonyms
from kerbline.llm.common import documents


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, small_sf):
    docs = documents(spark, small_sf)
    columns, before = docs.columns, rows(docs)
    tables = {"start": before}
    for name, stage in cp.STAGES:
        docs = cp.stored(stage(spark, docs, small_sf), "test")
        assert docs.columns == (columns if name != "source_mix" else [*columns, "copy"])
        tables[name] = rows(docs) if name != "source_mix" else docs.collect()
    good = cotrain_quality.rated(documents(spark, small_sf), documents(spark, small_sf, "labels")).filter("accepted")
    assert tables["quality"] == {i: r for i, r in before.items() if i in {x.doc_id for x in good.collect()}}

    kept = [(i, before[i].text) for i in sorted(tables["quality"])]
    assert sorted(map(str, tables["near_duplicates"])) == slow_kept(kept)

    items = [(r.item_id, r.text) for r in documents(spark, small_sf, "benchmark").collect()]
    assert sorted(tables["decontamination"]) == [i for i in sorted(tables["near_duplicates"]) if not slow(before[i].text, items)[4]]

    key = pseudonyms.Feistel(cp.PII_KEY)
    assert {i: r.text for i, r in tables["personal_data"].items()} == {
        i: pseudonyms.replace(r.text, key)[0] for i, r in tables["decontamination"].items()}

    size = lambda t: len((t or "").encode().split())
    sizes, taken, times = {}, {}, {}
    for r in tables["personal_data"].values():
        sizes.setdefault(r.source, []).append(size(r.text))
    for r in tables["source_mix"]:
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        assert tables["personal_data"][r.doc_id].text == r.text
    assert max(times.values()) <= 2
    for source, target in slow_targets({s: sum(x) for s, x in sizes.items()}).items():
        # What is left open is less than any document of which there is still a copy to take.
        least = min((size(r.text) for i, r in tables["personal_data"].items()
                     if r.source == source and size(r.text) and times.get(i, 0) < 2), default=1)
        assert -1e-6 <= target - taken.get(source, 0) < max(1, least)

    again = cp.run(spark, small_sf)
    assert sorted(map(str, again.collect())) == sorted(map(str, tables["source_mix"]))
    assert cp.ORACLE_SQL is None
