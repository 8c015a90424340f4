"""Advisory pages: every markup trap on a small page, checked entry by entry."""

import datetime as dt

import pytest
from conftest import records
from pyspark.sql import functions as F

from kerbline.functions.text import date_mentions, split_segment, visible_text
from kerbline.operators import advisory_text as text

PAGE = """<!-- <p>hidden</p> --><script>var t = "</p><h2 id='s'>no</h2>";</script>
<h2>Weekly Traffic Advisory for Saturday September 12th, 2026 to Friday September 18th, 2026</h2>
<p>Ahead of any section</p>
<h2 id="bronx">Bronx/Manhattan</h2>
<strong>Route:</strong><ul><li>Gone between A and B</li></ul>
<h3>First Bridge</h3>
<p>*Note: skipped</p>
<p>Closed from September 14th, 2026 to September 16, 2026.</p>
<strong>Second Avenue</strong>
<p><strong>A bolded paragraph is not a heading.</strong> One date: september 13 2026</p>
<strong>{long}</strong>
<strong>Location(s):</strong>
<ul><li>Oak St between Elm St and Fir St and Bay Ave</li><li>Duane St Bet A and B</li><li></li></ul>
<h3>Link Place</h3>
<ul><li>See the map</li><li>Ash St between Ivy St and Rye St</li></ul>
<h3>Festivals, Parades and Events</h3>
<h3>Autumn Fair</h3>
<strong>Formation:</strong><ul><li>Pine St between 1 Ave and 2 Ave</li></ul>
<h2 id="x">East River Bridge Crossings</h2>
<p>Dropped: no location yet, February 30th, 2026</p>
<h4>Span &amp; Tower</h4>
<p>Still construction &lt;b&gt; here, February 30th, 2026</p>
""".replace("{long}", "x" * 151)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(
        [(1, "u1", PAGE), (2, "u2", "<p>nothing at all</p>"), (3, "u3", None)], "page_id long, url string, html string"
    )


def test_entries(pages):
    got = [
        tuple(r)
        for r in text.extract_page_entries(pages).orderBy("pos").select(
            "page_id", "section_id", "location_name", "entry_type", "detail_label", "advisory_text", "street_name",
            "from_street", "to_street", "date_first_mentioned", "date_last_mentioned", "n_dates_mentioned",
        ).collect()
    ]
    none3 = (None, None, None)
    assert got == [
        (1, "bronx", "First Bridge", "construction", None, "Closed from September 14th, 2026 to September 16, 2026.",
         *none3, "2026-09-14", "2026-09-16", 2),
        (1, "bronx", "Second Avenue", "construction", None,
         "A bolded paragraph is not a heading. One date: september 13 2026", *none3, "2026-09-13", "2026-09-13", 1),
        (1, "bronx", "Second Avenue", "construction", "Location(s)", "Oak St between Elm St and Fir St and Bay Ave",
         "Oak St", "Elm St", "Fir St and Bay Ave", None, None, 0),
        (1, "bronx", "Second Avenue", "construction", "Location(s)", "Duane St Bet A and B",
         "Duane St Bet A and B", None, None, None, None, 0),
        (1, "bronx", "Link Place", "construction", None, "Ash St between Ivy St and Rye St",
         "Ash St", "Ivy St", "Rye St", None, None, 0),
        (1, "bronx", "Autumn Fair", "event", "Formation", "Pine St between 1 Ave and 2 Ave",
         "Pine St", "1 Ave", "2 Ave", None, None, 0),
        (1, "x", "Span & Tower", "construction", None, "Still construction <b> here, February 30th, 2026",
         *none3, None, None, 0),
    ]


def test_week_and_shape(pages):
    shape = {r.page_id: r for r in text.page_shape(pages).collect()}
    first = shape[1]
    assert (first.sections, first.locations, first.entries, first.segments_split) == (2, 5, 7, 3)
    assert (first.week_start, first.week_end) == (dt.date(2026, 9, 12), dt.date(2026, 9, 18))
    for other in (2, 3):
        assert (shape[other].sections, shape[other].entries, shape[other].week_start) == (0, 0, None)


def test_event_marker_keeps_location_and_label(spark):
    html = ('<h2 id="a">Queens</h2><h3>Place</h3><strong>Route:</strong>'
            "<h3>Festival Parades and Events</h3><ul><li>Free text</li></ul>")
    row = text.extract_page_entries(spark.createDataFrame([(1, html)], "page_id int, html string")).collect()[0]
    assert (row.location_name, row.detail_label, row.entry_type) == ("Place", "Route", "event")


def test_unclosed_blocks_end_at_the_next_block(spark):
    html = '<h2 id="a">S</h2><h3>L</h3><p>one<p>two <b>bold</b><ul><li>x between y and z<li>link</ul>tail<p>three</div>four'
    got = text.extract_page_entries(spark.createDataFrame([(1, html)], "page_id int, html string")).orderBy("pos")
    assert [r.advisory_text for r in got.collect()] == ["one", "two bold", "x between y and z", "three"]


def test_many_blocks_on_one_page(spark):
    """A long page stays whole and in order."""
    html = '<h2 id="a">S</h2>' + "".join(f"<h3>L{i}</h3><p>text {i}</p>" for i in range(3000))
    got = text.extract_page_entries(spark.createDataFrame([(1, html)], "page_id int, html string"))
    pairs = {(r.location_name, r.advisory_text) for r in got.collect()}
    assert pairs == {(f"L{i}", f"text {i}") for i in range(3000)}


def test_extraction_needs_no_shuffle(pages):
    plan = text.extract_page_entries(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Python" not in plan


@pytest.mark.parametrize("prose, days", [
    ("September 12th, 2026 and OCTOBER 1 2026", [dt.date(2026, 9, 12), dt.date(2026, 10, 1)]),
    ("february 30th, 2026, then March 2nd 2026", [dt.date(2026, 3, 2)]),
    ("May 3rd,2026? no blank", []),
    ("nothing", []),
])
def test_date_mentions(spark, prose, days):
    assert spark.range(1).select(date_mentions(F.lit(prose)).alias("d")).first().d == days


def test_list_items_keep_their_inner_blocks(spark):
    html = ('<h2 id="a">S</h2><h3>L</h3><strong>Route:</strong><ul><li><p>Oak St between A</p><p>and B</p></li>'
            "<li><div>Elm St</div> bet <b>C</b> and D<li>Fir St between E and F</ul><p>after</p>")
    got = text.extract_page_entries(spark.createDataFrame([(1, html)], "page_id int, html string")).orderBy("pos")
    assert [(r.advisory_text, r.detail_label, r.street_name) for r in got.collect()] == [
        ("Oak St between A and B", "Route", "Oak St"), ("Elm St bet C and D", "Route", "Elm St bet C and D"),
        ("Fir St between E and F", "Route", "Fir St"), ("after", None, None)]


def test_references_are_decoded_once(spark):
    import html

    said = ("a&rsquo;s &ndash; &Eacute;t&eacute; &hellip;", "&#38;lt; &amp;amp; &#38;#38;", "&#146;&#x92;&#150;&#128;", "&#x1F600;&#xd800;&#1114112;",
            "&nosuch; & &; &#; &#x; &#00000065;", "&NotEqualTilde;&lt;b&gt;", "", "no reference", "&amp;")
    rows = spark.createDataFrame([(x,) for x in said], "t string")
    from kerbline.functions.text import decode_entities
    got = {r.t: r.d for r in rows.select("t", decode_entities("t").alias("d")).collect()}
    for x in said:
        assert got[x] == (html.unescape(x) if "00000065" not in x else x), x


def test_labels_and_marker_are_parameters(spark):
    from kerbline.functions.text import field_label, is_event_marker

    row = spark.range(1).select(field_label(F.lit("Detour (a.b):"), ("Detour (a.b)",)).alias("own"), field_label(F.lit("Detour:")).alias("not"),
                                is_event_marker(F.lit("Street Fairs"), "^Street Fairs$").alias("m")).first()
    assert (row.own, row["not"], row.m) == ("Detour (a.b)", None, True)


def test_segments(spark):
    rows = spark.createDataFrame([("A St BETWEEN B and C",), ("plain",), (None,)], "t string")
    assert records(rows.select(split_segment("t").alias("s")).select("s.*")) == [
        ("A St", "B", "C"), ("plain", None, None), (None, None, None)]


def test_visible_text_decodes_references(spark):
    markup = "<a href='#'>Caf&#233;&nbsp;&amp;lt; &#x1F600;</a>\n  &quot;x&quot; &#0; &bogus;"
    assert spark.range(1).select(visible_text(F.lit(markup)).alias("t")).first().t == 'Café &lt; \U0001F600 "x" � &bogus;'
