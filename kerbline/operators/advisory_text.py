"""Advisory pages to entries, without a shuffle and without Python per row.

A page is one row. Its markup becomes an array of blocks; the array is then cut three
times - at section headings, at location headings, at field labels - and each cut is
an ``explode``. What a heading says is therefore a plain column of every row below it
and is forgotten at the next heading of its own or a higher level, which is exactly
the carry-forward the page layout asks for. Work is linear in the page and stays in
the task that read it.

Levels: pages -> sections -> locations -> labelled groups -> entries.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kerbline.functions.text import (
    MAX_HEADING_LENGTH,
    NOTE_PREFIX,
    WEEK_HEADER,
    date_mentions,
    field_label,
    first_mention,
    has_segment,
    is_event_marker,
    last_mention,
    one_line,
    split_segment,
    strip_hidden,
)

BLOCK_TAGS = ("h2", "h3", "h4", "strong", "p", "li")

# Markup that ends an open paragraph or list item, closed or not: the start of the next
# block, or the end of an enclosing container. Inline tags (strong, b, a) do not.
_OPENERS = "p|li|ul|ol|dl|h[1-6]|div|article|section|nav|header|footer|main|aside|table|form|hr"
_CLOSERS = "ul|ol|dl|div|article|section|nav|header|footer|main|aside|table|form|body|html"
_NEXT_BLOCK = rf"<(?:{_OPENERS})\b|</(?:{_CLOSERS})\b"
# A list item keeps paragraphs and boxes inside it; another item, a list, a heading or the
# end of its list ends it.
_NEXT_ITEM = r"<(?:li|ul|ol|dl|h[1-6])\b|</(?:ul|ol|dl|body|html)\b"


_ID_ATTRIBUTE = r"""(?i)\sid\s*=\s*["']?([^"'\s>]+)"""


def _block_pattern(tags: Sequence[str]) -> str:
    names = "|".join(t for t in tags if t != "li")
    block = rf"<({names})\b[^>]*>.*?(?=</\1\s*>|{_NEXT_BLOCK}|\z)"
    item = rf"|<li\b[^>]*>.*?(?=</li\s*>|{_NEXT_ITEM}|\z)" if "li" in tags else ""
    return f"(?is){block}{item}"


def block_array(html: Column | str, tags: Sequence[str] = BLOCK_TAGS) -> Column:
    """Markup to ``array<struct<pos,tag,block_id,text>>`` in page order.

    Matches do not overlap, so a ``strong`` inside a paragraph belongs to the paragraph.
    """
    raw = F.regexp_extract_all(strip_hidden(html), F.lit(_block_pattern(tags)), 0)
    # Each step is its own transform, so that what it computes is computed once however
    # often the next step mentions it.
    parts = F.transform(
        raw,
        lambda hit: F.struct(
            F.lower(F.regexp_extract(hit, "^<([A-Za-z0-9]+)", 1)).alias("tag"),
            F.regexp_extract(hit, "^<[^>]*>", 0).alias("opening"),
            F.regexp_replace(F.regexp_replace(hit, "^<[^>]*>", ""), "<[^>]*>", " ").alias("body"),
        ),
    )
    return F.transform(
        parts,
        lambda part, i: F.struct(
            i.alias("pos"),
            part["tag"].alias("tag"),
            F.nullif(F.regexp_extract(part["opening"], _ID_ATTRIBUTE, 1), F.lit("")).alias("block_id"),
            one_line(part["body"]).alias("text"),
        ),
    )


def page_blocks(pages: DataFrame, tags: Sequence[str] = BLOCK_TAGS, html: str = "html") -> DataFrame:
    """Pages with their markup replaced by the block array ``blocks``."""
    return pages.withColumn("blocks", block_array(html, tags)).drop(html)


def exploded_blocks(blocks: DataFrame, *carry: str) -> DataFrame:
    """One row per block: the carried columns, ``pos``, ``tag``, ``block_id``, ``text``."""
    return blocks.select(*carry, F.inline("blocks"))


def _cut(blocks: Column, starts_group: Callable[[Column], Column]) -> Column:
    """Array of groups ``struct<head, body>``, a group starting at each heading.

    The first group has no head and holds the blocks before the first heading.
    """
    n = F.size(blocks)
    starts = F.filter(
        F.transform(blocks, lambda b, i: F.when(starts_group(b), i)), lambda i: i.isNotNull()
    )
    # Boundaries including a virtual heading in front of the page and its end; bound to
    # a one-element array so that they are found once.
    bounds = F.concat(F.array(F.lit(-1)), starts, F.array(n))
    groups = F.transform(
        F.array(bounds),
        lambda at: F.transform(
            F.slice(at, 1, F.size(at) - 1),
            lambda begin, j: F.struct(
                F.get(blocks, begin).alias("head"),
                F.slice(blocks, begin + 2, F.get(at, j + 1) - begin - 1).alias("body"),
            ),
        ),
    )
    return F.get(groups, F.lit(0))


def _is_section(b: Column, tag: str) -> Column:
    return (b["tag"] == tag) & b["block_id"].isNotNull()


def _is_noise(text: Column) -> Column:
    return (text == "") | text.startswith(NOTE_PREFIX)


def _is_location(b: Column, max_length: int) -> Column:
    """h3/h4, or a bare strong short enough for a heading that is no field label."""
    short_strong = (b["tag"] == "strong") & field_label(b["text"]).isNull() & (F.length(b["text"]) <= max_length)
    return (b["tag"].isin("h3", "h4") | short_strong) & ~_is_noise(b["text"]) & ~is_event_marker(b["text"])


def _is_marker(b: Column, max_length: int) -> Column:
    strong = (b["tag"] == "strong") & (F.length(b["text"]) <= max_length)
    return (b["tag"].isin("h3", "h4") | strong) & is_event_marker(b["text"])


def with_week(blocks: DataFrame) -> DataFrame:
    """Add the advisory week named by the first h2 that carries the week header."""
    header = F.get(
        F.filter("blocks", lambda b: (b["tag"] == "h2") & F.contains(b["text"], F.lit(WEEK_HEADER))), F.lit(0)
    )["text"]
    staged = blocks.withColumn("advisory_week_text", F.coalesce(header, F.lit("")))
    dates = date_mentions("advisory_week_text")
    return staged.withColumns({
        "advisory_week_start": F.get(dates, F.lit(0)),
        "advisory_week_end": F.get(dates, F.lit(1)),
    })


def with_section(blocks: DataFrame, tag: str = "h2", max_heading: int = MAX_HEADING_LENGTH) -> DataFrame:
    """One row per section (``h2`` with an id): its number, id, name, blocks, and the
    position of its event marker. Blocks before the first section are left out."""
    keep = [c for c in blocks.columns if c != "blocks"]
    cut = blocks.select(
        *keep, F.posexplode(_cut(F.col("blocks"), lambda b: _is_section(b, tag))).alias("section_no", "_group")
    ).filter("section_no > 0")
    marker = F.array_min(
        F.transform(
            F.filter(F.col("_group.body"), lambda b: _is_marker(b, max_heading)), lambda b: b["pos"]
        )
    )
    return cut.select(
        *keep,
        "section_no",
        F.col("_group.head.block_id").alias("section_id"),
        F.col("_group.head.text").alias("section_name"),
        marker.alias("event_marker_pos"),
        F.col("_group.body").alias("blocks"),
    )


def with_location(sections: DataFrame, max_heading: int = MAX_HEADING_LENGTH) -> DataFrame:
    """One row per location group; blocks ahead of the first location are left out."""
    keep = [c for c in sections.columns if c != "blocks"]
    return (
        sections.select(
            *keep,
            F.posexplode(_cut(F.col("blocks"), lambda b: _is_location(b, max_heading))).alias("location_no", "_group"),
        )
        .filter("location_no > 0")
        .select(*keep, "location_no", F.col("_group.head.text").alias("location_name"), F.col("_group.body").alias("blocks"))
    )


def with_label(locations: DataFrame) -> DataFrame:
    """One row per labelled group of a location; the label is NULL ahead of the first."""
    keep = [c for c in locations.columns if c != "blocks"]
    labels = _cut(
        F.col("blocks"), lambda b: (b["tag"] == "strong") & field_label(b["text"]).isNotNull()
    )
    return locations.select(*keep, F.explode(labels).alias("_group")).select(
        *keep, field_label(F.col("_group.head.text")).alias("open_label"), F.col("_group.body").alias("blocks")
    )


def with_entry_type(groups: DataFrame) -> DataFrame:
    """One row per block with ``entry_type``: event behind the section's event marker."""
    keep = [c for c in groups.columns if c not in ("blocks", "event_marker_pos")]
    return groups.select(*keep, "event_marker_pos", F.inline("blocks")).withColumn(
        "entry_type",
        F.when(F.col("pos") > F.col("event_marker_pos"), "event").otherwise("construction"),
    ).drop("event_marker_pos")


def drop_noise(blocks: DataFrame) -> DataFrame:
    """Leave out empty blocks and notes; notes are only recognised outside lists."""
    is_note = (F.col("tag") != "li") & F.col("text").startswith(NOTE_PREFIX)
    return blocks.filter((F.col("text") != "") & ~is_note)


def drop_link_items(blocks: DataFrame) -> DataFrame:
    """Leave out list items with neither an open label nor a "between"."""
    return blocks.filter(
        (F.col("tag") != "li") | F.col("open_label").isNotNull() | has_segment("text")
    )


ENTRY_COLUMNS = (
    "section_id", "section_name", "location_name", "entry_type", "detail_label", "advisory_text",
    "street_name", "from_street", "to_street", "date_first_mentioned", "date_last_mentioned",
    "n_dates_mentioned", "advisory_week_start", "advisory_week_end", "advisory_week_text",
)


def extract_page_entries(
    pages: DataFrame, html: str = "html", section_tag: str = "h2", max_heading: int = MAX_HEADING_LENGTH
) -> DataFrame:
    """Landed pages to one row per advisory entry; other page columns are kept.

    Paragraphs give prose entries with the dates they name, list items give segment
    entries split into street, from and to. Dates are ISO text, as in the raw table.
    """
    carried = [c for c in pages.columns if c != html]
    blocks = with_week(page_blocks(pages, html=html))
    groups = with_label(with_location(with_section(blocks, section_tag, max_heading), max_heading))
    entries = drop_link_items(drop_noise(with_entry_type(groups))).filter(F.col("tag").isin("p", "li"))

    prose = F.col("tag") == "p"
    staged = entries.withColumns({
        "_dates": F.when(prose, date_mentions("text")),
        "_segment": F.when(~prose, split_segment("text")),
    })
    return staged.select(
        *carried,
        "pos",
        "section_id", "section_name", "location_name", "entry_type",
        F.when(~prose, F.col("open_label")).alias("detail_label"),
        F.col("text").alias("advisory_text"),
        F.col("_segment.street").alias("street_name"),
        F.col("_segment.from_street").alias("from_street"),
        F.col("_segment.to_street").alias("to_street"),
        first_mention(F.col("_dates")).cast("string").alias("date_first_mentioned"),
        last_mention(F.col("_dates")).cast("string").alias("date_last_mentioned"),
        F.coalesce(F.size(F.col("_dates")), F.lit(0)).alias("n_dates_mentioned"),
        F.col("advisory_week_start").cast("string").alias("advisory_week_start"),
        F.col("advisory_week_end").cast("string").alias("advisory_week_end"),
        "advisory_week_text",
    )


def page_shape(pages: DataFrame, page_key: str = "page_id", html: str = "html") -> DataFrame:
    """Per page: sections, locations, entries, split segments and the advisory week.

    Pages without a single entry are reported with zeros, so a markup change shows. One
    shuffle of a few short columns; page texts stay where they are read.
    """
    narrow = pages.select(page_key, html)
    per_page = with_week(page_blocks(narrow, html=html)).select(
        page_key,
        (F.size(_cut(F.col("blocks"), lambda b: _is_section(b, "h2"))) - 1).alias("sections"),
        "advisory_week_start", "advisory_week_end",
        F.lit(None).cast("string").alias("location_name"),
        F.lit(None).cast("string").alias("from_street"),
    )
    per_entry = extract_page_entries(narrow, html=html).select(page_key, "location_name", "from_street")
    return per_page.unionByName(per_entry, allowMissingColumns=True).groupBy(page_key).agg(
        F.expr("bigint(greatest(max(sections), 0)) AS sections"),
        F.expr("count(DISTINCT location_name) AS locations"),
        F.expr("count(location_name) AS entries"),
        F.expr("count(from_street) AS segments_split"),
        F.expr("max(advisory_week_start) AS week_start"),
        F.expr("max(advisory_week_end) AS week_end"),
    )
