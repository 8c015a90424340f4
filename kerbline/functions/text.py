"""Text extraction by column expressions only: dates in prose, street segments, markup."""

from __future__ import annotations

import re
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column, functions as F

from kerbline.functions.numeric import as_column

# --- fixed values -----------------------------------------------------------------
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August",
          "September", "October", "November", "December")
FIELD_LABELS = ("Location(s)", "Route", "Formation", "Dispersal", "Miscellaneous")
DATE_IN_PROSE = rf"(?i)({'|'.join(MONTHS)})\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})"
STREET_SEGMENT = r"(?i)^(.+?)\s+between\s+(.+?)\s+and\s+(.+?)$"
EVENT_MARKER = r"(?i)^Festivals?,?\s*Parades and Events$"
WEEK_HEADER = "Weekly Traffic Advisory for"
NOTE_PREFIX = "*Note"
MAX_HEADING_LENGTH = 150
# ----------------------------------------------------------------------------------

#: Character references by name, from the standard library's table of HTML names, and the
#: numbers 128 to 159, which pages use for the Windows code page.
_NAMED = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
_WINDOWS = {str(n): bytes([n]).decode("cp1252", "replace") for n in range(128, 160) if n not in (129, 141, 143, 144, 157)}
_REFERENCE = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def _constant_map(values: dict[str, str]) -> Column:
    """A map known when the query is planned, handed over as one text."""
    pairs = "\x01".join(f"{k}\x02{v}" for k, v in values.items())
    return F.str_to_map(F.lit(pairs), F.lit("\x01"), F.lit("\x02"))


def date_mentions(text: Column | str) -> Column:
    """Every date named in prose ("September 12th, 2026") in order, as ``array<date>``.

    Spelling of the month is case-insensitive; days the calendar lacks are left out.
    """
    found = F.regexp_extract_all(as_column(text), F.lit(DATE_IN_PROSE), 0)
    parsed = F.transform(
        found,
        lambda hit: F.try_to_date(
            F.concat_ws(
                " ",
                F.initcap(F.regexp_extract(hit, DATE_IN_PROSE, 1)),
                F.regexp_extract(hit, DATE_IN_PROSE, 2),
                F.regexp_extract(hit, DATE_IN_PROSE, 3),
            ),
            "MMMM d yyyy",
        ),
    )
    return F.filter(parsed, lambda d: d.isNotNull())


def first_mention(dates: Column) -> Column:
    return F.try_element_at(dates, F.lit(1))


def last_mention(dates: Column) -> Column:
    return F.try_element_at(dates, F.lit(-1))


def split_segment(text: Column | str) -> Column:
    """"X between Y and Z" as ``struct<street,from_street,to_street>``.

    The split is as early as possible, so ``to_street`` takes any further "and". Text
    that does not split is kept whole as the street.
    """
    text = as_column(text)
    splits = text.rlike(STREET_SEGMENT)

    def part(i: int) -> Column:
        return F.when(splits, F.trim(F.regexp_extract(text, STREET_SEGMENT, i)))

    return F.struct(
        F.coalesce(part(1), text).alias("street"),
        part(2).alias("from_street"),
        part(3).alias("to_street"),
    )


def has_segment(text: Column | str) -> Column:
    return as_column(text).rlike(STREET_SEGMENT)


def field_label(text: Column | str, labels: Sequence[str] = FIELD_LABELS) -> Column:
    """The label named by a heading such as "Route:"; NULL when it is none of ``labels``."""
    names = "|".join(re.escape(label) for label in labels)
    pattern = rf"(?i)^({names})\s*:\s*$"
    text = as_column(text)
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def is_event_marker(text: Column | str, marker: str = EVENT_MARKER) -> Column:
    return as_column(text).rlike(marker)


def strip_hidden(html: Column | str) -> Column:
    """Remove comments, scripts and style sheets, whose text is not page text."""
    return F.regexp_replace(
        as_column(html), r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", " "
    )


def decode_entities(text: Column | str) -> Column:
    """Every numeric character reference and every one named by HTML, in a single pass.

    What a reference decodes to is not decoded again. Unknown names stay as they are; numbers
    that are no character are shown as U+FFFD like browsers do.
    """
    text = as_column(text)

    def numbered(code: Column) -> Column:
        usable = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        plain = F.decode(F.unhex(F.lpad(F.hex(F.when(usable, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        return F.coalesce(F.try_element_at(_constant_map(_WINDOWS), code.cast("string")), plain)

    def decoded(name: Column) -> Column:
        is_hex = F.lower(F.substring(name, 2, 1)) == "x"
        code = F.when(is_hex, F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7)).try_cast("long")
        return F.when(name.startswith("#"), numbered(code)).otherwise(F.coalesce(
            F.try_element_at(_constant_map(_NAMED), name), F.concat(F.lit("&"), name, F.lit(";"))))

    between = F.split(text, _REFERENCE)
    names = F.regexp_extract_all(text, F.lit(_REFERENCE), 1)
    joined = F.array_join(F.transform(between, lambda part, i: F.concat(part, F.coalesce(decoded(F.get(names, i)), F.lit("")))), "")
    # Many texts hold no reference at all.
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def one_line(text: Column | str) -> Column:
    """Text with references decoded and every run of blanks collapsed to one."""
    return F.trim(F.regexp_replace(decode_entities(text), r"[\s\x{00A0}]+", " "))


def visible_text(markup: Column | str) -> Column:
    """Markup fragment to one line of text: tags become blanks."""
    return one_line(F.regexp_replace(as_column(markup), r"<[^>]*>", " "))
