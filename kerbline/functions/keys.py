"""Hash keys for entries that carry no identifier of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

#: Stands in for a missing detail label. Other NULL fields are simply left out of the
#: hashed text, so a missing section id shifts the fields behind it; kept on purpose,
#: because stored keys depend on it.
MISSING_LABEL = "~"

#: Fields that identify an advisory entry within one scrape.
ENTRY_FIELDS = ("section_id", "location_name", "detail_label", "advisory_text")


def hash_key(columns: Sequence[Column | str], sentinels: dict[str, str] | None = None) -> Column:
    """SHA-256 (hex) of the columns joined by ``|``; ``sentinels`` replace NULLs by name."""
    sentinels = sentinels or {}
    parts = []
    for item in columns:
        if isinstance(item, str):
            col = F.col(item)
            parts.append(F.coalesce(col, F.lit(sentinels[item])) if item in sentinels else col)
        else:
            parts.append(item)
    return F.sha2(F.concat_ws("|", *parts), 256)


def sighting_key(scrape_date: Column | str = "scrape_date") -> Column:
    """Key of one entry on one scrape date: same entry, same day, same key."""
    day = F.col(scrape_date) if isinstance(scrape_date, str) else scrape_date
    return hash_key([day, *ENTRY_FIELDS], {"detail_label": MISSING_LABEL})


def advisory_key() -> Column:
    """Key of an advisory across scrapes: the sighting key without the date."""
    return hash_key(ENTRY_FIELDS, {"detail_label": MISSING_LABEL})
