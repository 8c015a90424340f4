"""Calendar keys shared by the trip fact and the date and weather dimensions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def date_hour_key(ts: str) -> Column:
    """``yyyyMMddHH`` of a time column as INT, by integer arithmetic instead of
    formatting and parsing text.

    Like the textual form it leaves the INT range from year 2148 on, which ANSI mode
    reports as an error.
    """
    return F.expr(f"int(year({ts}) * 1000000 + month({ts}) * 10000 + day({ts}) * 100 + hour({ts}))")


def minutes_between(start: str, end: str) -> str:
    """SQL text: minutes between two wall-clock times at second resolution, as DOUBLE."""
    return f"((unix_timestamp({end}) - unix_timestamp({start})) / 60)"


def elapsed_minutes(start: str, end: str) -> Column:
    return F.expr(minutes_between(start, end))
