"""Exact arithmetic over two-decimal measures.

Money, distance and duration reach the mart as doubles rounded to two decimals. A sum
of doubles depends on the order in which partitions arrive; a sum of whole hundredths
in a LONG does not, and stays in generated code. All BI totals and means use it.

Expressions are handed to Spark as SQL text where they are long or many: one parse on
the JVM instead of a Python round trip per operator.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_column(value: Column | str) -> Column:
    """A Column as it is, text as a SQL expression (a plain name is one)."""
    return F.expr(value) if isinstance(value, str) else value


def rounded(expression: str, digits: int = 2) -> str:
    """SQL text: round half up in decimal arithmetic, as DOUBLE."""
    return f"double(round(cast(({expression}) AS decimal(30,12)), {digits}))"


def round_half_up(value: Column | str, digits: int = 2) -> Column:
    """Round half up in decimal arithmetic, returned as DOUBLE."""
    if isinstance(value, str):
        return F.expr(rounded(value, digits))
    return F.round(value.cast("decimal(30,12)"), digits).cast("double")


def percentage(part: str, whole: str) -> Column:
    """``100 * part / whole`` with two decimals; NULL when the whole is zero or NULL.

    Both arguments are SQL expressions.
    """
    return F.expr(rounded(f"try_divide({part} * 100.0D, {whole})"))


# Two-step aggregation: measures are first reduced per join key, then merged after the
# (now tiny) join. ``partials`` builds the first step, ``total``/``mean`` the second.


def partials(*measures: str) -> list[Column]:
    """Per-key sum of whole hundredths and non-NULL count of each measure."""
    out = []
    for name in measures:
        out.append(F.expr(f"sum(bigint(rint({name} * 100))) AS {name}__sum"))
        out.append(F.expr(f"count({name}) AS {name}__n"))
    return out


def total(measure: str, alias: str) -> Column:
    """Merged total of a measure reduced by :func:`partials`."""
    return F.expr(f"{rounded(f'sum({measure}__sum) / 100')} AS {alias}")


def mean(measure: str, alias: str) -> Column:
    """Merged mean of a measure reduced by :func:`partials`; NULL over no values."""
    return F.expr(f"{rounded(f'try_divide(sum({measure}__sum), sum({measure}__n) * 100)')} AS {alias}")
