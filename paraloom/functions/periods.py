"""Periods, time bins and complete spines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: first year of each period, the latest first; earlier years are "Other"
ADMINISTRATIONS = (("Biden", 2021), ("Trump", 2017))


def period_label(year: Column, periods: Sequence[tuple[str, int]] = ADMINISTRATIONS, other: str = "Other") -> Column:
    """The last period that began by ``year``; the newest is open-ended.  A null year is ``other``."""
    out = F.lit(other)
    for name, first in sorted(periods, key=lambda p: p[1]):
        out = F.when(year >= first, F.lit(name)).otherwise(out)
    return out


def year_start(year: Column) -> Column:
    return F.make_date(year, F.lit(1), F.lit(1)).cast("timestamp_ntz")


def timestamp_year(value: Column, kind: str) -> Column:
    """The year of a numeric year (its integer part), a date, a timestamp, or a string that begins with a year."""
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.year(value)
    if kind == "string":
        return F.regexp_extract(value, r"^\s*([0-9]{4})", 1).try_cast("int")
    return F.floor(value).cast("int")


def month_end(ts: Column) -> Column:
    return F.last_day(F.to_date(ts))


def equal_width_edges(low: Column, high: Column, bins: int | Column) -> Column:
    """Edges of right-closed bins of equal width; the first edge lies 0.1 % of the range lower.

    A range of width zero is widened by 0.1 % of its value (0.001 at zero) on both sides.
    """
    n = F.lit(bins) if isinstance(bins, int) else bins
    flat = low == high
    pad = F.when(low != 0, F.lit(0.001) * F.abs(low)).otherwise(F.lit(0.001))
    a, b = F.when(flat, low - pad).otherwise(low), F.when(flat, high + pad).otherwise(high)
    inner = F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: a + (b - a) * i / n)
    first = F.when(flat, a).otherwise(a - (b - a) * 0.001)
    return F.concat(F.array(first), inner)


def bin_left(x: Column, edges: Column) -> Column:
    """Left edge of the bin that holds ``x``: the last edge below it."""
    return F.element_at(F.filter(edges, lambda e: e < x), -1)


def spine(df: DataFrame, topic: str, period: str) -> DataFrame:
    """Every observed topic with every observed period: topics and periods are few, the rows many."""
    return df.select(topic).distinct().crossJoin(df.select(period).distinct())


def filled(counts: DataFrame, topic: str, period: str, value: str, fill: float | None = 0) -> DataFrame:
    """``counts`` on its complete spine; with ``fill`` None the gaps stay null."""
    out = spine(counts, topic, period).join(counts, [topic, period], "left")
    return out if fill is None else out.withColumn(value, F.coalesce(F.col(value), F.lit(fill)))
