"""Small numeric and time-key column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TimeGroups = str | Sequence[str] | dict[str, int] | None

_TIME_PARTS = {
    "year": F.year,
    "month": F.month,
    "weekofyear": F.weekofyear,
    "dayofyear": F.dayofyear,
    "hour": F.hour,
}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: Column, b: Column) -> Column:
    """``a / b`` with NULL where ``b`` is zero (ANSI mode would raise)."""
    return F.try_divide(a, b)


def clip(c: str | Column, lo: float, hi: float) -> Column:
    """Limit to [lo, hi]; NULL stays NULL."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def floor_at(c: str | Column, lo: float) -> Column:
    """Raise values below ``lo`` to ``lo``; NULL stays NULL."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(float(lo))))


def shift_hours(time: str | Column, hours: int | Column) -> Column:
    """``time`` moved by a (possibly per-row) number of hours."""
    h = hours if isinstance(hours, Column) else F.lit(int(hours))
    return col(time) + F.make_dt_interval(F.lit(0), h.cast("int"))


def truncate_hours(time: str | Column, width: int) -> Column:
    """Start of the ``width``-hour slot of the day, keeping TIMESTAMP_NTZ."""
    t = col(time)
    slot = (F.floor(F.hour(t) / F.lit(width)) * width).cast("int")
    return t.cast("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), slot)


def time_keys(groups: TimeGroups, time: str | Column = "time") -> dict[str, Column]:
    """Grouping columns of a time-group specification.

    ``"month"``, ``["hour", "weekofyear"]`` or ``{"hour": 3}`` (bins of three
    hours).  ``None`` groups by the time stamp itself.
    """
    t = col(time)
    if groups is None:
        return {"time": t}
    if isinstance(groups, str):
        groups = [groups]
    widths = groups if isinstance(groups, dict) else {g: 1 for g in groups}
    unknown = set(widths) - set(_TIME_PARTS)
    if unknown:
        raise ValueError(f"unknown time groups {sorted(unknown)}; choose from {sorted(_TIME_PARTS)}")
    keys = {}
    for name, width in widths.items():
        part = _TIME_PARTS[name](t).cast("long")
        keys[name] = part if width == 1 else (part - F.pmod(part, F.lit(int(width)))).cast("long")
    return keys


def value_bin(c: str | Column, width: float) -> Column:
    """Lower edge of the bin of ``width`` that holds the value."""
    return F.floor(col(c) / F.lit(float(width))).cast("double") * F.lit(float(width))
