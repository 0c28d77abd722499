"""Time in whole microseconds: conversions at the edges, clamping and rounding inside."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND


def from_seconds(x: Column) -> Column:
    return F.round(x * SECOND).cast("long")


def from_milliseconds(x: Column) -> Column:
    return (x * 1000).cast("long")


def from_timestamp(x: Column) -> Column:
    """Microseconds of a timestamp, with or without a zone; zone-free ones are read in the session's."""
    return F.unix_micros(x.cast("timestamp"))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def floor_second(x: Column) -> Column:
    return x - F.pmod(x, F.lit(SECOND))


def ceil_second(x: Column) -> Column:
    return x + F.pmod(-x, F.lit(SECOND))


def rounded_out(start: Column, end: Column, duration: Column) -> tuple[Column, Column]:
    """Whole seconds outwards; the end stops at the duration unless it already was beyond it."""
    return floor_second(start), F.least(ceil_second(end), F.greatest(end, duration))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open overlap."""
    return (a_start < b_end) & (b_start < a_end)


def overlap_length(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def clock(us: Column) -> Column:
    """MM:SS of a moment, hours carried as minutes, fractions cut off."""
    seconds = F.floor(us / SECOND)
    return F.format_string("%02d:%02d", F.floor(seconds / 60), F.pmod(seconds, F.lit(60)))


def span_text(start: Column, end: Column) -> Column:
    """Whole seconds of a span: the start cut off, the end rounded up."""
    return F.concat(F.floor(start / SECOND).cast("string"), F.lit("-"), F.ceil(end / SECOND).cast("string"))
