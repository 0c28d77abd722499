"""What is known of a video beforehand: title, channel, chapters, and how it is told to a model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators import joins


def chapters_at(chapters: DataFrame, spans: DataFrame, keys: Sequence[str], bucket_us: int = 600_000_000) -> DataFrame:
    """Spans (``start_us``, ``end_us``) with each chapter (``r_start_us``, ``r_end_us``, ``title``) that they overlap."""
    return joins.overlapping(spans, chapters, keys, bucket_us)


def reading_prompt(title: Column, channel: Column, chapters: Column) -> Column:
    """A short line for a speech recogniser: channel, title, and the titles of the chapters (an array) at hand."""
    named = F.array_join(F.filter(chapters, lambda c: F.coalesce(c, F.lit("")) != ""), ", ")
    parts = F.filter(F.array(channel, title, named), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.array_join(parts, " - ")


def prompt_block(title: Column, channel: Column, chapters: Column, heads: tuple[str, str, str, str] = ("Video metadata (as the channel gives it):", "Channel: ", "Title: ", "Chapters:")) -> Column:
    """Lines for a reporting model; ``chapters`` are structs of ``start_us``, ``end_us`` and ``title``. Empty where nothing is known."""
    second = lambda us: F.floor(us / 1_000_000).cast("string")
    listed = F.transform(F.coalesce(chapters, F.array().cast("array<struct<start_us:bigint,end_us:bigint,title:string>>")), lambda c: F.concat(F.lit("["), second(c["start_us"]), F.lit("-"), second(c["end_us"]), F.lit("] "), F.coalesce(c["title"], F.lit(""))))
    told = lambda head, x: F.when(F.coalesce(x, F.lit("")) != "", F.array(F.concat(F.lit(head), x))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(told(heads[1], channel), told(heads[2], title), F.when(F.size(listed) > 0, F.concat(F.array(F.lit(heads[3])), listed)).otherwise(F.array().cast("array<string>")))
    return F.when(F.size(lines) > 0, F.concat(F.lit(heads[0] + "\n"), F.array_join(lines, "\n"))).otherwise("")


def transcript_line(start_us: Column, end_us: Column, events: Column, text: Column) -> Column:
    """A line of what was heard, in the index's own shape."""
    tags = F.transform(F.coalesce(events, F.array().cast("array<string>")), lambda e: F.concat(F.lit("<"), e, F.lit(">")))
    body = F.array_join(F.filter(F.concat(tags, F.array(text)), lambda x: F.coalesce(x, F.lit("")) != ""), " ")
    span = F.concat(F.lit("["), F.floor(start_us / 1_000_000), F.lit("-"), F.floor(end_us / 1_000_000), F.lit("]"))
    return F.rtrim(F.concat(span, F.lit(" "), body))


def timestamps(text: Column) -> Column:
    """The ``mm:ss`` moments that a text names, minutes in two digits."""
    found = F.regexp_extract_all(text, F.lit(r"\b(\d{1,2}:[0-5]\d)\b"), F.lit(1))
    return F.transform(found, lambda t: F.lpad(t, 5, "0"))


def positional_accuracy(actual: Column, expected: Column) -> Column:
    """Of the expected values the part that is actual at the same place; 0 where nothing is expected."""
    right = F.size(F.filter(F.arrays_zip(actual.alias("a"), expected.alias("e")), lambda p: p["a"].isNotNull() & (p["a"] == p["e"])))
    return F.when(F.size(expected) > 0, right / F.size(expected)).otherwise(0.0)


def means_by_mode(results: DataFrame, mode: str, measures: Sequence[str], error: str | None = None) -> DataFrame:
    """``n`` and the mean of each measure for each mode; rows with an error count in ``failed`` alone."""
    good = F.col(error).isNull() if error else F.lit(True)
    return results.groupBy(mode).agg(F.count_if(good).alias("n"), F.count_if(~good).alias("failed"), *(F.avg(F.when(good, F.col(m))).alias(m) for m in measures))
