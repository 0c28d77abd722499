"""Compact, citable text of timelines: one line for each region, one for each recurring text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import time as T


def audio_line(start: Column, end: Column, language: Column, events: Column, text: Column) -> Column:
    """``[a-b] <language> <event> words``; the language only with words, and only when it is known."""
    spoken = F.coalesce(text, F.lit("")) != ""
    known = spoken & ~F.coalesce(language, F.lit("")).isin("", "unknown")
    parts = F.concat(F.when(known, F.array(F.concat(F.lit("<"), language, F.lit(">")))).otherwise(F.array().cast("array<string>")), F.transform(F.coalesce(events, F.array().cast("array<string>")), lambda e: F.concat(F.lit("<"), e, F.lit(">"))), F.when(spoken, F.array(text)).otherwise(F.array().cast("array<string>")))
    return F.concat(F.lit("["), _span(start, end), F.lit("] "), F.array_join(parts, " "))


def _span(start: Column, end: Column) -> Column:
    return F.concat(F.floor(start / T.SECOND).cast("string"), F.lit("-"), F.floor(end / T.SECOND).cast("string"))


def audio_lines(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``ordinal`` and ``line`` of the segments that say something."""
    told = segments.where((F.coalesce("text", F.lit("")) != "") | (F.size("events") > 0))
    line = audio_line(F.col("start_us"), F.col("end_us"), F.col("language"), F.col("events"), F.col("text"))
    order = Window.partitionBy(*keys).orderBy("start_us", "end_us")
    return told.select(*keys, F.row_number().over(order).alias("ordinal"), line.alias("line"))


def text_lines(cues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``start_us`` and ``line`` of each distinct text: its intervals, joined where they touch in one place."""
    group = F.lower(F.regexp_replace(F.replace(F.col("text"), F.lit(" / "), F.lit(" ")), r"(?U)\s+", ""))
    where = F.concat(F.col("position"), F.lit(", "), F.col("size"))
    rows = cues.withColumns({"__g": group, "__where": where})
    order = Window.partitionBy(*keys, "__g").orderBy("start_us", "position", "text")
    moved = F.coalesce(F.lag("__where").over(order) != F.col("__where"), F.lit(True))
    place = rows.withColumn("__place", F.sum(moved.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(*keys, "__g", "__place").orderBy("start_us", "position", "text")
    reached = F.max("end_us").over(within.rowsBetween(Window.unboundedPreceding, -1))
    apart = place.withColumn("__reached", reached).withColumn("__new", (F.col("__reached").isNull() | (F.col("start_us") > F.col("__reached"))).cast("int"))
    runs = apart.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy(*keys, "__g", "__run", "__where").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    listed = spans.groupBy(*keys, "__g").agg(F.array_sort(F.collect_list(F.struct("start_us", "end_us", "__where"))).alias("__s"), F.size(F.collect_set("__where")).alias("__places"), F.min("start_us").alias("start_us"))
    # of several spellings the longest, of equals the one with the fewest separators, then the earliest
    best = F.max_by("text", F.struct(F.length(F.replace(F.col("text"), F.lit(" / "), F.lit(" "))), -F.size(F.split("text", " / ")), -F.col("start_us"), "text")).alias("__text")
    shown = listed.join(rows.groupBy(*keys, "__g").agg(best), [*keys, "__g"])
    span = lambda s: F.concat(F.floor(s["start_us"] / T.SECOND).cast("string"), F.lit("-"), F.ceil(s["end_us"] / T.SECOND).cast("string"))
    one = F.concat(F.array_join(F.transform("__s", span), "; "), F.lit(", "), F.col("__s")[0]["__where"])
    many = F.array_join(F.transform("__s", lambda s: F.concat(span(s), F.lit(", "), s["__where"])), "; ")
    line = F.concat(F.lit("["), F.when(F.col("__places") == 1, one).otherwise(many), F.lit("] "), F.col("__text"))
    return shown.select(*keys, "start_us", line.alias("line"))


def prompt_body(query: Column, metadata: Column, audio: Column, text: Column) -> Column:
    """The parts of a prompt that are not empty, each under the one before."""
    part = lambda x: F.when(F.trim(F.coalesce(x, F.lit(""))) != "", x)
    return F.concat_ws("\n\n", part(query), part(metadata), part(audio), part(text))
