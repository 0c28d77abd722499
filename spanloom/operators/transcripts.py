"""Accumulated transcripts: the best account of each region, digests, and their overlay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import time as T


def coverage(clip_start: Column, clip_end: Column, start: Column, end: Column) -> Column:
    """Share of a region that a clip covers."""
    return F.when(end > start, T.overlap_length(clip_start, clip_end, start, end) / (end - start)).otherwise(0.0)


def best_account(rows: DataFrame, region: Sequence[str], coverage_col: str, recorded: str) -> DataFrame:
    """All rows of each region's best call: the widest coverage, of equals the latest."""
    order = Window.partitionBy(*region).orderBy(F.desc(coverage_col), F.desc(recorded))
    return rows.withColumn("__r", F.rank().over(order)).where("__r = 1").drop("__r")


def digest(rows: DataFrame, keys: Sequence[str], order: Sequence[str], line: Column, separator: str = "|") -> DataFrame:
    """SHA-256 of each key's lines in order."""
    listed = F.array_sort(F.collect_list(F.struct(*order, line.alias("__line"))))
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(listed, lambda r: r["__line"]), separator), 256).alias("digest"))


def joined_text(rows: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, separator: str = " ") -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__line"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda r: r["__line"]), separator).alias(text))


def overlay(segments: DataFrame, account: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Segments with the account's text where their region has one."""
    text = account.withColumnRenamed("text", "__heard")
    return segments.join(text, list(keys), "left").withColumn("text", F.coalesce("__heard", "text")).drop("__heard")
