"""Aggregates over keys: middle heights, languages, strongest labels, and what calls cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def middle(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The median of a value of each key."""
    return rows.groupBy(*keys).agg(F.median(value).alias(f"median_{value}"))


def languages(rows: DataFrame, keys: Sequence[str], language: str, order: str, common: str = "en") -> DataFrame:
    """``first_other``: the first language of each key that isn't the common one; ``only_lang``: the one there is, if it is one; their number."""
    only = F.collect_set(language)
    other = F.min_by(F.col(language), F.when(F.col(language) != common, F.col(order)))
    return rows.groupBy(*keys).agg(other.alias("first_other"), F.when(F.size(only) == 1, F.element_at(only, 1)).alias("only_lang"), F.size(only).cast("long").alias("n_langs"))


def strongest(rows: DataFrame, keys: Sequence[str], score: str, row_id: str, most: int, least: float) -> DataFrame:
    """The ``most`` rows of greatest score of each key that reach ``least``, with their ``rank``; of equals the least id first."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), row_id)
    return rows.where(F.col(score) >= least).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)


def cost(read: Column, cached: Column, read_rate: Column | int, cached_rate: Column | int) -> Column:
    """What tokens cost: the cached ones, no more than were read, at their own rate."""
    held = F.least(cached, read)
    return (read - held) * read_rate + held * cached_rate


def token_totals(rows: DataFrame, keys: Sequence[str], price: Column, tokens: str = "read") -> DataFrame:
    """Cost and tokens of each key's calls, all turns and repairs; the cost is null where nothing is priced."""
    return rows.groupBy(*keys).agg(F.sum(price).alias("cost"), F.sum(tokens).alias("tokens"))
