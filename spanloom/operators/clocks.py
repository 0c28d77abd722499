"""Clocks of sampled frames: when a frame of a decode at some rate is taken, and which of them another rate needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import time as T


def frames(durations: DataFrame, fps: float, duration: str = "duration_us", centred: bool = False) -> DataFrame:
    """``frame`` and ``at_us`` of every frame: at n / fps, or half a second later where a filter centres it."""
    step = round(T.SECOND / fps)
    count = F.greatest(F.ceil(F.col(duration) / step).cast("long"), F.lit(1))
    made = durations.where(F.col(duration) > 0).withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    at = F.col("frame") * step + (T.SECOND // 2 if centred else 0)
    return made.withColumn("at_us", F.least(at, F.col(duration)))


def every(clock: DataFrame, k: int) -> DataFrame:
    """Each ``k``-th frame of a dense clock: the coarser rate that divides it."""
    if k < 1:
        raise ValueError("k must be positive")
    return clock.where(F.pmod("frame", F.lit(k)) == 0)


def on_clock(picks: DataFrame, clock: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames of a dense clock whose moment was picked on a coarser one."""
    return clock.join(picks.select(*keys, "at_us").distinct(), [*keys, "at_us"], "left_semi")


def interval(requests: DataFrame, fps: float) -> DataFrame:
    """Frames of each requested stretch (``start_us``, ``end_us``), none beyond its end."""
    step = round(T.SECOND / fps)
    made = requests.where("end_us > start_us").withColumn("at_us", F.explode(F.sequence(F.col("start_us"), F.col("end_us"), F.lit(step).cast("long"))))
    return made.withColumn("at_us", F.least("at_us", "end_us"))


def beside(chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The frames next to chosen ones that aren't chosen themselves."""
    near = chosen.select(*keys, F.explode(F.array(F.col("frame") - 1, F.col("frame") + 1)).alias("frame")).where("frame >= 0").distinct()
    return near.join(chosen.select(*keys, "frame"), [*keys, "frame"], "left_anti")
