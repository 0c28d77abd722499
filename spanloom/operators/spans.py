"""Algebra of half-open spans on the timelines of any number of keys.

Every function takes rows with ``start_us`` and ``end_us`` and the names of the key columns, and is built of
windows over each key's rows in order and of generators; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from spanloom.functions import time as T

START, END = "start_us", "end_us"


def _ordered(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(START, END)


def _islands(rows: DataFrame, keys: Sequence[str], breaks: Column) -> DataFrame:
    """One row for each run of rows between breaks: the least start and the greatest end."""
    runs = rows.withColumn("__run", F.sum(F.when(breaks, 1).otherwise(0)).over(_ordered(keys).rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "__run").agg(F.min(START).alias(START), F.max(END).alias(END)).drop("__run")


def union(rows: DataFrame, keys: Sequence[str], gap_us: int = 0, bucket_us: int | None = None) -> DataFrame:
    """The union of each key's spans, neighbours joined over gaps of up to ``gap_us``.

    With ``bucket_us``, the spans that start in one bucket of time are merged first, so that a key with a large
    part of all rows is worked on in many tasks and only its merged spans meet in one.
    """
    if bucket_us:
        parts = rows.select(*keys, START, END, F.floor(F.col(START) / bucket_us).alias("__bucket"))
        rows = union(parts, [*keys, "__bucket"], gap_us)
    reached = F.max(END).over(_ordered(keys).rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.select(*keys, START, END).withColumn("__reached", reached)
    return _islands(marked, keys, F.col("__reached").isNull() | (F.col(START) - F.col("__reached") > gap_us)).select(*keys, START, END)


def complement(rows: DataFrame, keys: Sequence[str], durations: DataFrame, duration: str = "duration_us", bucket_us: int | None = None) -> DataFrame:
    """What of ``[0, duration)`` each key's spans leave over; ``durations`` names every key, spans or none.

    ``bucket_us`` is that of ``union``: only merged spans of a key meet in one task.
    """
    spans = durations.select(*keys, duration).join(union(rows, keys, 0, bucket_us), list(keys), "left")
    order = Window.partitionBy(*keys).orderBy(START)
    before = F.greatest(F.lag(END, 1, 0).over(order), F.lit(0))
    last = F.lead(START).over(order).isNull()
    gap = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    ahead = gap(before, F.coalesce(F.col(START), F.col(duration)))
    behind = gap(F.greatest(F.coalesce(F.col(END), F.col(duration)), F.lit(0)), F.when(last, F.col(duration)))
    gaps = spans.withColumn("__gaps", F.array(ahead, behind)).select(*keys, F.explode("__gaps").alias("__g"))
    return gaps.select(*keys, F.col("__g.a").alias(START), F.col("__g.b").alias(END)).where(F.col(END) > F.col(START))


def split_long(rows: DataFrame, most_us: int) -> DataFrame:
    """Spans longer than ``most_us`` in equal parts no longer than it; the last keeps the exact end."""
    if most_us <= 0:
        raise ValueError("most_us must be positive")
    length = F.col(END) - F.col(START)
    parts = F.greatest(F.lit(1), F.ceil(length / most_us)).cast("long")
    cut = rows.withColumn("__n", parts).withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    at = lambda i: F.col(START) + F.floor((i * length) / F.col("__n")).cast("long")
    return cut.withColumns({START: at(F.col("__i")), END: F.when(F.col("__i") + 1 == F.col("__n"), F.col(END)).otherwise(at(F.col("__i") + 1))}).drop("__n", "__i")


def clamp(rows: DataFrame, duration: Column) -> DataFrame:
    """Spans cut to ``[0, duration)``; those outside end up empty."""
    start = T.clamp(F.col(START), F.lit(0), duration)
    return rows.withColumns({START: start, END: T.clamp(F.greatest(start, F.col(END)), F.lit(0), duration)})


def _regions(rows: DataFrame, keys: Sequence[str], durations: DataFrame, duration: str, merge_gap_us: int, min_bridge_us: int, min_region_us: int) -> DataFrame:
    """Regions before the cut as ``__s`` and ``__e``, after one row for each key of ``durations`` without either.

    Runs end where the next row begins another, so all steps are windows over rows in one order: each key's
    duration, then its rows. They share one exchange and one sort, and no step holds more than a key's rows.
    """
    order = _ordered(keys)
    upto, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    raw = rows.where(F.col(END) > F.col(START)).dropna(subset=list(keys)).select(*keys, START, END)
    told = durations.select(*keys, duration).withColumn("__told", F.lit(True))
    every = told.unionByName(raw, allowMissingColumns=True)
    every = every.withColumns({duration: F.first(duration).over(upto), "__told": F.first("__told").over(upto)}).where("__told").drop("__told")

    length = F.col(END) - F.col(START)
    last_end, last_length = F.lag(END).over(order), F.lag(length).over(order)
    gap = F.col(START) - last_end
    breath = (gap <= merge_gap_us) & (gap <= F.greatest(F.lit(min_bridge_us), F.least(last_length, length)))
    wide_start, wide_end = T.rounded_out(F.col(START), F.col(END), F.col(duration))
    # flags are taken on the raw rows before the spans are widened
    wide = every.withColumns({"__breath": F.coalesce(breath, F.lit(False)), "__s": wide_start, "__e": F.when(F.col(START).isNotNull(), wide_end)})
    wide = wide.withColumn("__reached", F.max("__e").over(earlier))
    breaks = F.col("__reached").isNull() | ~((F.col("__s") <= F.col("__reached")) | F.col("__breath"))

    def runs(marked: DataFrame, breaks: Column) -> DataFrame:
        """The last row of each run, with the start of its first and the end reached; ends only grow from run to run."""
        marked = marked.withColumn("__new", breaks)
        begin = F.last(F.when(F.col("__new"), F.col("__s")), ignorenulls=True).over(upto)
        done = F.lead("__new", 1, True).over(order)
        ended = marked.withColumns({"__begin": begin, "__end": F.max("__e").over(upto), "__done": done}).where("__done")
        return ended.select(*keys, START, END, duration, F.col("__begin").alias("__s"), F.col("__end").alias("__e"))

    joined = runs(wide, breaks).withColumn("__before", F.lag("__e").over(order))
    joined = joined.withColumn("__s", F.when(F.col("__before").isNull() & (F.col("__s") < min_region_us), 0).otherwise(F.col("__s")))
    absorbed = runs(joined, F.col("__before").isNull() | (F.col("__s") - F.col("__before") >= min_region_us))
    rest = F.col(duration) - F.col("__e")
    return absorbed.withColumn("__last", F.lead("__s").over(order).isNull()).withColumn("__e", F.when(F.col("__last") & (rest > 0) & (rest < min_region_us), F.col(duration)).otherwise(F.col("__e")))


def speech_view(rows: DataFrame, keys: Sequence[str], durations: DataFrame, duration: str = "duration_us", merge_gap_us: int = 1_500_000, min_bridge_us: int = 1_000_000, min_region_us: int = 2_000_000, window_max_us: int = 30_000_000) -> DataFrame:
    """Regions from raw detections: widened to whole seconds, joined over breaths, slivers absorbed, long ones cut.

    A gap between detections is a breath when it exceeds neither ``merge_gap_us`` nor the shorter of its
    neighbours, of which ``min_bridge_us`` is always allowed. ``durations`` has one row for each key.
    """
    speech = timeline(rows, keys, durations, duration, merge_gap_us=merge_gap_us, min_bridge_us=min_bridge_us, min_region_us=min_region_us, window_max_us=window_max_us)
    return speech.where("kind = 'speech'").drop("kind")


def non_speech_view(speech: DataFrame, keys: Sequence[str], durations: DataFrame, duration: str = "duration_us", min_region_us: int = 2_000_000, window_max_us: int = 30_000_000) -> DataFrame:
    """What speech regions leave over, without pieces under ``min_region_us``, long ones cut."""
    gaps = complement(speech, keys, durations, duration)
    return split_long(gaps.where(F.col(END) - F.col(START) >= min_region_us), window_max_us)


def timeline(rows: DataFrame, keys: Sequence[str], durations: DataFrame, duration: str = "duration_us", merge_gap_us: int = 1_500_000, min_bridge_us: int = 1_000_000, min_region_us: int = 2_000_000, window_max_us: int = 30_000_000) -> DataFrame:
    """The views of speech and of the rest of each key, marked ``speech`` or ``non_speech``: disjoint, and together the
    whole duration, of which ``durations`` has one row for each key.

    The rest is that of ``non_speech_view``, told from the regions next to one another.
    """
    found = _regions(rows, keys, durations, duration, merge_gap_us, min_bridge_us, min_region_us)
    found = found.withColumn("__before", F.greatest(F.lag("__e", 1, 0).over(_ordered(keys)), F.lit(0)))
    part = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    until = F.when(F.col("__last"), F.col(duration))
    ahead = part("non_speech", F.col("__before"), F.coalesce(F.col("__s"), until))
    behind = part("non_speech", F.greatest(F.coalesce(F.col("__e"), F.col(duration)), F.lit(0)), until)
    parts = found.select(*keys, F.explode(F.array(part("speech", F.col("__s"), F.col("__e")), ahead, behind)).alias("__p"))
    parts = parts.select(*keys, F.col("__p.a").alias(START), F.col("__p.b").alias(END), F.col("__p.kind").alias("kind"))
    speech = (F.col("kind") == "speech") & F.col(START).isNotNull()
    return split_long(parts.where(speech | ((F.col("kind") != "speech") & (F.col(END) > F.col(START)) & (F.col(END) - F.col(START) >= min_region_us))), window_max_us)


def chunks(durations: DataFrame, step_us: int, duration: str = "duration_us") -> DataFrame:
    """Tumbling chunks of each key's duration, the last one cut short."""
    found = durations.where(F.col(duration) > 0).withColumn(START, F.explode(F.sequence(F.lit(0).cast("long"), F.col(duration) - 1, F.lit(step_us).cast("long"))))
    return found.withColumn(END, F.least(F.col(START) + step_us, F.col(duration)))


def merge_runs(rows: DataFrame, keys: Sequence[str], tags: str) -> DataFrame:
    """Rows next to each other whose tags are equal as sets become one, with the tags as the first has them."""
    order = Window.partitionBy(*keys).orderBy(START, END)
    same = F.array_sort(F.array_distinct(tags)) == F.lag(F.array_sort(F.array_distinct(tags))).over(order)
    runs = rows.withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    runs = runs.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min_by(tags, F.struct(START, END)).alias(tags)
    return runs.groupBy(*keys, "__run").agg(F.min(START).alias(START), F.max(END).alias(END), first).drop("__run")
