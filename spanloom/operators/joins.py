"""Joins of moments and spans within equal keys.

Each join has the key as an equality, so the engine plans a merge join with the range as a residual. ``bucket_us``
adds cells of time to the equality, so that rows meet within a cell alone and one long key is spread over many
tasks. Cells come in widths of ``bucket_us`` and ``STEP`` times each; a span takes those as wide as it is long, two
at most below the widest, so long spans aren't repeated for every bucket they reach.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Of the widths of cells.
STEP, LEVELS = 8, 4


def _cell(at: Column, level: Column, side: Column, bucket_us: int) -> Column:
    """One number for a cell of a level and the side of the join that brings the pairs together there."""
    width = F.element_at(F.array(*(F.lit(bucket_us * STEP**n).cast("long") for n in range(LEVELS))), level + 1)
    return F.floor(at / width) * (2 * LEVELS) + 2 * level + side


def _level(cell: Column) -> Column:
    return F.floor(F.pmod(cell, F.lit(2 * LEVELS)) / 2).cast("int")


def _in_cells(rows: DataFrame, start: str, end: str | None, bucket_us: int, own: Sequence[int], wider: Sequence[int] = ()) -> DataFrame:
    """Rows once for each ``__cell`` they reach: for the sides ``own`` in the level of their length, for ``wider`` above it.

    The planner takes the result for as many rows as came in and would broadcast it, hence the hint.
    """
    first = F.col(start)
    last = first if end is None else F.greatest(first, F.col(end) - 1)
    level = F.lit(0) if end is None else sum(((F.col(end) - first > bucket_us * STEP**n).cast("int") for n in range(LEVELS - 1)), F.lit(0))

    def cells(n: Column) -> Column:
        sides = lambda xs: F.array(*map(F.lit, xs))
        taken = F.when(n == level, sides(own)).otherwise(sides(wider)) if wider else sides(own)
        return F.flatten(F.transform(taken, lambda s: F.sequence(_cell(first, n, s, bucket_us), _cell(last, n, s, bucket_us), F.lit(2 * LEVELS).cast("long"))))

    levels = F.sequence(level, F.lit(LEVELS - 1) if wider else level)
    return rows.withColumn("__cell", F.explode(F.flatten(F.transform(levels, cells)))).hint("merge")


def spans_with_moments(moments: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, bucket_us: int) -> DataFrame:
    """Inner join of moments with the spans that hold them; each pair meets in one cell, of the span's level."""
    left, right = _in_cells(moments, at, None, bucket_us, [0], [0]), _in_cells(spans, start, end, bucket_us, [0])
    joined = left.join(right, [*keys, "__cell"])
    return joined.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__cell")


def first_span_of(moments: DataFrame, spans: DataFrame, keys: Sequence[str], moment_id: str, at: str, start: str, end: str, order: Sequence[Column], bucket_us: int) -> DataFrame:
    """Each moment with the first span that holds it; moments outside all spans are left out."""
    pairs = spans_with_moments(moments, spans, keys, at, start, end, bucket_us)
    ranked = pairs.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, moment_id).orderBy(*order)))
    return ranked.where("__r = 1").drop("__r")


def outside_all(moments: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, bucket_us: int) -> DataFrame:
    """Moments that no span holds."""
    bucket = lambda x: F.floor(x / bucket_us)
    reached = F.explode(F.sequence(bucket(F.col(start)), bucket(F.greatest(F.col(start), F.col(end) - 1))))
    # a moment must stay one row, so buckets have one width here; the planner would broadcast the spans, as in _in_cells
    right = spans.select(*keys, start, end).withColumn("__bucket", reached).hint("merge").alias("r")
    left = moments.withColumn("__bucket", bucket(F.col(at))).alias("l")
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, "__bucket"]]
    on += [F.col(f"l.{at}") >= F.col(f"r.{start}"), F.col(f"l.{at}") < F.col(f"r.{end}")]
    return left.join(right, on, "left_anti").drop("__bucket")


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], bucket_us: int) -> DataFrame:
    """Pairs of spans that overlap: left ``start_us``/``end_us`` with right ``r_start_us``/``r_end_us``.

    A pair meets in the level of the longer span: on side 0 if the left one is as long, else on side 1. There it may
    meet in several cells; it counts in the one where the later of its starts lies.
    """
    a, b = _in_cells(left, "start_us", "end_us", bucket_us, [0], [1]), _in_cells(right, "r_start_us", "r_end_us", bucket_us, [0, 1], [0])
    joined = a.join(b, [*keys, "__cell"])
    meets = (F.col("start_us") < F.col("r_end_us")) & (F.col("r_start_us") < F.col("end_us"))
    cell = F.col("__cell")
    first = _cell(F.greatest("start_us", "r_start_us"), _level(cell), F.pmod(cell, F.lit(2)), bucket_us) == cell
    return joined.where(meets & first).drop("__cell")


def clipped(left: DataFrame, right: DataFrame, keys: Sequence[str], bucket_us: int, least_us: int = 400_000) -> DataFrame:
    """The overlaps themselves, without slivers under ``least_us``."""
    pairs = overlapping(left, right, keys, bucket_us)
    pairs = pairs.withColumns({"clip_start_us": F.greatest("start_us", "r_start_us"), "clip_end_us": F.least("end_us", "r_end_us")})
    return pairs.where(F.col("clip_end_us") - F.col("clip_start_us") >= least_us)


def first_overlapping(clips: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Of the overlaps of each left span (``clipped``) the right one that comes first."""
    best = F.min(F.struct("clip_start_us", right_id)).alias("b")
    return clips.groupBy(left_id).agg(best).select(left_id, F.col(f"b.{right_id}").alias(right_id))


def as_of_previous(rows: DataFrame, keys: Sequence[str], at: str, row_id: str, within_us: int, condition: Column | None = None) -> DataFrame:
    """Each row with the latest earlier row of its key at most ``within_us`` back, as ``prev_<id>`` and ``prev_<at>``.

    Without a condition the greatest earlier row is carried along each key's rows in order: one shuffle, no pairs.
    ``condition`` may name the two rows as ``l`` and ``r``; rows then meet within two buckets of the reach.
    """
    if condition is None:
        earlier = Window.partitionBy(*keys).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
        found = rows.withColumn("p", F.max(F.struct(F.col(at).alias("at"), F.col(row_id).alias("id"))).over(earlier)).where(F.col(at) - F.col("p.at") <= within_us)
        return found.select(*keys, row_id, at, F.col("p.id").alias(f"prev_{row_id}"), F.col("p.at").alias(f"prev_{at}"))
    left = rows.withColumn("__bucket", F.floor(F.col(at) / within_us)).alias("l")
    right = rows.withColumn("__bucket", F.explode(F.array(F.floor(F.col(at) / within_us), F.floor(F.col(at) / within_us) + 1))).alias("r")
    gap = F.col(f"l.{at}") - F.col(f"r.{at}")
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, "__bucket"]] + [gap > 0, gap <= within_us, condition]
    best = F.max(F.struct(F.col(f"r.{at}").alias("at"), F.col(f"r.{row_id}").alias("id"))).alias("p")
    found = left.join(right, on).groupBy(*(F.col(f"l.{k}").alias(k) for k in keys), F.col(f"l.{row_id}").alias(row_id), F.col(f"l.{at}").alias(at)).agg(best)
    return found.select(*keys, row_id, at, F.col("p.id").alias(f"prev_{row_id}"), F.col("p.at").alias(f"prev_{at}"))


def support(rows: DataFrame, keys: Sequence[str], at: str, within_us: int) -> DataFrame:
    """Rows with ``n_moments``: distinct moments of the key within ``within_us`` of each, its own counted.

    Moments are made distinct before they are counted, so repeated ones cost one row.
    """
    near = Window.partitionBy(*keys).orderBy(at).rangeBetween(-within_us, within_us)
    counted = rows.select(*keys, at).distinct().withColumn("n_moments", F.count("*").over(near))
    return rows.join(counted, [*keys, at])


def nearest(moments: DataFrame, grid: DataFrame, keys: Sequence[str], at: str, moment_id: str, grid_at: str) -> DataFrame:
    """Each moment with the nearest grid point of its key, the earlier of two as near.

    Both are merged into one ordered stream; the last point before and the first after are carried along it,
    which takes one shuffle and no pair that isn't the answer's.
    """
    points = grid.select(*keys, F.col(grid_at).alias("__t"), F.lit(0).alias("__m"), F.col(grid_at).alias("__g"), F.lit(None).cast(dict(moments.dtypes)[moment_id]).alias(moment_id)).distinct()
    asked = moments.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__m"), F.lit(None).cast("long").alias("__g"), moment_id)
    up, down = Window.partitionBy(*keys).orderBy("__t", "__m"), Window.partitionBy(*keys).orderBy(F.desc("__t"), "__m")
    before = F.last("__g", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("__g", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    found = points.unionByName(asked).withColumns({"__b": before, "__a": after}).where("__m = 1")
    pick = F.when(F.col("__a").isNull() | (F.col("__t") - F.col("__b") <= F.col("__a") - F.col("__t")), F.col("__b")).otherwise(F.col("__a"))
    return found.select(*keys, moment_id, F.col("__t").alias(at), pick.alias("nearest_us")).where("nearest_us is not null")
