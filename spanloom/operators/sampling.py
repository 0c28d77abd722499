"""Sampling of moments by change, with a promise of coverage.

Cuts come first, thinned to a spacing; filler closes any gap that is left longer than allowed; a budget
takes the weakest cuts away and the gaps are filled anew until it holds or no cut is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def change_points(rows: DataFrame, keys: Sequence[str], row_id: str, value: str, threshold: float) -> DataFrame:
    """Moments whose value differs from the one before by more than ``threshold``."""
    order = Window.partitionBy(*keys).orderBy("at_us", row_id)
    moved = F.abs(F.col(value) - F.lag(value).over(order))
    return rows.withColumn("__moved", moved).where(F.col("__moved") > threshold).select(*keys, row_id, "at_us")


def in_order(rows: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Callable[[], Callable[[tuple], bool]]) -> DataFrame:
    """The rows that a fold over each key's rows in order lets through.

    ``fold()`` begins a key and returns a function of a row (its columns after the keys) that tells whether to
    keep it. One shuffle by key and a sort; batches stream by, so a key costs its fold's state and no array of
    its rows, and goes on from one batch into the next.
    """
    names = rows.columns
    rest = [names.index(n) for n in names if n not in keys]
    at = [names.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(names))]
            own = zip(*(columns[i] for i in at), strict=True)
            kept = []
            for key, row in zip(own, zip(*(columns[i] for i in rest), strict=True), strict=True):
                if step is None or key != now:
                    now, step = key, fold()
                kept.append(step(row))
            yield batch.filter(pa.array(kept, pa.bool_()))

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, rows.schema)


def spaced(rows: DataFrame, keys: Sequence[str], least_us: int, opening: int | None = None) -> DataFrame:
    """Each key's moments at least ``least_us`` after the last one kept, with their other columns, the least of them where moments are equal."""
    others = [c for c in rows.columns if c not in keys and c != "at_us"]

    def fold() -> Callable[[tuple], bool]:
        last = [opening]

        def step(row: tuple) -> bool:
            good = last[0] is None or (row[0] - last[0] >= least_us and row[0] > last[0])
            if good:
                last[0] = row[0]
            return good

        return step

    return in_order(rows.where("at_us is not null").select(*keys, "at_us", *others), keys, ["at_us", *others], fold)


def fill_gaps(rows: DataFrame, keys: Sequence[str], durations: DataFrame, most_us: int, duration: str = "duration_us") -> DataFrame:
    """Evenly spread moments in every gap longer than ``most_us``, up to each key's end."""
    order = Window.partitionBy(*keys).orderBy("at_us")
    edges = rows.join(durations, list(keys)).withColumn("__next", F.coalesce(F.lead("at_us").over(order), F.col(duration)))
    gap = F.col("__next") - F.col("at_us")
    wide = edges.where(gap > most_us).withColumn("__n", F.ceil(gap / most_us).cast("long") - 1)
    filled = wide.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    return filled.select(*keys, (F.col("at_us") + F.floor(F.col("__i") * gap / (F.col("__n") + 1)).cast("long")).alias("at_us"))


def within_budget(rows: DataFrame, keys: Sequence[str], row_id: str, score: str, most: int) -> DataFrame:
    """Each key's ``most`` strongest rows; of equals the earlier go first."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.desc(row_id))
    return rows.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= most).drop("__r")


def montage(rows: DataFrame, keys: Sequence[str], at: str, row_id: str, n: int) -> DataFrame:
    """The montage, grid and cell of each frame: groups of n x n, the last in the least square that holds it."""
    order = Window.partitionBy(*keys).orderBy(at, row_id)
    placed = rows.withColumns({"__i": F.row_number().over(order).cast("long") - 1, "__all": F.count("*").over(Window.partitionBy(*keys))})
    group = F.floor(F.col("__i") / (n * n)).cast("long")
    size = F.least(F.lit(n * n), F.col("__all") - group * (n * n))
    grid = F.ceil(F.sqrt(size)).cast("long")
    cell = F.pmod(F.col("__i"), F.lit(n * n))
    return placed.select(*keys, row_id, group.alias("montage"), grid.alias("grid"), F.pmod(cell, grid).alias("cell_x"), F.floor(cell / grid).cast("long").alias("cell_y"))


def candidates(cuts: DataFrame, keys: Sequence[str], durations: DataFrame, duration: str = "duration_us", least_us: int = 2_000_000, most_us: int = 30_000_000, offset_us: int = 250_000, budget: int = 120) -> DataFrame:
    """Moments to sample of each key, with ``at_shot_boundary``: opening, cuts (``at_us``, ``score``) and filler.

    Cuts are thinned to their spacing as they stream by. The budget and the filler depend on each other, so what
    is left of a key's cuts, one in ``least_us`` at most, is settled together; keys with no cut come from ``durations``.
    """
    types = dict(cuts.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", at_us long, at_shot_boundary boolean"
    moved = cuts.join(durations, list(keys)).select(*keys, (F.col("at_us") + offset_us).alias("at_us"), "score", duration).where((F.col("at_us") >= 0) & (F.col("at_us") < F.col(duration)))
    thin = spaced(moved.drop(duration), keys, least_us, 0)
    listed = thin.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at_us", "score"))).alias("__cuts"))
    rows = durations.select(*keys, duration).join(listed, list(keys), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, at, cut = [], [], []
            for row, (end, own) in enumerate(zip(batch.column(duration).to_pylist(), batch.column("__cuts").to_pylist(), strict=True)):
                for moment, is_cut in settle([(c["at_us"], c["score"]) for c in own or ()], end, most_us, budget):
                    of.append(row)
                    at.append(moment)
                    cut.append(is_cut)
            index = pa.array(of, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(index) for k in keys), pa.array(at, pa.int64()), pa.array(cut, pa.bool_())], [*keys, "at_us", "at_shot_boundary"])

    return rows.mapInArrow(run, schema)


def settle(kept: list[tuple[int, float]], end: int, most_us: int, budget: int) -> list[tuple[int, bool]]:
    """One key's moments from its spaced cuts: (moment, whether it is a cut), in order."""
    while True:
        edges = [0, *(m for m, _ in kept), end]
        filler = []
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a > most_us:
                parts = -(-(b - a) // most_us)
                filler += [a + i * (b - a) // parts for i in range(1, parts)]
        surplus = 1 + len(kept) + len(filler) - budget
        if not budget or surplus <= 0 or not kept:
            break
        weakest = set(sorted(range(len(kept)), key=lambda i: kept[i][1])[:surplus])
        kept = [x for i, x in enumerate(kept) if i not in weakest]
    return sorted([(0, False), *((m, True) for m, _ in kept), *((m, False) for m in filler)])


def dedupe(frames: DataFrame, keys: Sequence[str], durations: DataFrame, most_us: int, distance: int, duration: str = "duration_us") -> DataFrame:
    """Frames (``at_us``, ``words``: a hash as an array of 64-bit words, ``at_shot_boundary``) that tell something new.

    Kept are cuts, frames further than ``distance`` bits from the last one kept, and those without which a
    stretch longer than ``most_us`` would go unseen. The frames of a key stream by in order.
    """
    order = Window.partitionBy(*keys).orderBy("at_us")
    ahead = frames.join(durations, list(keys)).withColumn("next_us", F.coalesce(F.lead("at_us").over(order), F.col(duration)))

    def fold() -> Callable[[tuple], bool]:
        last: list = []

        def step(row: tuple) -> bool:
            at, words, cut, following = row
            good = not last or cut or following - last[0] > most_us or sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(words, last[1], strict=True)) > distance
            if good:
                last[:] = [at, words]
            return good

        return step

    return in_order(ahead.select(*keys, "at_us", "words", "at_shot_boundary", "next_us"), keys, ["at_us", "words", "at_shot_boundary", "next_us"], fold).select(*keys, "at_us")


def settled(probes: DataFrame, keys: Sequence[str], distance: int) -> DataFrame:
    """For each candidate (the keys) the probe to take: (``at_us``, ``words``, ``flat``) rows in order of time.

    The first of two probes in a row that agree and aren't flat; else the first that isn't flat.
    """
    order = Window.partitionBy(*keys).orderBy("at_us")
    apart = F.aggregate(F.zip_with("words", F.lag("words").over(order), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    marked = probes.withColumns({"__apart": apart, "__flat_before": F.lag("flat").over(order), "__before": F.lag("at_us").over(order)})
    agrees = ~F.col("flat") & ~F.coalesce("__flat_before", F.lit(True)) & (F.col("__apart") <= distance)
    both = F.min(F.when(agrees, F.col("__before")))
    usable = F.min(F.when(~F.col("flat"), F.col("at_us")))
    return marked.groupBy(*keys).agg(F.coalesce(both, usable).alias("at_us")).where("at_us is not null")
