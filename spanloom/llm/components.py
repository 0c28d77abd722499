"""Connected components by randomised contraction.

In each round every node points to that of its neighbours and itself which a hash of the round ranks first,
and the edges are redrawn between the nodes pointed to. Rounds grow with the logarithm of the longest path;
a star ends in two. A round is a grouped minimum, two lookups and a distinct, cut by written tables; no edge
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free, stash


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (``node``, ``root``) for each end of ``edges`` (``a``, ``b``); root is the smallest node reachable."""
    first = stash(edges.where("a <> b").select("a", "b"), "edges")
    now, maps = first, []
    for i in range(rounds):
        if now.isEmpty():
            break
        both = now.select("a", "b").union(now.select("b", "a"))
        rank = lambda x: F.struct(F.xxhash64(F.lit(i), x).alias("h"), F.col(x).alias("id"))  # noqa: E731, B023
        to = both.groupBy("a").agg(F.least(F.min(rank("b")), F.first(rank("a")))["id"].alias("to"))
        to = stash(to.select(F.col("a").alias("from"), "to"), "pointers")
        maps.append(to)
        x, y = to.alias("x"), to.alias("y")
        moved = now.join(x, F.col("a") == F.col("x.from")).join(y, F.col("b") == F.col("y.from"))
        moved = moved.select(F.least("x.to", "y.to").alias("a"), F.greatest("x.to", "y.to").alias("b"))
        before, now = now, stash(moved.where("a <> b").distinct(), "contracted")
        if before is not first:
            free(before)
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    if not maps:
        return first.select(F.col("a").alias("node"), F.col("b").alias("root"))
    placed = maps[0].select(F.col("from").alias("node"), F.col("to").alias("at"))
    for to in maps[1:]:
        placed = placed.join(to, F.col("at") == F.col("from"), "left").select("node", F.coalesce("to", "at").alias("at"))
    placed = stash(placed, "placed")
    least = placed.groupBy("at").agg(F.min("node").alias("root"))
    return placed.join(stash(least.withColumnRenamed("at", "key"), "roots"), F.col("at") == F.col("key")).select("node", "root")
