"""Shards by a hierarchical weighted hash tree: region, rack, shard.

At each level every child draws a straw from a digest of its name and the row's key; the straw's length is
an exponential variate divided by the child's weight, and the shortest wins. A child's chance is its
weight's share, and a change of weights among one node's children moves rows only within that node's
subtree: only between the changed child and its siblings. A new shard gets a region of its own, so that it
takes rows to itself and moves no other. Catalyst expressions alone.

Rows also get a gapless slot in their shard: equal rows are counted first, ranges of a digest make groups of
bounded size, and a group's first slot follows from the sums before it.

Defined results: the key decides, so rows with equal keys share a shard (a null key is one key); a null text
has no bytes; equal rows get different slots; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stash

#: Rows that one task numbers at a time, about.
GROUP_ROWS = 20_000
DIGEST_RANGE = 1 << 16


@dataclass(frozen=True)
class Node:
    """A part of the tree; leaves carry the number of their shard."""

    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int | None = None


def balanced(regions: int, racks: int, shards: int) -> tuple[Node, ...]:
    """Regions of racks of shards, all weights 1 for each shard below."""
    number, out = 0, []
    for r in range(regions):
        own_racks = []
        for k in range(racks):
            leaves = tuple(Node(f"s{number + i}", 1.0, shard=number + i) for i in range(shards))
            number += shards
            own_racks.append(Node(f"r{r}k{k}", float(shards), leaves))
        out.append(Node(f"r{r}", float(racks * shards), tuple(own_racks)))
    return tuple(out)


def leaves(tree: tuple[Node, ...]) -> list[Node]:
    return [x for n in tree for x in (leaves(n.children) if n.children else [n])]


def grown(tree: tuple[Node, ...], weight: float = 1.0) -> tuple[Node, ...]:
    """One more shard, in a new region: rows move to it alone."""
    number = len(leaves(tree))
    return (*tree, Node(f"r{len(tree)}", weight, (Node(f"r{len(tree)}k0", weight, (Node(f"s{number}", weight, shard=number),)),)))


def _unit(path: str, key: Column) -> Column:
    """A number in (0, 1] from 52 bits of a digest."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(path + "|"), key)), 1, 13), 16, 10).cast("double")
    return (bits + 1) / float(1 << 52)


def draw(key: Column, tree: tuple[Node, ...], path: str = "") -> Column:
    """The winning child of each level as a struct of ``region``, ``rack`` and ``shard``."""
    straws = F.array(*(F.struct((-F.ln(_unit(f"{path}/{n.name}", key)) / n.weight).alias("straw"), F.lit(i).alias("child")) for i, n in enumerate(tree)))
    return F.array_min(straws)["child"]


def place(rows: DataFrame, key: Column, tree: tuple[Node, ...], prefix: str = "") -> DataFrame:
    """``rows`` with ``region``, ``rack`` (names) and ``shard`` (number), each column prefixed."""
    at = F.coalesce(key.cast("string"), F.lit("null"))
    region = f"__{prefix}region"
    out = rows.withColumn(region, draw(at, tree))
    racks = F.when(F.lit(False), F.lit(0))
    for i, n in enumerate(tree):
        racks = racks.when(F.col(region) == i, draw(at, n.children, f"/{n.name}") if len(n.children) > 1 else F.lit(0))
    rack = f"__{prefix}rack"
    out = out.withColumn(rack, racks)
    region_name, rack_name, shard = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(0))
    for i, n in enumerate(tree):
        region_name = region_name.when(F.col(region) == i, F.lit(n.name))
        for k, r in enumerate(n.children):
            here = (F.col(region) == i) & (F.col(rack) == k)
            rack_name = rack_name.when(here, F.lit(r.name))
            child = draw(at, r.children, f"/{n.name}/{r.name}") if len(r.children) > 1 else F.lit(0)
            shard = shard.when(here, F.element_at(F.array(*(F.lit(leaf.shard) for leaf in r.children)), child + 1))
    return out.withColumns({f"{prefix}region": region_name, f"{prefix}rack": rack_name, f"{prefix}shard": shard}).drop(region, rack)


def assign(docs: DataFrame, tree: tuple[Node, ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``, ``region``, ``rack``."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    # equal rows differ in their slots alone: they are counted before the shuffle
    counted = rows.groupBy(key, "size", "text_crc32").agg(F.count("*").alias("__n"))
    placed = place(place(counted, F.col(key), tree), F.col(key), grown(tree), "grown_").drop("grown_region", "grown_rack")
    name = F.concat_ws("|", F.lit("slot"), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col("size"), F.col("text_crc32"))
    placed = stash(placed.withColumn("__h", F.conv(F.substring(F.md5(name), 1, 4), 16, 10).cast("long")), "placed")
    groups = min(DIGEST_RANGE, max(1, placed.count() // (GROUP_ROWS * len(leaves(tree)))))
    placed = placed.withColumn("__group", F.floor(F.col("__h") * groups / DIGEST_RANGE))
    sums = placed.groupBy("shard", "__group").agg(F.sum("__n").alias("__rows"))
    before = stash(sums.select("shard", "__group", (F.sum("__rows").over(Window.partitionBy("shard").orderBy("__group")) - F.col("__rows")).alias("__before")), "before")
    order = Window.partitionBy("shard", "__group").orderBy("__h", key, "size", "text_crc32")
    first = F.col("__before") + F.sum("__n").over(order) - F.col("__n")
    slots = placed.join(before, ["shard", "__group"]).withColumn("__first", first)
    slots = slots.withColumn("slot", F.explode(F.sequence(F.col("__first"), F.col("__first") + F.col("__n") - 1)))
    return slots.select(key, "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), "slot", F.col("grown_shard").cast("int"), "region", "rack")
