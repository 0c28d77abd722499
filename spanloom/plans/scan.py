"""Reading on-screen text in three stages: base frames, parts that changed, and probes of doubtful lines.

Each stage is a plan (which frames or crops), a run of the reader over its rows, and a table of observations;
nothing is decoded or read on the driver. The reader is a provider (``spanloom.sources.providers``).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators import read_plans as P
from spanloom.operators import tracks
from spanloom.sources.providers import LINES, Reader, answered

#: Frames before and after a doubtful line that may confirm it, and how far off they may lie.
NEIGHBOURS, NEAR_US = 2, 501_000
OBSERVED = ["at_us", "text", "confidence", *P.BOX, "text_height", "look", "verification", "discovery"]


def _read(rows: DataFrame, make: Callable[[], Reader], cropped: bool) -> DataFrame:
    """Rows (``path``, ``crop``) with one row for each line read, or one with a null text where there is none."""
    box = lambda c: (c["left"], c["top"], c["right"], c["bottom"]) if cropped else None
    found = answered(rows, make, lambda p, r: [dict(x) for x in p.read(r.path, box(r.crop) if cropped else None)], "lines", LINES)
    return found.select("*", F.explode_outer("lines").alias("x")).select(*[c for c in found.columns if c not in ("lines", "error")], "x.*")


def _observed(rows: DataFrame, keys: list[str], verification: bool, discovery: bool) -> DataFrame:
    return rows.withColumns({"verification": F.lit(verification), "discovery": F.lit(discovery)}).select(*keys, *OBSERVED)


def _crops(frames: DataFrame, asked: DataFrame, keys: list[str], make: Callable[[], Reader]) -> DataFrame:
    """Lines of the crops that are asked for (keys, ``at_us``, ``box``, ``row``), in the frame's fractions and in the slots asked for."""
    flat = asked.select(*keys, "at_us", *(F.col(f"box.{s}").alias(s) for s in P.BOX), *(F.col(f"row.{s}").alias(f"row_{s}") for s in P.BOX))
    merged = P.merged_crops(flat, [*keys, "at_us"])
    jobs = merged.select(*keys, "at_us", "crop").distinct().join(frames.select(*keys, "at_us", "path", "width", "height"), [*keys, "at_us"])
    lines = P.lifted(_read(jobs, make, True).where("text is not null"))
    rows = merged.select(*keys, "at_us", "crop", *(F.col(f"row_{s}").alias(s) for s in P.BOX))
    return P.in_own_slot(lines, rows, [*keys, "at_us", "crop"])


def scan_text(frames: DataFrame, make: Callable[[], Reader], keys: list[str], settings: tracks.Settings = tracks.Settings(), refresh_s: float = 4.0, check_s: float = 1.0, threshold: float = 0.06, cut: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """Observations of all lines of frames (keys, ``at_us``, ``path``, ``width``, ``height``, ``signature``, ``required``, ``duration_us``).

    ``cut(df, name)`` may write a stage's rows and reread them, so that no frame is read twice.
    """
    picked = P.reads(frames, keys, refresh_s, check_s, threshold)
    base = cut(_read(frames.join(picked, [*keys, "at_us"], "left_semi").select(*keys, "at_us", "path"), make, False), "base")
    said = base.where("text is not null")

    windows = cut(P.changing_slots(said, keys, singleton=settings.singleton, same_text=settings.same_text), "windows")
    boxed = windows.select(*keys, "from_us", "to_us", P.slot_box(F.col("earlier"), F.col("later")).alias("box"), F.array("earlier", "later").alias("rows"))
    within = frames.join(boxed, keys).where(F.col("at_us").between(F.col("from_us"), F.col("to_us")))
    look: Any = lambda p, r: {"look": p.fingerprint(r.path, (r.box["left"], r.box["top"], r.box["right"], r.box["bottom"]))}
    looks = answered(within.select(*keys, "from_us", "to_us", "box", "rows", "at_us", "path"), make, look, "look", "struct<look:string>").withColumn("look", F.col("look.look"))
    known = picked.withColumn("known", F.lit(True))
    looks = cut(looks.where("look is not null").join(known, [*keys, "at_us"], "left").withColumn("known", F.coalesce("known", F.lit(False))), "looks")
    slot = [*keys, "from_us", "to_us", "box", "rows"]
    flat = looks.withColumn("__slot", F.to_json(F.struct("from_us", "to_us", "box", "rows")))
    again = P.rescans(flat.select(*keys, "__slot", "at_us", "look", "known"), [*keys, "__slot"])
    asked = again.join(flat.select("__slot", *slot).distinct(), [*keys, "__slot"]).select(*keys, "at_us", "box", F.explode("rows").alias("row"))
    found = cut(_crops(frames, asked, keys, make), "discovery")

    both = _observed(base, keys, False, False).unionByName(_observed(found, keys, False, True))
    ends = frames.select(*keys, "duration_us").distinct()
    doubtful = tracks.verification_targets(both.join(ends, keys), keys, settings=settings)
    doubtful = P.in_changing_slots(doubtful, windows, keys)
    order = Window.partitionBy(*keys).orderBy("at_us")
    numbered = frames.select(*keys, "at_us", F.row_number().over(order).alias("__n"))
    near = doubtful.join(numbered, [*keys, "at_us"]).withColumn("__n", F.explode(F.array(*(F.col("__n") + d for d in range(-NEIGHBOURS, NEIGHBOURS + 1) if d))))
    probes = near.join(numbered.withColumnRenamed("at_us", "__at"), [*keys, "__n"]).where(F.abs(F.col("__at") - F.col("at_us")) <= NEAR_US)
    line = F.struct(*(F.col(x) for x in P.BOX))
    probes = probes.select(*keys, F.col("__at").alias("at_us"), P.slot_box(line).alias("box"), line.alias("row")).join(picked, [*keys, "at_us"], "left_anti")
    return both.unionByName(_observed(_crops(frames, probes, keys, make), keys, True, False))
