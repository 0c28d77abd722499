"""Which frames to read, which parts of them to read again, and what a reading of a part amounts to.

A plan follows each key's frames in order, but only from one read to the next: how far a read lasts is found by
a search over the moments and one comparison of arrays, not by a step for each frame. What compares lines with
lines is a join over time buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import geometry as G
from spanloom.functions import text as X

BOX = ["left", "top", "right", "bottom"]
LINE = ["at_us", "text", "confidence", *BOX]


def checks(at: np.ndarray, each_s: float) -> np.ndarray:
    """Which moments are looked at: the first, and each time the first one ``each_s`` after the last."""
    out, i = np.zeros(len(at), bool), 0
    while i < len(at):
        out[i] = True
        i = max(i + 1, int(np.searchsorted(at, at[i] + each_s)))
        # sums of fractions may lie a hair off the differences that the rule compares
        while i < len(at) and at[i] - at[np.flatnonzero(out)[-1]] < each_s:
            i += 1
    return out


def moved(last: np.ndarray | None, others: Sequence[np.ndarray]) -> np.ndarray:
    """Share of cells in which each of ``others`` differs from ``last``; all of them if it has another number of cells."""
    if last is None or not len(last):
        return np.ones(len(others))
    return np.array([np.mean(x != last) if len(x) == len(last) else 1.0 for x in others])


def read_at(at: np.ndarray, signatures: Sequence[np.ndarray], required: Sequence[float] = (), refresh_s: float = 4.0, check_s: float = 1.0, threshold: float = 0.06) -> list[int]:
    """Places of the frames worth reading.

    The nearest frame to each required moment, one every ``refresh_s``, and those whose signature has moved
    from that of the last one read, looked at every ``check_s``.
    """
    if not len(at):
        return []
    wanted = np.zeros(len(at), bool)
    wanted[[int(np.abs(at - m).argmin()) for m in required]] = True
    due = np.flatnonzero(checks(at, check_s))
    chosen = [0]
    while True:
        i = chosen[-1]
        stale = i + 1 + int(np.argmax(at[i + 1 :] - at[i] >= refresh_s)) if (at[i + 1 :] - at[i] >= refresh_s).any() else len(at)
        asked = i + 1 + int(np.argmax(wanted[i + 1 :])) if wanted[i + 1 :].any() else len(at)
        end = min(stale, asked)
        looked = due[(due > i) & (due < end)]
        changed = looked[moved(signatures[i], [signatures[j] for j in looked]) >= threshold]
        end = int(changed[0]) if len(changed) else end
        if end >= len(at):
            return chosen
        chosen.append(end)


def read_again(at: np.ndarray, looks: Sequence[int], known: np.ndarray, bits: int = 256, least_s: float = 0.5, share: float = 0.12) -> list[int]:
    """Places of a window's frames whose slot looks different from the last look accepted.

    The first look and those at moments that were read anyway (``known``) are accepted as they are.
    """
    out: list[int] = []
    held, read = 0, -np.inf
    for begin, end in zip(anchors := [0, *(i for i in np.flatnonzero(known) if i)], [*anchors[1:], len(at)], strict=True):
        held = begin
        for j in range(begin + 1, end):
            if at[j] - read >= least_s and (looks[held] ^ looks[j]).bit_count() >= share * bits:
                out.append(j)
                held, read = j, at[j]
    return out if len(at) else []


def _planned(found: tuple, keys: list[str], at_us: list[int]) -> pd.DataFrame:
    out = pd.DataFrame({"at_us": np.array(at_us, np.int64)})
    for name, value in zip(reversed(keys), reversed(found), strict=True):
        out.insert(0, name, value)
    return out


def _schema(rows: DataFrame, keys: list[str]) -> str:
    types = dict(rows.dtypes)
    return ", ".join(f"`{k}` {types[k]}" for k in keys)


def reads(frames: DataFrame, keys: list[str], refresh_s: float = 4.0, check_s: float = 1.0, threshold: float = 0.06) -> DataFrame:
    """The moments of the frames (keys, ``at_us``, ``signature``, ``required``) of each key to read."""

    def run(found: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at_us")
        at = rows.at_us.to_numpy() / 1e6
        picked = read_at(at, [np.asarray(x) for x in rows.signature], at[rows.required.to_numpy(bool)], refresh_s, check_s, threshold)
        return _planned(found, keys, rows.at_us.to_numpy()[picked].tolist())

    return frames.groupBy(*keys).applyInPandas(run, _schema(frames, keys) + ", at_us long")


def rescans(looks: DataFrame, keys: list[str], least_s: float = 0.5, share: float = 0.12) -> DataFrame:
    """The moments to read again of windows (their keys, ``at_us``, ``look`` in hexadecimal, ``known``)."""

    def run(found: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at_us")
        picked = read_again(rows.at_us.to_numpy() / 1e6, [int(x, 16) for x in rows["look"]], rows.known.to_numpy(bool), least_s=least_s, share=share)
        return _planned(found, keys, rows.at_us.to_numpy()[picked].tolist())

    return looks.groupBy(*keys).applyInPandas(run, _schema(looks, keys) + ", at_us long")


# ---- slots


def _height(line: Column) -> Column:
    return F.greatest(line["bottom"] - line["top"], F.lit(0.0))


def one_slot(a: Column, b: Column, height: tuple[Column, Column] | None = None) -> Column:
    """Whether two lines (structs of a box) sit in one slot: alike in height, level, and overlapping in width."""
    ha, hb = height or (_height(a), _height(b))
    tall = F.greatest(ha, hb, F.lit(1e-3))
    narrow = F.greatest(F.least(a["right"] - a["left"], b["right"] - b["left"]), F.lit(1e-3))
    level = F.abs(a["top"] + a["bottom"] - b["top"] - b["bottom"]) / 2 <= 0.35 * tall
    return level & (F.least(ha, hb) >= 0.67 * tall) & (F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"]) >= 0.65 * narrow)


def slot_box(*lines: Column) -> Column:
    """The box around lines in one slot: twice their height wider, half of it taller, within the frame."""
    h = F.greatest(*map(_height, lines), F.lit(0.0))
    of = lambda side, f: f(*(x[side] for x in lines)) if len(lines) > 1 else lines[0][side]
    return F.struct(
        F.greatest(F.lit(0.0), of("left", F.least) - 2 * h).alias("left"),
        F.greatest(F.lit(0.0), of("top", F.least) - 0.5 * h).alias("top"),
        F.least(F.lit(1.0), of("right", F.greatest) + 2 * h).alias("right"),
        F.least(F.lit(1.0), of("bottom", F.greatest) + 0.5 * h).alias("bottom"),
    )


def changing_slots(lines: DataFrame, keys: list[str], within_us: int = 4_000_000, singleton: float = 0.95, same_text: float = 0.8) -> DataFrame:
    """(keys, ``from_us``, ``to_us``, ``earlier``, ``later``) where a slot's text changed.

    Each line with the nearest one before it in the slot that says something else, one of the two being clear.
    Lines meet those of two time buckets, so a long key is spread over many tasks.
    """
    line = F.struct(*LINE)
    bucket = F.floor(F.col("at_us") / within_us)
    late = lines.where("text is not null").select(*keys, line.alias("later"), bucket.alias("__b"))
    early = lines.where("text is not null").select(*keys, line.alias("earlier"), F.explode(F.array(bucket, bucket + 1)).alias("__b"))
    gap = F.col("later.at_us") - F.col("earlier.at_us")
    sure = F.greatest(F.coalesce("earlier.confidence", F.lit(1.0)), F.coalesce("later.confidence", F.lit(1.0))) >= singleton
    pairs = late.join(early, [*keys, "__b"]).where((gap > 0) & (gap <= within_us) & sure & one_slot(F.col("earlier"), F.col("later")))
    other = pairs.where(~X.same_text(F.col("earlier.text"), F.col("later.text"), same_text))
    nearest = other.groupBy(*keys, "later").agg(F.max("earlier").alias("earlier"))
    return nearest.select(*keys, F.col("earlier.at_us").alias("from_us"), F.col("later.at_us").alias("to_us"), "earlier", "later")


def in_changing_slots(lines: DataFrame, windows: DataFrame, keys: list[str], within_us: int = 4_000_000) -> DataFrame:
    """The lines that lie in a window of ``changing_slots``, in its time and in its slot before or after the change."""
    here, there = lines.withColumn("__b", F.floor(F.col("at_us") / within_us)), windows.withColumn("__b", F.explode(F.sequence(F.floor(F.col("from_us") / within_us), F.floor(F.col("to_us") / within_us))))
    a, b = here.alias("l"), there.alias("w")
    line = F.struct(*(F.col(f"l.{x}").alias(x) for x in BOX))
    on = [F.col(f"l.{k}") == F.col(f"w.{k}") for k in [*keys, "__b"]]
    on += [F.col("l.at_us").between(F.col("w.from_us"), F.col("w.to_us")), one_slot(line, F.col("w.earlier")) | one_slot(line, F.col("w.later"))]
    return a.join(b, on, "left_semi").drop("__b")


# ---- crops


def one_crop(boxes: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Which boxes are read in one crop with ``box``: one inside the other, or two along one row."""
    low, high = np.maximum(boxes[:, :2], box[:2]), np.minimum(boxes[:, 2:], box[2:])
    shorter = np.minimum(boxes[:, 2:] - boxes[:, :2], box[2:] - box[:2])
    along = (high - low >= np.array([0.6, 0.8]) * shorter).all(1)
    hull = np.hstack([np.minimum(boxes[:, :2], box[:2]), np.maximum(boxes[:, 2:], box[2:])])
    return along | (hull == boxes).all(1) | (hull == box).all(1)


def crops_of(boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(crops, the crop of each box): boxes that are read in one crop are united until no two crops are."""
    crops, members = np.empty((0, 4)), []
    for i, box in enumerate(boxes):
        own = [i]
        while (meets := one_crop(crops, box)).any():
            k = int(np.argmax(meets))
            box = np.concatenate([np.minimum(box[:2], crops[k, :2]), np.maximum(box[2:], crops[k, 2:])])
            own += members.pop(k)
            crops = np.delete(crops, k, 0)
        crops, members = np.vstack([crops, box]), [*members, own]
    order = np.lexsort(crops.T[::-1]) if len(crops) else np.empty(0, np.int64)
    of = np.empty(len(boxes), np.int64)
    for n, k in enumerate(order):
        of[members[k]] = n
    return crops[order], of


def merged_crops(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes (keys, box, any other columns) with ``crop``, the box they are read in; a crop's boxes all stay, as what it is read for."""
    schema = boxes.schema
    crop = "crop struct<left:double,top:double,right:double,bottom:double>"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        crops, of = crops_of(rows[BOX].to_numpy(float))
        return rows.assign(crop=[dict(zip(BOX, crops[k].tolist(), strict=True)) for k in of])

    return boxes.groupBy(*keys).applyInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", " + crop)


def lifted(readings: DataFrame, crop: str = "crop", width: str = "width", height: str = "height") -> DataFrame:
    """Lines read in crops (box in fractions of the crop) as lines of the frame, without those that a cut edge may have shortened.

    ``width`` and ``height`` are the frame's pixels; ``text_height`` becomes a share of the frame's height.
    """
    w, h = F.col(width), F.col(height)
    x, y, r, b = (F.floor(F.col(f"{crop}.{side}") * size) for side, size in zip(BOX, (w, h, w, h), strict=True))
    cw, ch = r - x, b - y
    tall = F.coalesce(F.col("text_height"), F.col("bottom") - F.col("top"))
    margin = F.greatest(F.lit(2.0), 0.15 * tall * ch)
    cut = ((x > 0) & (F.col("left") * cw < margin)) | ((r < w) & ((1 - F.col("right")) * cw < margin)) | ((y > 0) & (F.col("top") * ch < margin)) | ((b < h) & ((1 - F.col("bottom")) * ch < margin))
    # a crop of whole pixels, in fractions of the frame
    placed = G.in_frame((x / w, y / h, r / w, b / h), tuple(F.col(s) for s in BOX))
    return readings.where(~cut).withColumns({**dict(zip(BOX, placed, strict=True)), "text_height": tall * ch / h})


def in_own_slot(lines: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Lifted lines that sit in the slot of a row their crop was read for (``asked``: keys, box); the padding around it is context alone."""
    a, b = lines.alias("l"), asked.alias("q")
    one, two = (F.struct(*(F.col(f"{side}.{x}").alias(x) for x in BOX)) for side in ("l", "q"))
    tall = F.coalesce(F.col("l.text_height"), F.col("l.bottom") - F.col("l.top")), F.col("q.bottom") - F.col("q.top")
    return a.join(b, [*(F.col(f"l.{k}") == F.col(f"q.{k}") for k in keys), one_slot(one, two, tall)], "left_semi")
