"""Boxes in fractions of a frame: overlap, slots, bands, neighbours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("left", "top", "right", "bottom")


def box(prefix: str) -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{s}") for s in SIDES)


def span_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two stretches as a share of the shorter."""
    shorter = F.greatest(F.least(a1 - a0, b1 - b0), F.lit(1e-3))
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)) / shorter


def spatial_overlap(a: tuple, b: tuple) -> Column:
    """The lesser of the overlaps along both axes; 0 for heights more than 2.5 apart in ratio."""
    ha, hb = F.greatest(a[3] - a[1], F.lit(1e-3)), F.greatest(b[3] - b[1], F.lit(1e-3))
    both = F.least(span_overlap(a[0], a[2], b[0], b[2]), span_overlap(a[1], a[3], b[1], b[3]))
    return F.when(F.greatest(ha, hb) / F.least(ha, hb) > 2.5, 0.0).otherwise(both)


def position(a: tuple) -> Column:
    """Third of the frame's height and width in which the box's centre lies."""
    x, y = (a[0] + a[2]) / 2, (a[1] + a[3]) / 2
    row = F.when(y < 0.33, "top").when(y < 0.66, "middle").otherwise("bottom")
    column = F.when(x < 0.33, "left").when(x < 0.66, "center").otherwise("right")
    return F.concat_ws(" ", row, column)


def size(height: Column) -> Column:
    return F.when(height < 0.04, "small").when(height < 0.08, "medium").otherwise("large")


def polygon_height(points: Column, frame_height: Column) -> Column:
    """Short side of a quadrilateral (four structs of x and y), opposite edges averaged, of the frame's height."""
    edge = lambda i: F.sqrt(F.pow(points[i]["x"] - points[(i + 1) % 4]["x"], 2) + F.pow(points[i]["y"] - points[(i + 1) % 4]["y"], 2))
    return F.least((edge(0) + edge(2)) / 2, (edge(1) + edge(3)) / 2) / frame_height


def in_frame(crop: tuple, line: tuple) -> tuple:
    """A line's box in a crop's fractions as a box in the frame's."""
    width, height = crop[2] - crop[0], crop[3] - crop[1]
    return (crop[0] + line[0] * width, crop[1] + line[1] * height, crop[0] + line[2] * width, crop[1] + line[3] * height)


def stacked(upper: tuple, lower: tuple, upper_height: Column, lower_height: Column) -> Column:
    """Whether ``lower`` reads on below ``upper`` in one column: heights within a factor of two, centres close
    enough, widths overlapping by 70 %, and aligned at an edge, centred, or hanging under a wider line."""
    tall = F.greatest(upper_height, lower_height, F.lit(1e-3))
    short = F.greatest(F.least(upper_height, lower_height), F.lit(1e-3))
    down = (lower[1] + lower[3] - upper[1] - upper[3]) / 2
    wide, narrow = F.greatest(upper[2] - upper[0], F.lit(1e-3)), F.greatest(lower[2] - lower[0], F.lit(1e-3))
    shared = F.greatest(F.lit(0.0), F.least(upper[2], lower[2]) - F.greatest(upper[0], lower[0])) / F.least(wide, narrow)
    edges = F.least(F.abs(upper[0] - lower[0]), F.abs(upper[2] - lower[2])) <= 0.6 * tall
    centred = F.abs(upper[0] + upper[2] - lower[0] - lower[2]) / 2 <= 0.3 * tall
    indent = lower[0] - upper[0]
    hanging = (indent >= 0) & (indent <= 1.2 * tall) & (wide >= 1.5 * narrow) & (lower[2] <= upper[2])
    return (short / tall >= 0.5) & (down >= 0.3 * short - 1e-6) & (down <= 1.6 * tall) & (shared >= 0.7) & (edges | centred | hanging)
