"""Plane geometry and thickness arithmetic as column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def length(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.hypot(x1 - x0, y1 - y0)


def angle_mod_180(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(y1 - y0, x1 - x0)), F.lit(180.0))


def angle_difference(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180 - d)


def along_and_off(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    """Parameter along the segment's line (0 at one end, 1 at the other) and the distance off it."""
    dx, dy = x1 - x0, y1 - y0
    square = dx * dx + dy * dy
    t = F.try_divide((px - x0) * dx + (py - y0) * dy, square)
    off = F.try_divide(F.abs((px - x0) * dy - (py - y0) * dx), F.sqrt(square))
    return t, off


def point_segment_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    t, _ = along_and_off(px, py, x0, y0, x1, y1)
    t = F.least(F.greatest(F.coalesce(t, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.hypot(px - (x0 + t * (x1 - x0)), py - (y0 + t * (y1 - y0)))


def up_to_sixteenth(x: Column) -> Column:
    return F.ceil(x * 16 - 1e-9) / 16


def equation_value(form: Column, rating: Column, x: Column, a: Column, b: Column, k: Column, c: Column) -> Column:
    """Thickness by the four printed equation forms; null where a constant is missing or a divisor is 0."""
    return (
        F.when(form.startswith("h = R / ("), F.try_divide(rating, a * x + b))
        .when(form.startswith("T = k / ("), F.try_divide(k, x))
        .when(form.startswith("h = (R - c)"), F.try_divide(rating - c, k * x))
        .when(form.startswith("T = a*("), a * x + b)
    )


def perimeter(d: Column, bf: Column, tw: Column, sides: Column, box: Column | None = None) -> Column:
    """Heated perimeter of a wide-flange section, contour or box, three or four sides."""
    contour = 2 * d + F.when(sides == 4, 4).otherwise(3) * bf - 2 * tw
    if box is None:
        return contour
    return F.when(box, 2 * d + F.when(sides == 4, 2).otherwise(1) * bf).otherwise(contour)


def round_perimeter(od: Column) -> Column:
    return F.lit(math.pi) * od


def confidence(near: Column, competing: Column, far: Column, dashed: Column) -> Column:
    """0.9, less 0.2 for each competing line (0.35 at least), less 0.1 if far and 0.1 if dashed."""
    base = F.greatest(F.lit(0.9) - 0.2 * competing, F.lit(0.35))
    return F.when(near, base - F.when(far, 0.1).otherwise(0.0) - F.when(dashed, 0.1).otherwise(0.0)).otherwise(F.lit(0.0))


def calibrated(x0: Column, y0: Column, x1: Column, y1: Column, real_inches: Column) -> Column:
    """Real inches per point from two points a known distance apart; null where either is not positive."""
    d = length(x0, y0, x1, y1)
    return F.when((d > 0) & (real_inches > 0), real_inches / d)


def agrees(points: Column, inches_per_point: Column, printed_inches: Column, share: float = 0.01) -> Column:
    """Whether a measured length agrees with a printed dimension; false where the dimension is missing."""
    error = F.try_divide(F.abs(points * inches_per_point - printed_inches), printed_inches)
    return F.coalesce((printed_inches > 0) & (points > 0) & (error <= share), F.lit(False))


def spaced(values: Column, least: Column, strictly: bool = False) -> Column:
    """Of sorted values, the first, and then each that lies `least` (or more than it) beyond the last one taken; linear in the array."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for arrays, gaps in batches:
            out = []
            for a, gap in zip(arrays, gaps, strict=True):
                kept = []
                for v in () if a is None else a:
                    if not kept or (v - kept[-1] > gap if strictly else v - kept[-1] >= gap):
                        kept.append(v)
                out.append(np.array(kept, float))
            yield pd.Series(out)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<double>")(values, least)
