"""Numbers: rounding, geometry of points and boxes, bit fields, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounded half up, also for negative numbers."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def aspect_ratio(width: Column, height: Column) -> Column:
    """width / height; 0 where that isn't a finite number other than 0."""
    return F.when((height > 0) & width.isNotNull(), width / height).otherwise(F.lit(0.0))


def bits(*flags: Column) -> Column:
    """Flags as a bit field, the first at bit 0."""
    out = F.lit(0).cast("long")
    for i, f in enumerate(flags):
        out = out.bitwiseOR(F.when(f, 1 << i).otherwise(0).cast("long"))
    return out


def flag(field: Column, i: int) -> Column:
    return field.bitwiseAND(F.lit(1 << i).cast("long")) != 0


def rotated(x: Column, y: Column, cx: Column, cy: Column, degrees: Column) -> tuple[Column, Column]:
    """A point turned around a centre."""
    t = F.radians(degrees)
    dx, dy = x - cx, y - cy
    return cx + dx * F.cos(t) - dy * F.sin(t), cy + dx * F.sin(t) + dy * F.cos(t)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def extended(x1: Column, y1: Column, x2: Column, y2: Column, percent: Column) -> tuple[Column, Column]:
    """The second point moved away from the first by a percentage of their distance."""
    return x2 + (x2 - x1) * percent / 100, y2 + (y2 - y1) * percent / 100


def expanded_quad(corners: list[tuple[Column, Column]], top: float = 0, right: float = 0, left: float = 0, bottom: float = 0) -> list[tuple[Column, Column]]:
    """Four corners (top left, bottom left, bottom right, top right) moved out by percentages.

    Each side moves both its corners away from their opposites along the edges, always from the
    original corners; sides go in the order top, right, left, bottom, and of two that move a corner the
    later one counts. A rate of 0 moves nothing.
    """
    away = lambda a, b, rate: extended(*corners[a], *corners[b], F.lit(rate))
    out = list(corners)
    for rate, moves in ((top, ((1, 0), (2, 3))), (right, ((0, 3), (1, 2))), (left, ((3, 0), (2, 1))), (bottom, ((0, 1), (3, 2)))):
        if rate:
            for a, b in moves:
                out[b] = away(a, b, rate)
    return out
