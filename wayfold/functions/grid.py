"""Moves and distances on a grid whose columns wrap and whose rows do not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Row and column step of each move.
STEP = {"up": (-1, 0), "down": (1, 0), "left": (0, -1), "right": (0, 1)}


def _delta(move: Column, axis: int) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for m, d in STEP.items() for x in (m, d[axis])]), move), F.lit(0))


def destination(row: Column, column: Column, move: Column, width: int) -> tuple[Column, Column]:
    return row + _delta(move, 0), F.pmod(column + _delta(move, 1), F.lit(width))


def wrapped_manhattan(r1: Column, c1: Column, r2: Column, c2: Column, width: int) -> Column:
    d = F.abs(c1 - c2)
    return F.abs(r1 - r2) + F.least(d, F.lit(width) - d)


def route_rank(distance: Column, recent: Column, separation: Column, safe: Column) -> Column:
    """Ordered rank of a move: unsafe last, far enough first, then food distance and repeats, then separation."""
    return F.struct((~safe).cast("int").alias("unsafe"), (-F.least(separation, F.lit(4))).alias("near"), (distance + 3 * recent).alias("cost"), (-separation).alias("apart"))
