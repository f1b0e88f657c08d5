"""Voxel grids: batch and incremental group-by-voxel, cylinder window, occupancy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravox.functions.geometry import AXES, voxel_index


def keyed(points: DataFrame, size: float) -> DataFrame:
    return points.withColumns({f"i{a}": voxel_index(F.col(a), size) for a in AXES})


def voxels(points: DataFrame, size: float) -> DataFrame:
    """(ix, iy, iz, n, sx, sy, sz): point counts and coordinate sums; combined per task before the shuffle."""
    return keyed(points, size).groupBy("ix", "iy", "iz").agg(F.count("*").alias("n"), *[F.sum(a).alias(f"s{a}") for a in AXES])


def merged(state: DataFrame, fresh: DataFrame, least: int) -> DataFrame:
    """A new state of voxels: sums added up; became_active marks those that reach ``least`` points now."""
    cell = ["ix", "iy", "iz"]
    old = state.select(*cell, F.col("n").alias("n_old"), *[F.col(f"s{a}").alias(f"o{a}") for a in AXES])
    both = old.join(fresh, cell, "full").fillna(0, ["n_old", "n", "ox", "oy", "oz", "sx", "sy", "sz"])
    n = F.col("n_old") + F.col("n")
    return both.select(*cell, n.alias("n"), *[(F.col(f"o{a}") + F.col(f"s{a}")).alias(f"s{a}") for a in AXES], ((F.col("n_old") < least) & (n >= least)).alias("became_active"))


def centroids(state: DataFrame) -> list[Column]:
    return [F.round(F.col(f"s{a}") / F.col("n"), 4).alias(f"c{a}") for a in AXES]


def in_cylinder(x: float, y: float, radius: float, low: float, high: float) -> Column:
    """Inside a vertical cylinder: at most ``radius`` away in the plane, between two heights."""
    dx, dy = F.col("x") - x, F.col("y") - y
    return (dx * dx + dy * dy <= radius * radius) & F.col("z").between(low, high)


def moved(axes, turn, shift) -> list[Column]:
    """Coordinates after turn * p + shift, named as before."""
    return [(sum((F.lit(r) * F.col(a) for r, a in zip(row, axes)), F.lit(0.0)) + F.lit(s)).alias(name) for row, s, name in zip(turn, shift, axes)]


def moved_back(axes, turn, shift) -> list[Column]:
    """Coordinates before that: the inverse of a turn is its transpose."""
    return [sum((F.lit(turn[j][i]) * (F.col(a) - F.lit(shift[j])) for j, a in enumerate(axes)), F.lit(0.0)).alias(name) for i, name in enumerate(axes)]
