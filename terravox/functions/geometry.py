"""Column builders for 3-D geometry; all stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
#: The largest value of each eigenvalue feature, by which it is scaled.
EIGEN_SCALE = {"linearity": 28890.9, "planarity": 95919.2, "scattering": 124811.0, "omnivariance": 0.278636, "anisotropy": 124810.0, "entropy": 0.956129, "change_of_curvature": 0.99702}


def voxel_index(value: Column, size: float, origin: float = 0.0) -> Column:
    """Index of the voxel that holds a coordinate, counted from the origin."""
    return F.floor((value - F.lit(origin)) / F.lit(size)).cast("long")


def voxel_key(ix: Column, iy: Column, iz: Column, bits: int = 20) -> Column:
    """One integer for a voxel of a bounded grid; indices count from 0."""
    return ix + F.shiftleft(iy, bits) + F.shiftleft(iz, 2 * bits)


def distance(a: str, b: str, dims=AXES) -> Column:
    out = F.lit(0.0)
    for d in dims:
        gap = F.col(f"{a}.{d}") - F.col(f"{b}.{d}")
        out = out + gap * gap
    return F.sqrt(out)


def covariance(dims=AXES) -> list[Column]:
    """Population covariances of the axes as aggregates cxx, cxy, ..."""
    return [F.covar_pop(a, b).alias(f"c{a}{b}") for i, a in enumerate(dims) for b in dims[i:]]


def eigenvalues_sql() -> str:
    """SQL of the ascending eigenvalues e1, e2, e3 of columns cxx cyy czz cxy cxz cyz, in both dialects.

    Trigonometric closed form of a symmetric 3 x 3 matrix; the argument of acos is clamped, and a multiple of the identity
    has three equal values.
    """
    return """
    SELECT *, CASE WHEN p > 0 THEN q + 2 * p * cos(phi + 2.0943951023931953) ELSE q END AS e1,
              CASE WHEN p > 0 THEN 3 * q - (q + 2 * p * cos(phi)) - (q + 2 * p * cos(phi + 2.0943951023931953)) ELSE q END AS e2,
              CASE WHEN p > 0 THEN q + 2 * p * cos(phi) ELSE q END AS e3
    FROM (SELECT *, acos(least(1.0, greatest(-1.0, CASE WHEN p > 0 THEN (
              (cxx - q) * ((cyy - q) * (czz - q) - cyz * cyz) - cxy * (cxy * (czz - q) - cyz * cxz) + cxz * (cxy * cyz - (cyy - q) * cxz)) / (2 * p * p * p) ELSE 1.0 END))) / 3 AS phi
          FROM (SELECT *, sqrt(((cxx - q) * (cxx - q) + (cyy - q) * (cyy - q) + (czz - q) * (czz - q) + 2 * (cxy * cxy + cxz * cxz + cyz * cyz)) / 6) AS p
                FROM (SELECT *, (cxx + cyy + czz) / 3 AS q FROM moments)))
    """
