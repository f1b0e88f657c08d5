"""Streaming queries, run to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravox.plans.map_plans import GATE
from terravox.sources.tables import PTS_EV, points_of_events
from terravox.streaming.streams import gate, points_stream, voxel_state


def stream_voxels(spark, sf_dir):
    """Voxel counts and centroids kept up to date by a stream of points."""
    state = voxel_state(points_of_events(points_stream(spark, sf_dir, "events")), 1.0)
    return state.select("ix", "iy", "iz", "n", *[F.round(F.col(f"s{a}") / F.col("n") + 1e-7, 4).alias(f"c{a}") for a in "xyz"])


STREAM_VOXELS = f"""
WITH {PTS_EV} SELECT CAST(floor(x) AS BIGINT) ix, CAST(floor(y) AS BIGINT) iy, CAST(floor(z) AS BIGINT) iz, count(*) n,
  round(sum(x) / count(*) + 1e-7, 4) cx, round(sum(y) / count(*) + 1e-7, 4) cy, round(sum(z) / count(*) + 1e-7, 4) cz FROM pts GROUP BY 1, 2, 3
"""


def stream_gate(spark, sf_dir):
    """The drove-enough gate as a stateful stream."""
    poses = points_of_events(points_stream(spark, sf_dir, "events")).select("robot", "sec", "pid", "x")
    return gate(poses, 10.0)


PACK = {"stream_voxels": (stream_voxels, STREAM_VOXELS), "stream_gate": (stream_gate, GATE)}
