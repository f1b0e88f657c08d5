"""Queries on the sliding window around each robot, run as streams to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravox.plans.segment_plans import TIE
from terravox.shared import shared_dir
from terravox.sources.tables import PTS_EV, event_points, points_of_events
from terravox.streaming.map_loop import Settings, latest, run_loop
from terravox.streaming.streams import points_stream
from terravox.streaming.window import sliding_window, snapshot

SIZE, LEAST, RADIUS, LOW, HIGH, SECTORS = 8.0, 2, 15.0, -5.0, 5.0, 4
DAY = 86400


def scans(points):
    """Steps of robots: a day's events are its scan, and its latest event is its pose."""
    kinds = F.explode(F.array(F.lit(True), F.lit(False))).alias("pose")
    return points.select("robot", F.floor(F.col("sec") / DAY).alias("step"), F.col("pid").alias("at"), kinds, "x", "y", "z")


def windows(spark, sf_dir, files_per_batch=None, path=None):
    stream = points_of_events(points_stream(spark, sf_dir, "events", files_per_batch))
    return sliding_window(scans(stream), SIZE, LEAST, RADIUS, LOW, HIGH, SECTORS, path)


def _rounded(rows, columns):
    return [F.round(F.col(c) + TIE, 4).alias(c) if c.startswith("c") else F.col(c) for c in columns]


def stream_window(spark, sf_dir):
    """What each step did to the active voxels of each robot's window: places before and after, -1 where a voxel was or is not there."""
    moves = windows(spark, sf_dir)[0]
    return moves.select(*_rounded(moves, moves.columns))


def window_state(spark, sf_dir):
    """The windows as the stream's state holds them after its last batch, voxels that are not active yet among them."""
    state = snapshot(spark, windows(spark, sf_dir)[1])
    means = state.select("robot", "sector", "ix", "iy", "iz", "n", *[(F.col(f"s{a}") / F.col("n")).alias(f"c{a}") for a in "xyz"])
    return means.select(*_rounded(means, means.columns))


#: Every voxel that ever holds a point, carried from each step of its robot to the next: emptied if the pose leaves it behind, then filled.
SQL_WINDOW = f"""
WITH RECURSIVE {PTS_EV}, p AS (SELECT robot, sec // {DAY} step, pid, x, y, z, CAST(floor(x / {SIZE}) AS BIGINT) ix, CAST(floor(y / {SIZE}) AS BIGINT) iy, CAST(floor(z / {SIZE}) AS BIGINT) iz FROM pts),
k AS MATERIALIZED (SELECT robot, step, row_number() OVER (PARTITION BY robot ORDER BY step) nth, arg_max(x, pid) px, arg_max(y, pid) py, arg_max(z, pid) pz FROM p GROUP BY 1, 2),
i AS MATERIALIZED (SELECT robot, ix, iy, iz, nth, count(*) n, sum(x) sx, sum(y) sy, sum(z) sz FROM p JOIN k USING (robot, step) GROUP BY 1, 2, 3, 4, 5),
w(robot, ix, iy, iz, nth, was, gone, n, sx, sy, sz, lx, ly, lz) AS (
  SELECT DISTINCT robot, ix, iy, iz, 0::BIGINT, 0::BIGINT, FALSE, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM i UNION ALL
  SELECT robot, ix, iy, iz, nth, was, gone, CASE WHEN gone THEN 0 ELSE was END + coalesce(f.n, 0), CASE WHEN gone THEN 0 ELSE t.sx END + coalesce(f.sx, 0), CASE WHEN gone THEN 0 ELSE t.sy END + coalesce(f.sy, 0), CASE WHEN gone THEN 0 ELSE t.sz END + coalesce(f.sz, 0), t.sx, t.sy, t.sz
  FROM (SELECT w.robot, w.ix, w.iy, w.iz, k.nth, w.n was, w.sx, w.sy, w.sz, w.n > 0 AND NOT ((w.sx / w.n - px) * (w.sx / w.n - px) + (w.sy / w.n - py) * (w.sy / w.n - py) <= {RADIUS * RADIUS} AND w.sz / w.n - pz BETWEEN {LOW} AND {HIGH}) gone
        FROM w JOIN k ON k.robot = w.robot AND k.nth = w.nth + 1) t LEFT JOIN i f USING (robot, ix, iy, iz, nth)),
v AS (SELECT w.*, k.step, (((ix * 7 + iy * 13 + iz * 29) % {SECTORS}) + {SECTORS}) % {SECTORS} sector FROM w JOIN k USING (robot, nth))
"""
STREAM_WINDOW = f"""{SQL_WINDOW},
a AS (SELECT *, was >= {LEAST} old, n >= {LEAST} new, row_number() OVER (PARTITION BY robot, sector, step, was >= {LEAST} ORDER BY ix, iy, iz) - 1 op, row_number() OVER (PARTITION BY robot, sector, step, n >= {LEAST} ORDER BY ix, iy, iz) - 1 np FROM v)
SELECT robot, sector, step, ix, iy, iz, CASE WHEN old THEN op ELSE -1 END old_place, CASE WHEN new THEN np ELSE -1 END new_place, CASE WHEN new THEN n ELSE was END n,
  {', '.join(f'round(CASE WHEN new THEN s{a} / n ELSE l{a} / was END + {TIE}, 4) c{a}' for a in 'xyz')} FROM a WHERE old OR new
"""
WINDOW_STATE = f"""{SQL_WINDOW}
SELECT robot, sector, ix, iy, iz, n, {', '.join(f'round(s{a} / n + {TIE}, 4) c{a}' for a in 'xyz')} FROM v QUALIFY nth = max(nth) OVER (PARTITION BY robot) AND n > 0
"""

def map_loop(spark, sf_dir):
    """The target map after the events came in by halves of their month: tracks segmented, recognised or transferred, duplicates removed."""
    events = event_points(spark, sf_dir).select("track", F.col("sec").cast("double").alias("sec"), F.explode(F.array(F.lit(True), F.lit(False))).alias("pose"), F.col("pid").alias("at"), "x", "y", "z")
    folder = shared_dir(spark, "scans")
    half = F.floor(F.pmod(F.col("sec") / DAY, F.lit(31)) / 16)
    for k in range(2):
        events.filter(half == k).write.mode("append").parquet(f"{folder}/half={k}")
    files = max(1, max(len(spark.read.parquet(f"{folder}/half={k}").inputFiles()) for k in range(2)))
    scans = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(folder)
    state = run_loop(scans, Settings(size=1.0, near=1.5, drive=1.0, largest=100_000, apart=86_400.0))
    target = state.table("target", latest(state))
    return target.select("segment", "track", "n", *[F.round(F.col(a) + TIE, 4).alias(a) for a in "xyz"])


PACK = {"stream_window": (stream_window, STREAM_WINDOW), "window_state": (window_state, WINDOW_STATE), "map_loop": (map_loop, None)}
