"""Queries on state that outlives a batch: segments, normals, consistent matches, moved maps.

Each runs two batches, the second on the state that the first one left; the SQL computes the same from all rows at once.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from terravox.functions.geometry import AXES
from terravox.operators import consistency, segments
from terravox.operators import normals as N
from terravox.operators import voxels as V
from terravox.plans.match_plans import SQL_MATCHES, _matches
from terravox.plans.segment_plans import NORMAL_RADIUS, RADIUS, SQL_COMPONENTS, SQL_WIDE, TIE
from terravox.shared import written
from terravox.sources.tables import PTS_EV, PTS_LI, event_points, lineitem_points

LEAST, MOST = 3, 1000
FIRST = "pid % 3 <> 0"
#: A turn by the angle of a 3-4-5 triangle, and a shift.
TURN, SHIFT = ((0.8, -0.6, 0.0), (0.6, 0.8, 0.0), (0.0, 0.0, 1.0)), (5.0, -2.0, 0.5)


def _segmented(spark, sf_dir):
    points = event_points(spark, sf_dir).select("pid", *AXES)
    none = spark.createDataFrame([], "cluster_id long, segment_id long")
    of_point, clusters, _ = segments.incremental(points.filter(FIRST).withColumn("cluster_id", F.lit(0)), none, RADIUS, LEAST, MOST, 1)
    of_point, clusters = written(of_point, "clusters-of-points"), written(clusters, "clusters")
    next_id = 1 + (clusters.agg(F.max("segment_id")).first()[0] or 0)
    known = points.join(of_point, "pid", "left").fillna(0, ["cluster_id"])
    return segments.incremental(known, clusters.select("cluster_id", "segment_id"), RADIUS, LEAST, MOST, max(1, next_id))


def incremental_segments(spark, sf_dir):
    """Segment ids after a second batch of points joined, extended and founded clusters; -1: too small, -2: invalid."""
    of_point, clusters, _ = _segmented(spark, sf_dir)
    return of_point.join(clusters, "cluster_id").select("pid", "n", "segment_id")


def segment_renames(spark, sf_dir):
    """Ids that gave way to a smaller one when their clusters were joined."""
    return _segmented(spark, sf_dir)[2]


_EDGES = "SELECT a.pid s, b.pid d FROM {t} a JOIN {t} b ON a.z = b.z AND abs(a.x - b.x) <= %s WHERE a.pid <> b.pid AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= %s" % (RADIUS, RADIUS * RADIUS)
SQL_SEGMENTED = f"""
WITH RECURSIVE {PTS_EV}, p1 AS (SELECT * FROM pts WHERE {FIRST}), u1 AS ({_EDGES.format(t='p1')}), u AS ({_EDGES.format(t='pts')}),
r1(n, l) AS (SELECT pid, pid FROM p1 UNION SELECT u1.d, r1.l FROM r1 JOIN u1 ON u1.s = r1.n WHERE r1.l < u1.d), l1 AS (SELECT n AS id, min(l) AS component FROM r1 GROUP BY 1),
nodes AS (SELECT pid id FROM pts), {SQL_COMPONENTS},
c1 AS (SELECT component, count(*) n FROM l1 GROUP BY 1), i1 AS (SELECT component, CASE WHEN n > {MOST} THEN -2 WHEN n < {LEAST} THEN -1 ELSE sum(CASE WHEN n BETWEEN {LEAST} AND {MOST} THEN 1 ELSE 0 END) OVER (ORDER BY component) END id FROM c1),
m AS (SELECT lab.component, lab.id pid, coalesce(i1.id, -1) id FROM lab LEFT JOIN l1 ON l1.id = lab.id LEFT JOIN i1 ON i1.component = l1.component),
c2 AS (SELECT component, count(*) n, min(CASE WHEN id >= 0 THEN id END) known, min(id) = -2 bad FROM m GROUP BY 1),
s2 AS (SELECT *, CASE WHEN bad OR n > {MOST} THEN -2 WHEN known IS NOT NULL THEN known WHEN n >= {LEAST} THEN NULL ELSE -1 END settled FROM c2),
f AS (SELECT *, coalesce(settled, (SELECT coalesce(max(id), 0) FROM i1 WHERE id > 0) + sum(CASE WHEN settled IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY component)) segment_id FROM s2)
"""


def incremental_normals(spark, sf_dir):
    """Moments of neighbourhoods after a second batch, and which points it reached."""
    points = event_points(spark, sf_dir).select("pid", *AXES)
    old, new = points.filter(FIRST), points.filter(f"NOT ({FIRST})")
    state = written(N.neighbour_moments(old, NORMAL_RADIUS), "moments")
    return N.updated(state, old, new, NORMAL_RADIUS).select("pid", "n", "affected", *[F.round(F.col(c) + TIE, 3).alias(c) for c in N.SUMS])


INCREMENTAL_NORMALS = f"""
WITH {PTS_EV}, {SQL_WIDE.replace("a.pid p, b.x", "a.pid p, NOT (a.%s AND b.%s) fresh, b.x" % (FIRST, FIRST))}
SELECT p AS pid, count(*) n, bool_or(fresh) affected, {', '.join(f'round(sum({a}) + {TIE}, 3) s{a}' for a in AXES)}, {', '.join(f'round(sum({a} * {b}) + {TIE}, 3) s{a}{b}' for a, b in N.PAIRS)} FROM near GROUP BY 1
"""


def moments_transformed(spark, sf_dir):
    """Moments of neighbourhoods after the whole map was turned and moved, without its points."""
    state = N.neighbour_moments(event_points(spark, sf_dir), RADIUS)
    return N.transformed(state, TURN, SHIFT).select("pid", "n", *[F.round(F.col(c) + TIE, 3).alias(c) for c in N.SUMS])


SQL_MOVED = "0.8::DOUBLE * {p}x - 0.6::DOUBLE * {p}y + 5 x, 0.6::DOUBLE * {p}x + 0.8::DOUBLE * {p}y - 2 y, {p}z + 0.5::DOUBLE z"
TRANSFORMED = f"""
WITH {PTS_EV}, near AS (SELECT a.pid p, {SQL_MOVED.format(p='b.')} FROM pts a JOIN pts b ON a.z = b.z AND abs(a.x - b.x) <= {RADIUS} WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= {RADIUS * RADIUS})
SELECT p AS pid, count(*) n, {', '.join(f'round(sum({a}) + {TIE}, 3) s{a}' for a in AXES)}, {', '.join(f'round(sum({a} * {b}) + {TIE}, 3) s{a}{b}' for a, b in N.PAIRS)} FROM near GROUP BY 1
"""


def voxels_transformed(spark, sf_dir):
    """A voxel grid moved by a correction of its pose, and points that come in the moved frame.

    Cells keep their keys: new points find theirs by the inverse of the correction, and centroids leave the grid moved.
    """
    points = lineitem_points(spark, sf_dir)
    old = V.voxels(points.filter("batch % 2 = 0"), 1.0)
    late = points.filter("batch % 2 = 1").select(*V.moved(AXES, TURN, SHIFT))
    back = late.select(*[F.round(c, 6).alias(a) for a, c in zip(AXES, V.moved_back(AXES, TURN, SHIFT))])
    state = V.merged(old, V.voxels(back, 1.0), 5)
    mean = state.select("ix", "iy", "iz", "n", *[(F.col(f"s{a}") / F.col("n")).alias(a) for a in AXES])
    return mean.select("ix", "iy", "iz", "n", *[F.round(c + TIE, 3).alias(f"c{a}") for a, c in zip(AXES, V.moved(AXES, TURN, SHIFT))])


VOXELS_MOVED = f"""
WITH {PTS_LI}, k AS (SELECT CASE batch % 2 WHEN 0 THEN x ELSE round(x, 6) END x, CASE batch % 2 WHEN 0 THEN y ELSE round(y, 6) END y, CASE batch % 2 WHEN 0 THEN z ELSE round(z, 6) END z FROM pts),
m AS (SELECT CAST(floor(x) AS BIGINT) ix, CAST(floor(y) AS BIGINT) iy, CAST(floor(z) AS BIGINT) iz, count(*) n, sum(x) / count(*) x, sum(y) / count(*) y, sum(z) / count(*) z FROM k GROUP BY 1, 2, 3),
t AS (SELECT ix, iy, iz, n, {SQL_MOVED.format(p='')} FROM m)
SELECT ix, iy, iz, n, round(x + {TIE}, 3) cx, round(y + {TIE}, 3) cy, round(z + {TIE}, 3) cz FROM t
"""
#: Matches drift between two batches; every eleventh jumps.
DRIFT = "(CASE WHEN pid % 11 = 0 THEN 3.0 ELSE (pid % 7) / 10.0 END)"


def consistency_edges_cached(spark, sf_dir):
    """Consistent pairs after matches drifted and others came, from the cache that the first batch left."""
    first = _matches(spark, sf_dir).withColumnRenamed("robot", "key").select("key", "pid", *consistency.AT)
    second = written(first.withColumns({"sx": F.expr(f"sx + CAST({DRIFT} AS DOUBLE)"), "my": F.expr(f"my + CAST({DRIFT} AS DOUBLE)")}), "matches")
    none = spark.createDataFrame([], "key long, src long, dst long")
    _, held, pairs = consistency.cached_step(first.filter(FIRST), first.limit(0), none, 1.0, 2.0, 3.0)
    held, pairs = written(held, "held"), written(pairs, "pairs")
    return consistency.cached_step(second, held, pairs, 1.0, 2.0, 3.0)[0].withColumnRenamed("key", "robot")


CACHED = f"""
WITH {PTS_EV}, {SQL_MATCHES}, now AS (SELECT pid, robot, sx + CAST({DRIFT} AS DOUBLE) sx, sy, mx, my + CAST({DRIFT} AS DOUBLE) my FROM mat),
d AS (SELECT a.robot, a.pid src, b.pid dst, sqrt((a.sx - b.sx) * (a.sx - b.sx) + (a.sy - b.sy) * (a.sy - b.sy)) ds, sqrt((a.mx - b.mx) * (a.mx - b.mx) + (a.my - b.my) * (a.my - b.my)) dm FROM now a JOIN now b ON a.robot = b.robot AND a.pid < b.pid)
SELECT robot, src, dst FROM d WHERE dm <= 2 AND abs(ds - dm) <= 1
"""

PACK = {
    "incremental_segments": (incremental_segments, SQL_SEGMENTED + "SELECT m.pid, f.n, CAST(f.segment_id AS BIGINT) segment_id FROM m JOIN f USING (component)"),
    "segment_renames": (segment_renames, SQL_SEGMENTED + "SELECT DISTINCT CAST(m.id AS BIGINT) old_id, CAST(f.known AS BIGINT) new_id FROM m JOIN f USING (component) WHERE m.id >= 0 AND m.id <> f.known"),
    "incremental_normals": (incremental_normals, INCREMENTAL_NORMALS),
    "moments_transformed": (moments_transformed, TRANSFORMED),
    "voxels_transformed": (voxels_transformed, VOXELS_MOVED),
    "consistency_edges_cached": (consistency_edges_cached, CACHED),
}
