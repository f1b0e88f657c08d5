"""Queries on the preparation of segments for a learned descriptor, and on shape histograms.

What the training code draws at random comes from fixed arithmetic on ids here, so that every engine and every run agrees.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from terravox.functions.geometry import AXES
from terravox.shared import written
from terravox.ship import ship
from terravox.sources.tables import PTS_LI, event_points, lineitem_points

TIE = 1e-7
STEPS = (1, 2, 3, 5, 8, 13, 21, 34)
SQL_CENTRED = "c AS (SELECT segment, view, batch, x - avg(x) OVER (PARTITION BY segment) x, y - avg(y) OVER (PARTITION BY segment) y, z - avg(z) OVER (PARTITION BY segment) z FROM pts)"


def _centred(spark, sf_dir):
    w = Window.partitionBy("segment")
    return lineitem_points(spark, sf_dir).select("segment", "view", "batch", *[(F.col(a) - F.avg(a).over(w)).alias(a) for a in AXES])


def shape_histogram(spark, sf_dir):
    """Distances between points of a segment in eight bins.

    Each point is paired with eight others at fixed steps in a fixed order, so the work grows with the points, not with their pairs.
    """
    w = Window.partitionBy("segment").orderBy("batch", "view", "x", "y", "z")
    ranked = lineitem_points(spark, sf_dir).withColumn("r", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("segment")))
    asked = ranked.withColumn("step", F.explode(F.array(*map(F.lit, STEPS)))).filter("step < n").withColumn("partner", (F.col("r") + F.col("step")) % F.col("n"))
    others = ranked.select("segment", F.col("r").alias("partner"), *[F.col(a).alias(f"o{a}") for a in AXES])
    gap = lambda a: (F.col(a) - F.col(f"o{a}")) * (F.col(a) - F.col(f"o{a}"))
    d = asked.join(others, ["segment", "partner"]).withColumn("bin", F.least(F.floor(F.sqrt(gap("x") + gap("y") + gap("z")) / 10), F.lit(7)).cast("long"))
    return d.groupBy("segment", "bin").agg(F.count("*").alias("n"))


SHAPE = f"""
WITH {PTS_LI}, r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY batch, view, x, y, z) - 1 r, count(*) OVER (PARTITION BY segment) n FROM pts), s AS (SELECT unnest({list(STEPS)}) step)
SELECT a.segment, CAST(least(floor(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) / 10), 7) AS BIGINT) bin, count(*) n
FROM r a JOIN s ON s.step < a.n JOIN r b ON b.segment = a.segment AND b.r = (a.r + s.step) % a.n GROUP BY 1, 2
"""


def augment_rotation(spark, sf_dir):
    """Segments turned about the height axis by an angle drawn from their id; second moments after the turn."""
    angle = F.pmod(F.col("segment") * 7919, F.lit(360)).cast("double") * 0.017453292519943295
    turned = _centred(spark, sf_dir).select("segment", (F.cos(angle) * F.col("x") - F.sin(angle) * F.col("y")).alias("x"), (F.sin(angle) * F.col("x") + F.cos(angle) * F.col("y")).alias("y"))
    return turned.groupBy("segment").agg(F.round(F.avg(F.col("x") * F.col("x")) + TIE, 4).alias("xx"), F.round(F.avg(F.col("y") * F.col("y")) + TIE, 4).alias("yy"))


ROTATION = f"""
WITH {PTS_LI}, {SQL_CENTRED}, t AS (SELECT *, CAST(segment * 7919 % 360 AS DOUBLE) * CAST(0.017453292519943295 AS DOUBLE) a FROM c), u AS (SELECT segment, cos(a) * x - sin(a) * y x, sin(a) * x + cos(a) * y y FROM t)
SELECT segment, round(avg(x * x) + {TIE}, 4) xx, round(avg(y * y) + {TIE}, 4) yy FROM u GROUP BY 1
"""


def augment_remove_random(spark, sf_dir):
    """A share of each segment's points dropped, one in five by their ids."""
    kept = lineitem_points(spark, sf_dir).filter(F.pmod(F.col("batch") * 31 + F.col("view") * 17 + F.col("segment"), F.lit(5)) > 0)
    return kept.groupBy("segment").agg(F.count("*").alias("n"))


CANDIDATES, LEAST_CUT, MOST_CUT, REACH = 16, 0.1, 0.5, 25
_DEGREE = "CAST(0.017453292519943295 AS DOUBLE)"


def _keeps(k: int) -> str:
    """Whether a centred point lies on the kept side of a segment's k-th plane, in both dialects: direction and offset come from the id and k."""
    a, b = (f"CAST((segment * {f} + {k * g}) % {n} AS DOUBLE) * {_DEGREE}" for f, g, n in ((104729, 7919, 360), (31, 17, 180)))
    side = f"round(cx * (cos({a}) * sin({b})) + cy * (sin({a}) * sin({b})) + cz * cos({b}), 6)"
    return f"{side} + (CAST((segment * 13 + {k * 37}) % 100 AS DOUBLE) / 49.5 - 1) * {REACH} > 0"


def _accepted(n: str = "n") -> str:
    """The first plane that takes away a share between the bounds, in both dialects; -1 where none does."""
    takes = lambda k: f"1 - CAST(k{k} AS DOUBLE) / {n} > {LEAST_CUT} AND 1 - CAST(k{k} AS DOUBLE) / {n} < {MOST_CUT}"
    return "CASE " + " ".join(f"WHEN {takes(k)} THEN {k}" for k in range(CANDIDATES)) + " ELSE -1 END"


def _kept(plane: str = "plane") -> str:
    return f"CASE {plane} " + " ".join(f"WHEN {k} THEN {_keeps(k)}" for k in range(CANDIDATES)) + " ELSE TRUE END"


#: How near a plane a point must lie for rounding to decide on which side.
NEAR = 1e-5


def _tried(batches):
    """Of points (segment, cx, cy, cz), by segment: how many there are, how many lie on the kept side of each plane, and those that all but lie on one, as they are."""
    for batch in batches:
        if not batch.num_rows:
            continue
        segment = batch.column("segment").to_numpy()
        c = [batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)]
        there = np.logical_and.reduce([~np.asarray(batch.column(i).is_null()) for i in (1, 2, 3)])
        close, kept = np.zeros(len(segment), bool), []
        for k in range(CANDIDATES):
            a, b = (np.radians(np.fmod(segment * f + k * g, n).astype("f8")) for f, g, n in ((104729, 7919, 360), (31, 17, 180)))
            off = (np.fmod(segment * 13 + k * 37, 100) / 49.5 - 1) * REACH
            gap = c[0] * (np.cos(a) * np.sin(b)) + c[1] * (np.sin(a) * np.sin(b)) + c[2] * np.cos(b) + off
            close |= there & ~(np.abs(gap) >= NEAR)
            kept.append(gap > 0)
        sure = there & ~close
        starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        sums = [np.add.reduceat(x.astype("i8"), starts) for x in (np.ones(len(segment)), *(k & sure for k in kept))]
        nothing = np.zeros(int(close.sum()), "i8")
        none = pa.nulls(len(starts), pa.float64())
        columns = [pa.array(np.r_[segment[starts], segment[close]]), *[pa.array(np.r_[x, nothing]) for x in sums], *[pa.concat_arrays([none, pa.array(x[close])]) for x in c]]
        yield pa.RecordBatch.from_arrays(columns, ["segment", "n", *[f"f{k}" for k in range(CANDIDATES)], "cx", "cy", "cz"])


def plane_cut(points):
    """points (segment, x, y, z, ...) with ``plane``, without what the first acceptable plane of their segment cuts off.

    All candidate planes of all segments are tried in one aggregation; a segment that none of them suits stays whole. What is known per
    segment is written, so that it goes to the points and not they to it while it is small. Batches of points are
    tried at once in numpy; only the few points that all but lie on a plane are judged by the rounded distance, as SQL rounds it.
    """
    ship(points.sparkSession)
    middle = written(points.groupBy("segment").agg(*[F.avg(a).alias(f"m{a}") for a in AXES]), "middles").filter("segment IS NOT NULL")
    centre = lambda rows: rows.withColumns({f"c{a}": F.round(F.col(a) - F.col(f"m{a}"), 6) for a in AXES}).drop(*[f"m{a}" for a in AXES])
    centred = centre(points.select("segment", *AXES).join(middle, "segment")).select("segment", "cx", "cy", "cz")
    schema = "segment long, n long, " + ", ".join(f"f{k} long" for k in range(CANDIDATES)) + ", cx double, cy double, cz double"
    parts = centred.repartition("segment").sortWithinPartitions("segment").mapInArrow(_tried, schema)
    counts = [F.sum(c).alias(c) for c in ("n", *[f"f{k}" for k in range(CANDIDATES)])]
    tried = parts.groupBy("segment").agg(*counts, F.collect_list(F.when(F.col("cx").isNotNull(), F.struct("cx", "cy", "cz"))).alias("close"))
    exact = [F.expr(f"f{k} + size(filter(transform(close, p -> {_keeps(k).replace('cx', 'p.cx').replace('cy', 'p.cy').replace('cz', 'p.cz')}), kept -> kept))").cast("long").alias(f"k{k}") for k in range(CANDIDATES)]
    tried = written(tried, "tried").select("segment", "n", *exact)
    a, b = (f"CAST((segment * {f} + plane * {g}) % {n} AS DOUBLE) * {_DEGREE}" for f, g, n in ((104729, 7919, 360), (31, 17, 180)))
    chosen = {"ux": f"cos({a}) * sin({b})", "uy": f"sin({a}) * sin({b})", "uz": f"cos({b})", "off": f"(CAST((segment * 13 + plane * 37) % 100 AS DOUBLE) / 49.5 - 1) * {REACH}"}
    planes = written(tried.select("segment", F.expr(_accepted()).alias("plane")).withColumns({c: F.expr(e) for c, e in chosen.items()}).join(middle, "segment"), "planes")
    kept = centre(points.join(planes, "segment")).filter("plane = -1 OR round(cx * ux + cy * uy + cz * uz, 6) + off > 0")
    return kept.drop(*chosen, *[f"c{a}" for a in AXES])


def augment_remove_plane(spark, sf_dir):
    """What a plane through each segment leaves of it: the first of its random planes that takes between a tenth and a half."""
    return plane_cut(lineitem_points(spark, sf_dir)).groupBy("segment").agg(F.count("*").alias("n"), F.max("plane").cast("long").alias("plane"))


def _plane_sql(points: str) -> str:
    """Common table expressions from ``points`` to ``cut``."""
    return f"""
mid AS (SELECT segment, {', '.join(f'avg({a}) m{a}' for a in AXES)} FROM {points} GROUP BY 1),
cen AS (SELECT p.*, {', '.join(f'round({a} - m{a}, 6) c{a}' for a in AXES)} FROM {points} p JOIN mid USING (segment)),
tried AS (SELECT segment, count(*) n, {', '.join(f'count(*) FILTER ({_keeps(k)}) k{k}' for k in range(CANDIDATES))} FROM cen GROUP BY 1),
cut AS (SELECT cen.*, plane FROM cen JOIN (SELECT segment, {_accepted()} plane FROM tried) USING (segment) WHERE {_kept()})"""


PLANE = f"WITH {PTS_LI}, {_plane_sql('pts')} SELECT segment, count(*) n, CAST(max(plane) AS BIGINT) plane FROM cut GROUP BY 1"


def rescale_fit(spark, sf_dir):
    """Extents of each segment per axis, with a floor, and the scale that makes it fill a grid."""
    box = lineitem_points(spark, sf_dir).groupBy("segment").agg(*[F.greatest(F.max(a) - F.min(a), F.lit(f)).alias(f"e{a}") for a, f in zip(AXES, (3.2, 3.2, 1.6))])
    return box.select("segment", *[F.round(n / F.col(f"e{a}") + TIE, 4).alias(f"s{a}") for a, n in zip(AXES, (31, 31, 15))])


RESCALE = f"WITH {PTS_LI} SELECT segment, " + ", ".join(f"round({n} / greatest(max({a}) - min({a}), CAST({f} AS DOUBLE)) + {TIE}, 4) s{a}" for a, n, f in zip(AXES, (31, 31, 15), (3.2, 3.2, 1.6))) + " FROM pts GROUP BY 1"


def align_robot(spark, sf_dir):
    """Segments centred and turned so that the place from which each was seen lies along the first axis; second moments after the turn.

    A segment was seen from the position of the event of its id; one without a position is left out.
    """
    seen = event_points(spark, sf_dir).select(F.col("pid").alias("segment"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    points = lineitem_points(spark, sf_dir)
    middle = points.groupBy("segment").agg(F.avg("x").alias("mx"), F.avg("y").alias("my")).join(seen, "segment")
    middle = written(middle.select("segment", "mx", "my", F.atan2(F.col("ry") - F.col("my"), F.col("rx") - F.col("mx")).alias("angle")), "middles")
    x, y, angle = F.col("x") - F.col("mx"), F.col("y") - F.col("my"), F.col("angle")
    turned = points.join(middle, "segment").select("segment", "angle", (x * F.cos(angle) + y * F.sin(angle)).alias("u"), (y * F.cos(angle) - x * F.sin(angle)).alias("v"))
    return turned.groupBy("segment").agg(F.round(F.max("angle") + TIE, 4).alias("angle"), F.round(F.avg(F.col("u") * F.col("u")) + TIE, 3).alias("uu"), F.round(F.avg(F.col("v") * F.col("v")) + TIE, 3).alias("vv"))


ALIGN = f"""
WITH {PTS_LI}, e AS (SELECT event_id segment, value / 10 rx, (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 1800.0 ry FROM events),
m AS (SELECT segment, x - avg(x) OVER w x, y - avg(y) OVER w y, atan2(ry - avg(y) OVER w, rx - avg(x) OVER w) t FROM pts JOIN e USING (segment) WINDOW w AS (PARTITION BY segment)),
r AS (SELECT segment, t, x * cos(t) + y * sin(t) u, y * cos(t) - x * sin(t) v FROM m)
SELECT segment, round(max(t) + {TIE}, 4) angle, round(avg(u * u) + {TIE}, 3) uu, round(avg(v * v) + {TIE}, 3) vv FROM r GROUP BY 1
"""


def augment_jitter(spark, sf_dir):
    """Segments moved by an offset drawn from their id, up to a tenth of half a grid of 32 x 32 x 16 voxels; their new centroids."""
    offset = lambda k, n: (F.pmod(F.col("segment") * k, F.lit(2001)) / 1000.0 - 1) * (0.1 * n / 2)
    cen = lineitem_points(spark, sf_dir).groupBy("segment").agg(*[F.avg(a).alias(a) for a in AXES])
    return cen.select("segment", *[F.round(F.col(a) + offset(k, n) + TIE, 4).alias(a) for a, k, n in zip(AXES, (7919, 104729, 1299709), (32, 32, 16))])


JITTER = f"WITH {PTS_LI} SELECT segment, " + ", ".join(f"round(avg({a}) + (segment * {k} % 2001 / 1000.0::DOUBLE - 1) * CAST({0.1 * n / 2} AS DOUBLE) + {TIE}, 4) {a}" for a, k, n in zip(AXES, (7919, 104729, 1299709), (32, 32, 16))) + " FROM pts GROUP BY 1"


#: The turn that aligns a segment with its main axis, half a turn more if fewer points than half lie below its middle, less a random turn of up to 20 degrees.
_TURN = f"t + CASE WHEN 2 * below < n THEN CAST(3.141592653589793 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END - CAST(segment * 7919 % 41 - 20 AS DOUBLE) * {_DEGREE}"


def preprocess_chain(spark, sf_dir):
    """All steps in their order: a fifth of the points dropped, a plane's cut, the turn onto the main axis and its flip, a random turn, the scale that fits a grid, jitter, voxels, standardisation.

    Returns each segment's occupied voxels, the points that jitter left inside the grid, and its occupancy standardised over all segments.
    What a step finds per segment is written and joined to the points, which are not shuffled for it while it is small. The points that are
    left, and those turned, are written, so that no step repeats the ones before it.
    """
    points = plane_cut(lineitem_points(spark, sf_dir).filter(F.pmod(F.col("batch") * 31 + F.col("view") * 17 + F.col("segment"), F.lit(5)) > 0).select("segment", *AXES)).select("segment", *AXES)
    points = written(points, "cut")
    axes = written(points.groupBy("segment").agg(F.round(0.5 * F.atan2(2 * F.covar_pop("x", "y"), F.var_pop("x") - F.var_pop("y")), 5).alias("t"), F.round(F.avg("y"), 6).alias("my"), F.count("*").alias("n")), "axes")
    below = written(points.join(axes.select("segment", "my"), "segment").groupBy("segment").agg(F.count_if(F.round("y", 6) < F.col("my")).alias("below")), "below")
    turns = written(axes.join(below, "segment").select("segment", F.round(F.expr(_TURN), 5).alias("t")).select("segment", F.cos("t").alias("c"), F.sin("t").alias("s")), "turns")
    turned = points.join(turns, "segment").select("segment", F.round(F.col("c") * F.col("x") + F.col("s") * F.col("y"), 4).alias("x"), F.round(F.col("c") * F.col("y") - F.col("s") * F.col("x"), 4).alias("y"), F.round("z", 4).alias("z"))
    turned = written(turned, "turned")
    box = written(turned.groupBy("segment").agg(*[F.min(a).alias(f"low_{a}") for a in AXES], *[F.greatest(F.max(a) - F.min(a), F.lit(f)).alias(f"size_{a}") for a, f in zip(AXES, (3.2, 3.2, 1.6))]), "boxes")
    grid = turned.join(box, "segment")
    for a, n, k in zip(AXES, (32, 32, 16), (7919, 104729, 1299709)):
        moved = (F.col(a) - F.col(f"low_{a}")) / F.col(f"size_{a}") * (n - 1) + (F.pmod(F.col("segment") * k, F.lit(21)) / 10.0 - 1) * (0.1 * n / 2)
        grid = grid.withColumn(f"i{a}", F.floor(F.round(moved, 6)).cast("long"))
    inside = grid.filter(" AND ".join(f"i{a} BETWEEN 0 AND {n - 1}" for a, n in zip(AXES, (32, 32, 16))))
    voxels = inside.groupBy("segment", "ix", "iy", "iz").agg(F.count("*").alias("k"))
    filled = written(voxels.groupBy("segment").agg(F.count("*").alias("occupied"), F.sum("k").alias("inside")), "filled")
    scale = filled.agg(F.avg("occupied").alias("m"), F.stddev_pop("occupied").alias("d"))
    return filled.crossJoin(F.broadcast(scale)).select("segment", "occupied", "inside", (F.round((F.col("occupied") - F.col("m")) / F.col("d"), 4) + F.lit(0.0)).alias("standard"))


PROCESS = f"""
WITH {PTS_LI}, k AS (SELECT segment, x, y, z FROM pts WHERE (batch * 31 + view * 17 + segment) % 5 > 0), {_plane_sql('k')},
a AS (SELECT segment, round(0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)), 5) t, round(avg(y), 6) my, count(*) n FROM cut GROUP BY 1),
f AS (SELECT segment, round({_TURN}, 5) t FROM (SELECT segment, any_value(t) t, any_value(n) n, count(*) FILTER (round(y, 6) < a.my) below FROM cut JOIN a USING (segment) GROUP BY 1)),
r AS (SELECT segment, round(cos(t) * x + sin(t) * y, 4) x, round(cos(t) * y - sin(t) * x, 4) y, round(z, 4) z FROM cut JOIN f USING (segment)),
b AS (SELECT segment, """ + ", ".join(f"min({a}) l{a}, greatest(max({a}) - min({a}), CAST({f} AS DOUBLE)) s{a}" for a, f in zip(AXES, (3.2, 3.2, 1.6))) + """ FROM r GROUP BY 1),
g AS (SELECT segment, """ + ", ".join(f"floor(round(({a} - l{a}) / s{a} * {n - 1} + (segment * {k} % 21 / 10.0::DOUBLE - 1) * CAST({0.1 * n / 2} AS DOUBLE), 6)) i{a}" for a, n, k in zip(AXES, (32, 32, 16), (7919, 104729, 1299709))) + """ FROM r JOIN b USING (segment)),
o AS (SELECT segment, count(DISTINCT (ix, iy, iz)) occupied, count(*) inside FROM g WHERE ix BETWEEN 0 AND 31 AND iy BETWEEN 0 AND 31 AND iz BETWEEN 0 AND 15 GROUP BY 1)
SELECT segment, occupied, inside, round((occupied - (SELECT avg(occupied) FROM o)) / (SELECT stddev_pop(occupied) FROM o), 4) + 0.0 standard FROM o
"""

PACK = {
    "shape_histogram": (shape_histogram, SHAPE),
    "augment_rotation": (augment_rotation, ROTATION),
    "augment_remove_random": (augment_remove_random, f"WITH {PTS_LI} SELECT segment, count(*) n FROM pts WHERE (batch * 31 + view * 17 + segment) % 5 > 0 GROUP BY 1"),
    "augment_remove_plane": (augment_remove_plane, PLANE),
    "align_robot": (align_robot, ALIGN),
    "augment_jitter": (augment_jitter, JITTER),
    "preprocess_chain": (preprocess_chain, PROCESS),
    "rescale_fit": (rescale_fit, RESCALE),
}
