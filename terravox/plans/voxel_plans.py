"""Queries on points and voxels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terravox.functions.geometry import AXES
from terravox.operators import voxels as V
from terravox.sources.tables import PTS_EV, PTS_LI, event_points, lineitem_points

CELL = ["ix", "iy", "iz"]
SQL_CELL = "CAST(floor(x) AS BIGINT) ix, CAST(floor(y) AS BIGINT) iy, CAST(floor(z) AS BIGINT) iz"
CYLINDER = dict(x=25.0, y=25.0, radius=20.0, low=-100.0, high=100.0)


def voxel_downsample(spark, sf_dir):
    """Cylinder window, then one centroid per voxel with enough points."""
    inside = lineitem_points(spark, sf_dir).filter(V.in_cylinder(**CYLINDER))
    return V.voxels(inside, 1.0).filter("n >= 2").select(*CELL, "n", *V.centroids(None))


VOXEL_DOWNSAMPLE = f"""
WITH {PTS_LI}
SELECT {SQL_CELL}, count(*) n, round(sum(x) / count(*), 4) cx, round(sum(y) / count(*), 4) cy, round(sum(z) / count(*), 4) cz
FROM pts WHERE (x - 25) * (x - 25) + (y - 25) * (y - 25) <= 400 GROUP BY 1, 2, 3 HAVING count(*) >= 2
"""


def voxel_inactive(spark, sf_dir):
    """Voxels below the count that makes them active."""
    return V.voxels(lineitem_points(spark, sf_dir), 1.0).filter("n < 5").select(*CELL, "n")


VOXEL_INACTIVE = f"WITH {PTS_LI} SELECT {SQL_CELL}, count(*) n FROM pts GROUP BY 1, 2, 3 HAVING count(*) < 5"


def voxel_incremental_two_batches(spark, sf_dir):
    """State of a first batch merged with a second one, and the voxels the second one activated."""
    points = lineitem_points(spark, sf_dir)
    first, second = (V.voxels(points.filter(F.pmod("batch", F.lit(2)) == b), 1.0) for b in (0, 1))
    return V.merged(first, second, 5).select(*CELL, "n", *V.centroids(None), "became_active")


VOXEL_INCREMENTAL = f"""
WITH {PTS_LI}, v AS (SELECT {SQL_CELL}, x, y, z, batch % 2 b FROM pts)
SELECT ix, iy, iz, count(*) n, round(sum(x) / count(*), 4) cx, round(sum(y) / count(*), 4) cy, round(sum(z) / count(*), 4) cz,
       count(*) FILTER (b = 0) < 5 AND count(*) >= 5 became_active
FROM v GROUP BY 1, 2, 3
"""


def cylinder_filter(spark, sf_dir):
    """Points that stay in the moving window of their robot's last pose; a segment that loses one is invalid."""
    points = event_points(spark, sf_dir)
    last = points.groupBy("robot").agg(F.max_by(F.struct("x", "y"), F.struct("sec", "pid")).alias("p"))
    near = points.join(last, "robot").withColumn("d2", (F.col("x") - F.col("p.x")) * (F.col("x") - F.col("p.x")) + (F.col("y") - F.col("p.y")) * (F.col("y") - F.col("p.y")))
    return near.groupBy("robot").agg(F.count_if(F.col("d2") <= 100).alias("n_kept"), F.count_if(F.col("d2") > 100).alias("n_removed"), (F.count_if(F.col("d2") > 100) > 0).alias("invalid"))


CYLINDER_FILTER = f"""
WITH {PTS_EV}, last AS (SELECT robot, arg_max(x, (sec, pid)) px, arg_max(y, (sec, pid)) py FROM pts GROUP BY 1),
d AS (SELECT robot, (x - px) * (x - px) + (y - py) * (y - py) d2 FROM pts JOIN last USING (robot))
SELECT robot, count(*) FILTER (d2 <= 100) n_kept, count(*) FILTER (d2 > 100) n_removed, count(*) FILTER (d2 > 100) > 0 invalid FROM d GROUP BY 1
"""


def voxel_occupancy(spark, sf_dir):
    """Occupied voxels of each segment in a grid centred on it."""
    points = lineitem_points(spark, sf_dir).filter("segment IS NOT NULL").select("segment", *AXES)
    centre = points.groupBy("segment").agg(*[F.round(F.avg(a), 3).alias(f"m{a}") for a in AXES])
    grid = points.join(centre, "segment")
    for a, size, n in (("x", 2.0, 32), ("y", 2.0, 32), ("z", 1.0, 16)):
        grid = grid.withColumn(f"i{a}", F.floor((F.col(a) - F.col(f"m{a}")) / size + (n - 1) / 2).cast("long")).filter(F.col(f"i{a}").between(0, n - 1))
    # Occupied voxels are bits that fill as a segment's rows stream by: no table of a task's voxels is held.
    place = F.col("ix") * 512 + F.col("iy") * 16 + F.col("iz")
    return grid.groupBy("segment").agg(F.bitmap_count(F.bitmap_construct_agg(place)).alias("n_occupied"), F.count("*").alias("n_inside"))


VOXEL_OCCUPANCY = f"""
WITH {PTS_LI}, m AS (SELECT segment, round(avg(x), 3) mx, round(avg(y), 3) my, round(avg(z), 3) mz FROM pts GROUP BY 1),
g AS (SELECT segment, floor((x - mx) / 2.0 + 15.5) ix, floor((y - my) / 2.0 + 15.5) iy, floor((z - mz) / 1.0 + 7.5) iz FROM pts JOIN m USING (segment))
SELECT segment, count(DISTINCT (ix, iy, iz)) n_occupied, count(*) n_inside FROM g
WHERE ix BETWEEN 0 AND 31 AND iy BETWEEN 0 AND 31 AND iz BETWEEN 0 AND 15 GROUP BY 1
"""


def stride_sample(spark, sf_dir):
    """Every twentieth point of each track, in time."""
    w = Window.partitionBy("robot").orderBy("sec", "pid")
    return event_points(spark, sf_dir).withColumn("n", F.row_number().over(w).cast("long")).filter("n % 20 = 1").select("robot", "pid", "n")


STRIDE_SAMPLE = f"WITH {PTS_EV} SELECT robot, pid, n FROM (SELECT robot, pid, row_number() OVER (PARTITION BY robot ORDER BY sec, pid) n FROM pts) WHERE n % 20 = 1"


def topk_voxels(spark, sf_dir):
    """The five fullest voxels of each layer of height."""
    w = Window.partitionBy("iz").orderBy(F.desc("n"), "ix", "iy")
    return V.voxels(lineitem_points(spark, sf_dir), 1.0).withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 5").select(*CELL, "n", "rank")


TOPK_VOXELS = f"""
WITH {PTS_LI}, v AS (SELECT {SQL_CELL}, count(*) n FROM pts GROUP BY 1, 2, 3)
SELECT ix, iy, iz, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY iz ORDER BY n DESC, ix, iy) rank FROM v) WHERE rank <= 5
"""


def jaccard(spark, sf_dir):
    """Overlap of the occupied voxels of consecutive views of a segment: intersection over union."""
    cells = V.keyed(lineitem_points(spark, sf_dir), 5.0).select("segment", "view", *CELL).distinct()
    both = cells.unionByName(cells.withColumn("view", F.col("view") - 1).withColumn("later", F.lit(1)), allowMissingColumns=True)
    seen = both.groupBy("segment", "view", *CELL).agg(F.count(F.when(F.col("later").isNull(), 1)).alias("a"), F.count("later").alias("b"))
    return seen.groupBy("segment", "view").agg(F.sum(F.col("a") * F.col("b")).alias("both"), F.count("*").alias("either"), F.sum("a").alias("na"), F.sum("b").alias("nb")).filter("na > 0 AND nb > 0").select(
        "segment", "view", "both", "either", F.round(F.col("both") / F.col("either"), 6).alias("jaccard"))


JACCARD = f"""
WITH {PTS_LI}, c AS (SELECT DISTINCT segment, view, floor(x / 5) ix, floor(y / 5) iy, floor(z / 5) iz FROM pts),
n AS (SELECT segment, view, count(*) k FROM c GROUP BY 1, 2),
i AS (SELECT a.segment, a.view, count(*) k FROM c a JOIN c b ON a.segment = b.segment AND b.view = a.view + 1 AND a.ix = b.ix AND a.iy = b.iy AND a.iz = b.iz GROUP BY 1, 2)
SELECT a.segment, a.view, coalesce(i.k, 0) AS both, a.k + b.k - coalesce(i.k, 0) AS either, round(coalesce(i.k, 0) / (a.k + b.k - coalesce(i.k, 0)), 6) jaccard
FROM n a JOIN n b ON a.segment = b.segment AND b.view = a.view + 1 LEFT JOIN i ON i.segment = a.segment AND i.view = a.view
"""


def remove_similar(spark, sf_dir):
    """Views without those of which a later one differs in fewer than six voxels, by Hamming distance of the occupied sets."""
    cells = V.keyed(lineitem_points(spark, sf_dir), 5.0).select("segment", "view", *CELL).distinct()
    size = cells.groupBy("segment", "view").agg(F.count("*").alias("k"))
    a, b = size.alias("a"), size.alias("b")
    pairs = a.join(b, (F.col("a.segment") == F.col("b.segment")) & (F.col("a.view") < F.col("b.view"))).select(
        F.col("a.segment").alias("segment"), F.col("a.view").alias("view"), F.col("b.view").alias("later"), F.col("a.k").alias("ka"), F.col("b.k").alias("kb"))
    later = cells.withColumnRenamed("view", "later")
    common = cells.join(later, ["segment", *CELL]).filter("view < later").groupBy("segment", "view", "later").agg(F.count("*").alias("both"))
    differ = F.col("ka") + F.col("kb") - 2 * F.coalesce("both", F.lit(0))
    similar = pairs.join(common, ["segment", "view", "later"], "left").filter(differ < 6).select("segment", "view")
    return size.join(similar, ["segment", "view"], "left_anti").select("segment", "view", "k")


REMOVE_SIMILAR = f"""
WITH {PTS_LI}, c AS (SELECT DISTINCT segment, view, floor(x / 5) ix, floor(y / 5) iy, floor(z / 5) iz FROM pts),
n AS (SELECT segment, view, count(*) k FROM c GROUP BY 1, 2)
SELECT segment, view, k FROM n ANTI JOIN (SELECT DISTINCT a.segment, a.view FROM n a JOIN n b ON a.segment = b.segment AND a.view < b.view
WHERE a.k + b.k - 2 * (SELECT count(*) FROM c p JOIN c q ON p.segment = q.segment AND p.ix = q.ix AND p.iy = q.iy AND p.iz = q.iz WHERE p.segment = a.segment AND p.view = a.view AND q.view = b.view) < 6) USING (segment, view)
"""

PACK = {
    "voxel_downsample": (voxel_downsample, VOXEL_DOWNSAMPLE),
    "voxel_inactive": (voxel_inactive, VOXEL_INACTIVE),
    "voxel_incremental_two_batches": (voxel_incremental_two_batches, VOXEL_INCREMENTAL),
    "cylinder_filter": (cylinder_filter, CYLINDER_FILTER),
    "voxel_occupancy": (voxel_occupancy, VOXEL_OCCUPANCY),
    "stride_sample": (stride_sample, STRIDE_SAMPLE),
    "topk_voxels": (topk_voxels, TOPK_VOXELS),
    "jaccard": (jaccard, JACCARD),
    "remove_similar": (remove_similar, REMOVE_SIMILAR),
}
