"""Queries around a learned descriptor: class scores, voxel grids it gives back, named features, training batches.

A descriptor's first ten values stand for the scores of ten classes, and all 64 for a grid of 4 x 4 x 4 occupancies.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from terravox.functions.geometry import AXES
from terravox.operators.folds import numbered
from terravox.operators import classifier
from terravox.shared import written
from terravox.sources.tables import PTS_EV, PTS_LI, descriptors, event_points, lineitem_points

CLASSES, SIDE, BATCH = 10, 4, 64
SQL_SCORES = f"s AS (SELECT vec_id id, label, list_transform(embedding[1:{CLASSES}], lambda v: v::DOUBLE) s FROM embeddings)"
SQL_GRID = "g AS (SELECT id, i // 16 ix, i // 4 % 4 iy, i % 4 iz, least(1.0, abs(v) * 4) p FROM (SELECT vec_id id, unnest(range(0, len(embedding))) i, unnest(embedding)::DOUBLE v FROM embeddings))"


def _scores(spark, sf_dir):
    return descriptors(spark, sf_dir).select("id", "label", F.transform(F.slice("vector", 1, CLASSES), lambda v: v.cast("double")).alias("s"))


def _grid(spark, sf_dir):
    """(id, ix, iy, iz, p): one row per voxel of each grid."""
    flat = descriptors(spark, sf_dir).select("id", F.posexplode("vector").alias("i", "v"))
    place = [F.floor(F.col("i") / 16).alias("ix"), (F.floor(F.col("i") / 4) % 4).alias("iy"), (F.col("i") % 4).cast("long").alias("iz")]
    return flat.select("id", *place, F.least(F.lit(1.0), F.abs(F.col("v").cast("double")) * 4).alias("p"))


def semantic_argmax(spark, sf_dir):
    """The class with the highest score; the first wins ties."""
    return _scores(spark, sf_dir).select("id", (F.array_position("s", F.array_max("s")) - 1).alias("class"), F.round(F.array_max("s"), 6).alias("score"))


def top5_classes(spark, sf_dir):
    """The five best classes of each descriptor, best first."""
    best = F.slice(F.array_sort(F.transform("s", lambda v, i: F.struct((-v).alias("m"), i.cast("long").alias("class")))), 1, 5)
    flat = _scores(spark, sf_dir).select("id", F.posexplode(best).alias("rank", "b"))
    return flat.select("id", (F.col("rank") + 1).cast("long").alias("rank"), "b.class", F.round(-F.col("b.m"), 6).alias("score"))


TOP5 = f"WITH {SQL_SCORES}, u AS (SELECT id, unnest(range(0, {CLASSES})) class, unnest(s) v FROM s) SELECT id, rank, class, round(v, 6) score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, class) rank FROM u) WHERE rank <= 5"


def to_onehot(spark, sf_dir):
    """Class labels as rows of zeros with a single one."""
    row = F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda i: F.when(i == F.col("label"), "1").otherwise("0"))
    return descriptors(spark, sf_dir).select("id", F.array_join(row, ",").alias("onehot"))


ONEHOT = f"SELECT vec_id id, array_to_string(list_transform(range(0, {CLASSES}), lambda i: CASE WHEN i = label THEN '1' ELSE '0' END), ',') onehot FROM embeddings"


def keep_voxels_above_threshold(spark, sf_dir):
    """Grids with each voxel set to one from the threshold on, else to zero; written as their bits."""
    bits = F.transform("vector", lambda v: F.when(F.least(F.lit(1.0), F.abs(v.cast("double")) * 4) >= 0.5, "1").otherwise("0"))
    return descriptors(spark, sf_dir).select("id", F.array_join(bits, "").alias("bits"))


ABOVE = "SELECT vec_id id, array_to_string(list_transform(embedding, lambda v: CASE WHEN least(1.0, abs(v::DOUBLE) * 4) >= 0.5 THEN '1' ELSE '0' END), '') bits FROM embeddings"


def voxel_grid_to_cloud(spark, sf_dir):
    """Places of the ones in those binary grids."""
    ones = keep_voxels_above_threshold(spark, sf_dir).select("id", F.posexplode(F.split("bits", "")).alias("i", "b")).filter("b = '1'")
    return ones.select("id", F.floor(F.col("i") / 16).alias("ix"), (F.floor(F.col("i") / 4) % 4).alias("iy"), (F.col("i") % 4).cast("long").alias("iz"))


def voxel_grid_to_cloud_by_probability(spark, sf_dir):
    """Voxels whose probability exceeds a threshold."""
    return _grid(spark, sf_dir).filter("p > 0.75").select("id", "ix", "iy", "iz", F.round("p", 6).alias("p"))


def normalize_voxel_matrix(spark, sf_dir):
    """Grids standardised voxel by voxel over the whole table; a voxel that never varies becomes zero."""
    grid = _grid(spark, sf_dir)
    scale = grid.groupBy("ix", "iy", "iz").agg(F.avg("p").alias("m"), F.stddev_pop("p").alias("d"))
    value = F.when(F.col("d") > 0, (F.col("p") - F.col("m")) / F.col("d")).otherwise(0.0)
    return grid.join(F.broadcast(scale), ["ix", "iy", "iz"]).select("id", "ix", "iy", "iz", (F.round(value, 4) + F.lit(0.0)).alias("v"))


NORMALIZE = f"WITH {SQL_GRID}, s AS (SELECT ix, iy, iz, avg(p) m, stddev_pop(p) d FROM g GROUP BY 1, 2, 3) SELECT id, ix, iy, iz, round(CASE WHEN d > 0 THEN (p - m) / d ELSE 0.0 END, 4) + 0.0 v FROM g JOIN s USING (ix, iy, iz)"


def reconstruct(spark, sf_dir):
    """Likely voxels as points of the segment: scaled back to its box, moved by its centroid, turned back by its alignment.

    A segment's box, centroid within the grid and alignment come from its id; the turn is a multiple of a quarter.
    """
    likely = _grid(spark, sf_dir).filter("p >= 0.75")
    at = {a: F.pmod("id", F.lit(m)) + size * (F.col(f"i{a}") - (SIDE - 1) / 2 + shift) / (SIDE - 1) for a, m, size, shift in (("x", 7, 3.2, 1.25), ("y", 5, 3.2, 1.5), ("z", 3, 1.6, 1.75))}
    quarter = F.pmod("id", F.lit(4))
    x = F.when(quarter == 0, at["x"]).when(quarter == 1, at["y"]).when(quarter == 2, -at["x"]).otherwise(-at["y"])
    y = F.when(quarter == 0, at["y"]).when(quarter == 1, -at["x"]).when(quarter == 2, -at["y"]).otherwise(at["x"])
    return likely.select("id", *[(F.round(c, 4) + F.lit(0.0)).alias(a) for a, c in (("x", x), ("y", y), ("z", at["z"]))])


RECONSTRUCT = f"""
WITH {SQL_GRID}, q AS (SELECT id, id % 4 k, id % 7 + CAST(3.2 AS DOUBLE) * (ix - 1.5::DOUBLE + 1.25::DOUBLE) / 3 x, id % 5 + CAST(3.2 AS DOUBLE) * (iy - 1.5::DOUBLE + 1.5::DOUBLE) / 3 y, id % 3 + CAST(1.6 AS DOUBLE) * (iz - 1.5::DOUBLE + 1.75::DOUBLE) / 3 z FROM g WHERE p >= 0.75)
SELECT id, round(CASE k WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN -x ELSE -y END, 4) + 0.0 x, round(CASE k WHEN 0 THEN y WHEN 1 THEN -x WHEN 2 THEN -y ELSE x END, 4) + 0.0 y, round(z, 4) + 0.0 z FROM q
"""


def _features(spark, sf_dir):
    """Per segment an array of named values."""
    sums = lineitem_points(spark, sf_dir).groupBy("segment").agg(F.count("*").cast("double").alias("n"), F.max("x").alias("top"), F.min("x").alias("low"), F.max("z").alias("high"))
    named = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("n", "top", "low", "high")])
    more = F.array(F.struct(F.lit("low").alias("name"), F.col("low") - 1), F.struct(F.lit("extent").alias("name"), F.col("top") - F.col("low")))
    return sums.select("segment", named.alias("features"), more.cast("array<struct<name:string,value:double>>").alias("more"))


def _listed(rows, features):
    flat = rows.select("segment", F.posexplode(features).alias("pos", "f"))
    return flat.select("segment", F.col("pos").cast("long").alias("pos"), "f.name", F.round("f.value", 6).alias("value"))


def features_append(spark, sf_dir):
    """One list of named features behind another; names may repeat."""
    return _listed(_features(spark, sf_dir), F.concat("features", "more"))


def features_clear_by_name(spark, sf_dir):
    """All features of one name taken out."""
    return _listed(_features(spark, sf_dir), F.filter("features", lambda f: f["name"] != "low"))


def features_replace_by_name(spark, sf_dir):
    """A feature put in place of the first of its name, or behind all others if there is none."""

    def put(features, new):
        first = F.array_position(F.transform(features, lambda f: f["name"]), new["name"])
        swapped = F.transform(features, lambda f, k: F.when(k + 1 == first, new).otherwise(f))
        return F.when(first > 0, swapped).otherwise(F.concat(features, F.array(new)))

    return _listed(_features(spark, sf_dir), put(put(F.col("features"), F.col("more")[0]), F.col("more")[1]))


SQL_FEATURES = f"{PTS_LI}, b AS (SELECT segment, CAST(count(*) AS DOUBLE) n, max(x) top, min(x) low, max(z) high FROM pts GROUP BY 1), f AS (SELECT segment, unnest([0, 1, 2, 3]) pos, unnest(['n', 'top', 'low', 'high']) AS name, unnest([n, top, low, high]) AS v, top, low FROM b), m AS (SELECT segment, unnest([4, 5]) pos, unnest(['low', 'extent']) AS name, unnest([low - 1, top - low]) AS v FROM b)"
APPEND = f"WITH {SQL_FEATURES} SELECT segment, CAST(pos AS BIGINT) pos, name, round(v, 6) AS value FROM f UNION ALL SELECT segment, CAST(pos AS BIGINT), name, round(v, 6) FROM m"
CLEAR = f"WITH {SQL_FEATURES} SELECT segment, CAST(CASE pos WHEN 3 THEN 2 ELSE pos END AS BIGINT) pos, name, round(v, 6) AS value FROM f WHERE name <> 'low'"
REPLACE = f"WITH {SQL_FEATURES} SELECT segment, CAST(pos AS BIGINT) pos, name, round(CASE name WHEN 'low' THEN v - 1 ELSE v END, 6) AS value FROM f UNION ALL SELECT segment, 4, name, round(v, 6) FROM m WHERE name = 'extent'"


def describe_all(spark, sf_dir):
    """Several descriptors of a segment applied one after the other into one list: moments of its points, then its box."""
    points = lineitem_points(spark, sf_dir)
    rows = points.groupBy("segment").agg(*[F.round(F.avg(a), 4).alias(f"mean_{a}") for a in AXES], *[F.round(F.max(a) - F.min(a), 4).alias(f"extent_{a}") for a in AXES])
    names = [f"{k}_{a}" for k in ("mean", "extent") for a in AXES]
    return _listed(rows.withColumn("features", F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in names])), F.col("features"))


DESCRIBE = f"WITH {PTS_LI}, b AS (SELECT segment, " + ", ".join(f"avg({a}) m{a}, max({a}) - min({a}) e{a}" for a in AXES) + " FROM pts GROUP BY 1) SELECT segment, CAST(unnest(range(0, 6)) AS BIGINT) pos, unnest(['mean_x', 'mean_y', 'mean_z', 'extent_x', 'extent_y', 'extent_z']) AS name, unnest([round(mx, 4), round(my, 4), round(mz, 4), round(ex, 4), round(ey, 4), round(ez, 4)]) AS value FROM b"


def _shuffled(spark, sf_dir):
    """Descriptors in a fixed shuffled order, numbered from 1."""
    order = descriptors(spark, sf_dir).select("id", "label", F.pmod(F.col("id") * 7919, F.lit(10007)).alias("h"))
    return numbered(order, ["h", "id"])


SQL_SHUFFLED = "o AS (SELECT vec_id id, label, row_number() OVER (ORDER BY vec_id * 7919 % 10007, vec_id) n FROM embeddings)"


def generator_batches(spark, sf_dir):
    """Mini-batches of 64 in a shuffled order that goes round: the last batch is filled up from the start."""
    rows = _shuffled(spark, sf_dir)
    total = rows.agg(F.count("*").alias("total"))
    n_batches = F.ceil(F.col("total") / BATCH)
    again = F.when(F.col("n") <= n_batches * BATCH - F.col("total"), F.array("n", F.col("n") + F.col("total"))).otherwise(F.array("n"))
    dealt = rows.crossJoin(F.broadcast(total)).select("id", "label", F.explode(again).alias("place"))
    by_batch = dealt.groupBy(F.floor((F.col("place") - 1) / BATCH).alias("batch"))
    return by_batch.agg(F.count("*").alias("n"), F.count_distinct("label").alias("n_classes"), F.sum(F.col("id") * (F.col("place") - BATCH * F.floor((F.col("place") - 1) / BATCH))).alias("checksum"))


BATCHES = f"WITH {SQL_SHUFFLED}, t AS (SELECT count(*) total FROM o), p AS (SELECT id, label, n place FROM o UNION ALL SELECT id, label, n + total FROM o, t WHERE n <= ceil(total / 64) * 64 - total) SELECT (place - 1) // 64 batch, count(*) n, count(DISTINCT label) n_classes, CAST(sum(id * (place - 64 * ((place - 1) // 64))) AS BIGINT) checksum FROM p GROUP BY 1"


def semantics_split(spark, sf_dir):
    """Seven tenths of the ids train, in a shuffled order; the rest test."""
    rows = _shuffled(spark, sf_dir)
    total = rows.agg(F.count("*").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("id", F.when(F.col("n") <= F.floor(F.col("total") * 0.7), "train").otherwise("test").alias("part"))


SEMANTICS = f"WITH {SQL_SHUFFLED} SELECT id, CASE WHEN n <= floor((SELECT count(*) FROM o) * 0.7::DOUBLE) THEN 'train' ELSE 'test' END part FROM o"


def semantics_model(spark, sf_dir):
    """Classes of the test part as a perceptron learned on the training part takes them: one row per class and what it is taken for."""
    parts = written(semantics_split(spark, sf_dir).join(descriptors(spark, sf_dir), "id"), "parts")
    model = classifier.trained(parts.filter("part = 'train'"), 10)
    return classifier.confusion(classifier.predicted(model, parts.filter("part = 'test'")))


def trim_data(spark, sf_dir):
    """One mask applied to all parallel values of a data set: descriptors of odd classes longer than one in their first values."""
    norm = F.aggregate(F.slice("vector", 1, 32), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return descriptors(spark, sf_dir).filter((F.col("label") % 2 == 1) & (norm > 0.5)).select("id", "label", F.round(norm, 6).alias("norm"))


TRIM = "SELECT id, label, round(norm, 6) norm FROM (SELECT vec_id id, label::BIGINT AS label, list_sum(list_transform(embedding[1:32], lambda v: v::DOUBLE * v::DOUBLE)) norm FROM embeddings) WHERE label % 2 = 1 AND norm > 0.5"


def multi_run_union(spark, sf_dir):
    """Two runs' data sets in one, classes and sequences of the second shifted behind those of the first."""
    first = event_points(spark, sf_dir).select(F.lit(0).cast("long").alias("run"), F.col("track").alias("class"), F.col("robot").alias("sequence"), F.lit(1).alias("one"))
    second = descriptors(spark, sf_dir).select(F.lit(1).cast("long").alias("run"), F.col("label").alias("class"), F.pmod("id", F.lit(50)).alias("sequence"), F.lit(1).alias("one"))
    offset = first.agg((F.max("class") + 1).alias("c"), (F.max("sequence") + 1).alias("s"))
    moved = second.crossJoin(F.broadcast(offset)).select("run", (F.col("class") + F.col("c")).alias("class"), (F.col("sequence") + F.col("s")).alias("sequence"), "one")
    return first.unionByName(moved).groupBy("run", "class", "sequence").agg(F.count("one").alias("n"))


RUNS = f"WITH {PTS_EV}, o AS (SELECT max(track) + 1 c, max(robot) + 1 s FROM pts), u AS (SELECT 0::BIGINT run, track AS class, robot AS sequence FROM pts UNION ALL SELECT 1, label + c, vec_id % 50 + s FROM embeddings, o) SELECT run, class, sequence, count(*) n FROM u GROUP BY 1, 2, 3"

PACK = {
    "semantic_argmax": (semantic_argmax, f"WITH {SQL_SCORES} SELECT id, CAST(list_position(s, list_max(s)) - 1 AS BIGINT) AS class, round(list_max(s), 6) score FROM s"),
    "top5_classes": (top5_classes, TOP5),
    "to_onehot": (to_onehot, ONEHOT),
    "keep_voxels_above_threshold": (keep_voxels_above_threshold, ABOVE),
    "voxel_grid_to_cloud": (voxel_grid_to_cloud, f"WITH {SQL_GRID} SELECT id, ix, iy, iz FROM g WHERE p >= 0.5"),
    "voxel_grid_to_cloud_by_probability": (voxel_grid_to_cloud_by_probability, f"WITH {SQL_GRID} SELECT id, ix, iy, iz, round(p, 6) p FROM g WHERE p > 0.75"),
    "normalize_voxel_matrix": (normalize_voxel_matrix, NORMALIZE),
    "reconstruct": (reconstruct, RECONSTRUCT),
    "features_append": (features_append, APPEND),
    "features_clear_by_name": (features_clear_by_name, CLEAR),
    "features_replace_by_name": (features_replace_by_name, REPLACE),
    "describe_all": (describe_all, DESCRIBE),
    "generator_batches": (generator_batches, BATCHES),
    "semantics_split": (semantics_split, SEMANTICS),
    "semantics_model": (semantics_model, None),
    "trim_data": (trim_data, TRIM),
    "multi_run_union": (multi_run_union, RUNS),
}
