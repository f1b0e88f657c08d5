"""The classifier over descriptors and the random plane on cases whose answer is known."""

import random

import pytest
from pyspark.sql import functions as F

from terravox.operators import classifier
from terravox.plans import preprocess_plans as P
from terravox.plans.preprocess_plans import LEAST_CUT, MOST_CUT, plane_cut


def test_classifier_tells_clusters_apart(spark):
    """Three clusters, scales that differ by far, and rows that cannot be used."""
    r = random.Random(1)
    rows = [(i, i % 3, [(i % 3 == k) * 3 * s + r.gauss(0, s / 2) for k, s in enumerate((1.0, 100.0, 0.01))]) for i in range(240)]
    df = spark.createDataFrame(rows + [(900, None, rows[0][2]), (901, 1, None)], "id long, label long, vector array<double>")
    model = classifier.trained(df.filter("id < 160 OR id >= 900"), 3, hidden=8)
    found = classifier.predicted(model, df.filter("id >= 160"))
    assert found.count() == 80
    table = {(x["label"], x["predicted"]): (x["n"], x["share"]) for x in classifier.confusion(found).collect()}
    assert sum(n for (a, b), (n, _) in table.items() if a == b) >= 76
    for label in range(3):
        assert sum(s for (a, _), (_, s) in table.items() if a == label) == pytest.approx(1, abs=1e-5)
    with pytest.raises(ValueError):
        classifier.trained(df.limit(0), 3)


def test_plane_takes_a_share_between_the_bounds(spark):
    r = random.Random(2)
    rows = [(s, r.uniform(0, 40), r.uniform(0, 40), r.uniform(0, 5), n) for s in range(30) for n in range(20 + s)] + [(99, 1.0, 1.0, 1.0, 0)]
    df = spark.createDataFrame(rows, "segment long, x double, y double, z double, n long")
    cut = plane_cut(df)
    assert set(cut.columns) == {"segment", "x", "y", "z", "n", "plane"}
    left = {c["segment"]: (c["k"], c["plane"]) for c in cut.groupBy("segment").agg(F.count("*").alias("k"), F.max("plane").alias("plane")).collect()}
    assert left[99] == (1, -1) and sum(plane >= 0 for _, plane in left.values()) > 25
    for s in range(30):
        gone = 1 - left[s][0] / (20 + s)
        assert LEAST_CUT < gone < MOST_CUT if left[s][1] >= 0 else gone == 0


def test_planes_are_tried_as_the_sql_says(spark):
    """Counts from batches agree with the rounded distance of every point, at points on a plane, without a coordinate and of negative ids as well."""
    points = spark.range(3000).selectExpr("id % 40 - 5 AS segment", "CASE WHEN id % 97 > 0 THEN id % 7 * 3.0D END AS x", "id % 11 * 2.5D AS y", "CASE WHEN id % 501 = 0 THEN CAST('NaN' AS DOUBLE) ELSE id % 13 * 1.0D END AS z")
    centred = points.selectExpr("segment", "x AS cx", "y AS cy", "z AS cz")
    # A point on the first plane of its segment, to the last digit that counts.
    on = "round(-(CAST((segment * 13) % 100 AS DOUBLE) / 49.5 - 1) * 25 / cos(CAST((segment * 31) % 180 AS DOUBLE) * 0.017453292519943295D), 6)"
    centred = centred.unionByName(centred.select("segment").distinct().selectExpr("segment", "0.0D AS cx", "0.0D AS cy", f"{on} AS cz")).coalesce(1).sortWithinPartitions("segment")
    schema = "segment long, n long, " + ", ".join(f"f{k} long" for k in range(P.CANDIDATES)) + ", cx double, cy double, cz double"
    tried = centred.mapInArrow(P._tried, schema)
    want = {r["segment"]: tuple(r)[1:] for r in centred.groupBy("segment").agg(F.count("*"), *[F.count_if(F.expr(P._keeps(k))) for k in range(P.CANDIDATES)]).collect()}
    close = tried.filter("cx IS NOT NULL").groupBy("segment").agg(*[F.count_if(F.expr(P._keeps(k))).alias(f"e{k}") for k in range(P.CANDIDATES)])
    sums = tried.groupBy("segment").agg(F.sum("n").alias("n"), *[F.sum(f"f{k}").alias(f"f{k}") for k in range(P.CANDIDATES)]).join(close, "segment", "left")
    got = {r["segment"]: (r["n"], *[r[f"f{k}"] + (r[f"e{k}"] or 0) for k in range(P.CANDIDATES)]) for r in sums.collect()}
    assert got == want and 0 < tried.filter("cx IS NOT NULL").count() < 200
