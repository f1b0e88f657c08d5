"""Golden cases of voxels, segmentation and graphs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravox.functions.geometry import voxel_index, voxel_key
from terravox.operators import graph, segments
from terravox.operators import voxels as V
from terravox.operators.folds import accepted
from terravox.operators.neighbours import nearest, radius_pairs

XYZ = "x double, y double, z double"


def cluster_map(rows):
    return dict(sorted((r["pid"], r["cluster_id"]) for r in rows))


def test_voxel_keys(spark):
    df = spark.createDataFrame([(-3.5, -3.5, -1.5), (2.2, -1.5, 1.8), (3.0, 0.0, -2.0)], XYZ)
    keys = df.select(voxel_key(voxel_index(F.col("x"), 1.0, -4.0), F.shiftleft(voxel_index(F.col("y"), 1.0, -4.0), 3), F.shiftleft(voxel_index(F.col("z"), 1.0, -2.0), 6), bits=0).alias("k"))
    assert [r["k"] for r in keys.collect()] == [0x00, 0xD6, 0x27]


def test_voxels_become_active(spark):
    first = spark.createDataFrame([(0.2, 1.5, 0.1), (0.8, 0.7, 0.9), (0.5, 0.6, 0.3), (1.3, 0.1, 1.6)], XYZ)
    second = spark.createDataFrame([(0.4, 0.7, 0.2), (1.3, 0.3, 1.6), (1.3, 0.1, -1.2)], XYZ)
    start = V.voxels(first, 1.0)
    assert start.filter("n >= 2").select(*V.centroids(start)).collect() == [(0.65, 0.65, 0.6)]
    state = V.merged(start, V.voxels(second, 1.0), 2)
    assert (state.filter("n >= 2").count(), state.filter("n < 2").count(), state.filter("became_active").count()) == (2, 2, 1)


CASES = {
    "single": ([(0, 0, 0, 0), (-1.99, 0, 0, 0), (1, 0.4, -0.7, 0), (0.3, 0.7, 0.2, 0), (0.6, -0.2, 0.4, 0)], [], 1, [1] * 5, [1], [5], []),
    "multiple": ([(0, 0, 0, 0), (10.4, 9.4, 9.2, 0), (0.4, 0.4, -0.2, 0), (-50.4, 0.4, 0.2, 0), (-0.3, -0.8, 0.3, 0), (10.2, 10.3, 9.3, 0)], [], 1, [1, 2, 1, 3, 1, 2], [1, 2, -1], [3, 2, 1], []),
    "incremental": ([(-5, 2, -4.2, 6), (-73, 3, 0.2, 2), (1.4, 16.3, -4.2, 0), (1.8, -2.3, 34.8, 0), (-4.8, 2.5, -3.6, 6), (-5.4, 4.2, -4.4, 0), (-5.4, 2.3, -4.4, 6), (2, 15, -3.4, 3)], [(6, 1)], 2, [1, 2, 3, 4, 1, 1, 1, 3], [1, -1, 2, -1], [4, 1, 2, 1], []),
    "join": ([(0, 0, 0, 1), (1.8, -2.3, 34.8, 2), (1.5, 0.2, -0.1, 0), (3.2, 0.5, -0.8, 3), (-0.4, -0.3, -1.2, 1), (3, 0, 0, 3)], [(1, 1), (2, -1), (3, 2)], 3, [1, 2, 1, 1, 1, 1], [1, -1], [5, 1], [(2, 1)]),
}


@pytest.mark.parametrize("name", CASES)
def test_incremental_segments(spark, name):
    points, prior, next_id, clusters, ids, sizes, renames = CASES[name]
    df = spark.createDataFrame([(i, float(x), float(y), float(z), c) for i, (x, y, z, c) in enumerate(points)], "pid long, " + XYZ + ", cluster_id long")
    known = spark.createDataFrame(prior, "cluster_id long, segment_id long")
    a, b, c = segments.incremental(df, known, 2.0, 2, 1000, next_id)
    assert list(cluster_map(a.collect()).values()) == clusters
    rows = b.orderBy("cluster_id").collect()
    assert [r["segment_id"] for r in rows] == ids
    assert [r["n"] for r in rows] == sizes
    assert [tuple(r) for r in c.collect()] == renames


def test_oversize_cluster_is_invalid(spark):
    df = spark.createDataFrame([(i, i * 0.5, 0.0, 0.0, 0) for i in range(6)], "pid long, " + XYZ + ", cluster_id long")
    _, b, _ = segments.incremental(df, spark.createDataFrame([], "cluster_id long, segment_id long"), 1.0, 2, 5, 1)
    assert b.first()["segment_id"] == segments.INVALID


GRAPHS = [
    ("0-2 1-2 1-3 2-3", 3, [1, 2, 3]),
    ("0-5 0-7 1-3 1-5 2-3 2-4 2-6 2-7 3-4 3-6 4-6", 3, [2, 3, 4, 6]),
    ("0-2 1-2 1-3 2-3", 4, []),
]


@pytest.mark.parametrize(("text", "least", "clique"), GRAPHS)
def test_cliques(spark, text, least, clique):
    pairs = [tuple(map(int, e.split("-"))) for e in text.split()]
    assert graph.largest_clique(pairs, least) == clique
    got = graph.cliques(spark.createDataFrame(pairs, "src long, dst long"), least)
    assert sorted(r["member"] for r in got.collect()) == clique


def test_cliques_of_components_write_no_lists(spark, monkeypatch):
    rng = np.random.default_rng(3)
    # A dense part, whose lists of later neighbours would be many times its edges, and a sparse one.
    pairs = [(a, b) for a in range(60) for b in range(a) if rng.random() < 0.6] + [(1000 + int(a), 1000 + int(b)) for a, b in rng.integers(0, 40, (90, 2))]
    cells, write = [], graph.written

    def counted(df, what, **options):
        out = write(df, what, **options)
        lists = [c for c, kind in out.dtypes if kind.startswith("array") and what != "found"]
        cells.append(sum(out.selectExpr(f"coalesce(sum(size({c})), 0)").first()[0] for c in lists))
        return out

    monkeypatch.setattr(graph, "written", counted)
    edges = spark.createDataFrame(pairs, "src long, dst long").repartition(3)
    got = sorted(map(tuple, graph.cliques(edges).collect()))
    assert sum(cells) == 0
    monkeypatch.undo()
    assert got == sorted(map(tuple, graph.cliques(edges, part=100).collect())) == sorted(map(tuple, graph.cliques(edges, at_once=100).collect()))
    for low in (0, 1000):
        assert [m for c, m in got if c == low] == graph.largest_clique([p for p in pairs if (p[0] >= 1000) == (low == 1000)], 3)


@pytest.mark.parametrize("at_once", [1, 40, 500_000])
def test_components_by_rounds_and_by_contraction(spark, at_once):
    rng = np.random.default_rng(at_once)
    # Sparse random parts, a long path in shuffled order, a star around a large id, loops, repeats and nulls.
    pairs = [(int(a), int(b)) for a, b in rng.integers(-300, 300, (250, 2))]
    path = rng.permutation(np.arange(1000, 1150))
    pairs += [(int(a), int(b)) for a, b in zip(path, path[1:])]
    pairs += [(9000, 5000 + i) for i in range(60)] * 2 + [(7, 7), (20_000, 20_000)]
    top = {n: n for p in pairs for n in p}

    def root(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        top[b] = a
    want = {n: root(n) for a, b in pairs if a != b for n in (a, b)}
    edges = spark.createDataFrame([*pairs, (None, 5), (5, None)], "src int, dst int").repartition(5)
    found = graph.components(edges, at_once=at_once)
    assert found.schema.simpleString() == "struct<node:int,component:int>"
    rows = found.collect()
    assert len(rows) == len(want) and {r["node"]: r["component"] for r in rows} == want


def test_components_of_a_path(spark):
    edges = spark.range(200).selectExpr("id AS src", "id + 1 AS dst").union(spark.createDataFrame([(1000, 1001)], "src long, dst long"))
    got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}


@pytest.mark.parametrize("ends", ["id AS src, id + 1 AS dst", "id AS src, id DIV 7 AS dst", "id * 3 % 601 AS src, id % 50 AS dst"])
def test_component_rounds_shrink(spark, monkeypatch, ends):
    edges, counts, write = spark.range(600).selectExpr(*ends.split(", ")), [], graph.written

    def counted(df, what, **options):
        out = write(df, what, **options)
        counts.extend([out.count()] if what == "edges" else [])
        return out

    monkeypatch.setattr(graph, "written", counted)
    rows = [(r["node"], r["component"]) for r in graph.components(edges.repartition(200), at_once=20).collect()]
    want = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert len(rows) == len(want) and dict(rows) == want
    # Rounds shrink, so that all together write a few times the edges.
    assert len(counts) > 2 and sum(counts[:-1]) <= 5 * edges.count()


def test_radius_pairs_include_the_border(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 2.5, 0.0, 0.0)], "pid long, " + XYZ)
    assert [(r["src"], r["dst"]) for r in radius_pairs(df, 1.0).collect()] == [(1, 2)]


def test_fold_compares_with_the_last_accepted(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([0, 6, 12, 13, 30])], "k long, o long, v double")
    assert sorted(r["v"] for r in accepted(df, "k", ["o"], "v", lambda v, last: v - last > 10).collect()) == [0, 12, 30]


def test_nearest_without_itself(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(6)], "id long, vector array<double>")
    got = nearest(df, df.filter("id = 2"), 2).orderBy("rank").collect()
    assert [(r["target"], r["d2"]) for r in got] == [(1, 1.0), (3, 1.0)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "pid long, " + XYZ)
    assert V.voxels(none, 1.0).count() == 0
    assert segments.euclidean(none, 1.0, 1, 9).count() == 0
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0
