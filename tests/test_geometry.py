"""Normals, hulls, rigid fits, consistency caches and growth against golden cases and brute force."""

import random
from itertools import combinations

import numpy as np
import pytest

from terravox.operators import consistency, graph, hulls, segments
from terravox.operators import normals as N
from terravox.operators.folds import numbered
from terravox.operators.neighbours import first_of_class
from terravox.operators.rigid import fitted

XYZ = "pid long, x double, y double, z double"


def cloud(spark, points):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in points], XYZ)


def vectors(state):
    return {r["pid"]: tuple(round(r[c], 4) + 0.0 for c in ("nx", "ny", "nz")) for r in N.normals(state).collect()}


def test_normals_follow_new_points(spark):
    first = [(0, 0, 0), (0.25, 0, 0), (0, 0.1, 0), (-0.25, 0, 0), (0, -0.1, 0), (1, 1, 0)]
    state = N.neighbour_moments(cloud(spark, enumerate(first)), 0.5)
    seen = vectors(state)
    assert 5 not in seen and seen[0] == (0, 0, 1)
    then = [(0, 0, 0), (0.25, 0, 0), (0, 0.1, 0), (1, 1, 0), (0, 0, 0.4), (0, 0, -0.4), (1.2, 1, 0), (1, 1.2, 0)]
    mapping = spark.createDataFrame(list(enumerate([0, 1, 2, -1, -1, 3])), "old_pid long, new_pid long")
    kept = N.remapped(state, mapping)
    points = list(enumerate(then))
    after = N.updated(kept, cloud(spark, points[:4]), cloud(spark, points[4:]), 0.5)
    assert vectors(after)[0] == (0, 1, 0)
    assert {r["pid"]: r["affected"] for r in after.collect()} == {0: True, 1: True, 2: True, 3: True, 4: True, 5: True, 6: True, 7: True}


def test_moments_of_moved_points(spark):
    r = np.random.default_rng(0)
    points = r.normal(size=(40, 3))
    turn, shift = ((0.8, -0.6, 0.0), (0.6, 0.8, 0.0), (0.0, 0.0, 1.0)), (5.0, -2.0, 0.5)
    moved = points @ np.array(turn).T + shift
    got = {x["pid"]: x for x in N.transformed(N.neighbour_moments(cloud(spark, enumerate(points)), 1.0), turn, shift).collect()}
    for x in N.neighbour_moments(cloud(spark, enumerate(moved)), 1.0).collect():
        assert all(got[x["pid"]][c] == pytest.approx(x[c], abs=1e-9) for c in ("n", *N.SUMS))


@pytest.mark.parametrize("seed", range(6))
def test_hulls_equal_brute_force(seed):
    r = np.random.default_rng(seed)
    points = r.integers(0, 4, size=(14, 3)).astype(float) if seed % 2 else r.normal(size=(14, 3))
    hull = hulls.convex_hull(points)
    planes = []
    for i, j, k in combinations(range(len(points)), 3):
        n = np.cross(points[j] - points[i], points[k] - points[i])
        side = (points - points[i]) @ n
        if np.abs(n).sum() > 1e-12 and ((side <= 1e-9).all() or (side >= -1e-9).all()):
            planes.append((n, points[i]) if (side <= 1e-9).all() else (-n, points[i]))
    tried = np.concatenate([r.uniform(-2, 5, size=(300, 3)), points])
    want = np.array([all(n @ (p - o) <= 1e-9 for n, o in planes) for p in tried])
    assert (hull.holds(tried) == want).all()
    inside = np.array([all(n @ (p - o) <= 1e-9 for n, o in planes) for p in r.uniform(points.min(0), points.max(0), size=(4000, 3))]).mean()
    assert hull.volume == pytest.approx(inside * np.prod(np.ptp(points, axis=0)), rel=0.25, abs=0.3)


def test_hulls_of_a_cube_and_of_nothing():
    cube = np.array([(x, y, z) for x in (0, 2) for y in (0, 2) for z in (0, 2)], float)
    assert hulls.convex_hull(cube).volume == pytest.approx(8)
    assert hulls.convex_hull(cube[:4]) is None and hulls.convex_hull(np.zeros((9, 3))) is None
    full = np.concatenate([cube, np.full((4, 3), 1.0) + np.eye(4, 3) * 0.1])
    assert hulls.overlap(full, full + [1, 0, 0], hulls.convex_hull(full), hulls.convex_hull(full + [1, 0, 0]))[2:] == pytest.approx((0.5, 0.5), abs=0.2)


def test_rigid_fit_finds_the_motion():
    r = np.random.default_rng(1)
    for _ in range(20):
        q = r.normal(size=4)
        q /= np.linalg.norm(q)
        w, x, y, z = q
        turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
        scene = r.normal(size=(6, 3))
        found = fitted(scene, scene @ turn.T + [1, 2, 3])
        assert np.allclose(np.abs(np.dot(found[:4], q)), 1) and found[7] < 1e-6
        noisy = scene @ turn.T + [1, 2, 3] + 0.1 * r.normal(size=(6, 3))
        a, b = scene - scene.mean(0), noisy - noisy.mean(0)
        u, _, v = np.linalg.svd(b.T @ a)
        best = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ v))]) @ v
        assert fitted(scene, noisy)[7] == pytest.approx(np.sqrt(((a @ best.T - b) ** 2).sum(1).mean()), abs=1e-9)


def test_cached_pairs_equal_all_pairs(spark):
    r = random.Random(2)
    kind = "key long, pid long, sx double, sy double, mx double, my double"
    at = {p: [r.uniform(0, 6) for _ in range(4)] for p in range(60)}
    none = spark.createDataFrame([], "key long, src long, dst long")
    held, pairs, shown = spark.createDataFrame([], kind), none, set()
    for step in range(4):
        shown |= set(range(step * 15, step * 15 + 15))
        gone = set(r.sample(sorted(shown), 4))
        for p in shown:
            at[p] = [c + r.uniform(-0.4, 0.4) * (5 if r.random() < 0.1 else 1) for c in at[p]]
        now = [(0, p, *at[p]) for p in sorted(shown - gone)]
        found, held, pairs = consistency.cached_step(spark.createDataFrame(now, kind), held, pairs, 0.4, 2.0, 3.0)
        want = set()
        for (_, a, *u), (_, b, *v) in combinations(now, 2):
            scene, model = np.hypot(u[0] - v[0], u[1] - v[1]), np.hypot(u[2] - v[2], u[3] - v[3])
            if model <= 2.0 and abs(scene - model) <= 0.4:
                want.add((a, b))
        assert {(x["src"], x["dst"]) for x in found.collect()} == want
        held, pairs = spark.createDataFrame(held.collect(), kind), spark.createDataFrame(pairs.collect(), none.schema)




def test_smooth_growth_equals_brute_force(spark):
    r = random.Random(5)
    points = [(p, r.uniform(0, 5), r.uniform(0, 5), 0.0) for p in range(120)]
    told = {p: (0.0, float(np.sin(t)), float(np.cos(t)), r.uniform(0, 0.1)) for p, t in ((p, r.choice([0, 0.1, 1.2])) for p in range(120))}
    df = spark.createDataFrame([(*p, *told[p[0]]) for p in points], XYZ + ", nx double, ny double, nz double, curvature double")
    got = {x["pid"]: x["segment"] for x in segments.smooth(df, 0.7, 0.9, 0.05, 3).collect()}
    near = {p: [q for q, *b in points if q != p and np.hypot(a[0] - b[0], a[1] - b[1]) <= 0.7 and abs(np.dot(told[p][:3], told[q][:3])) >= 0.9] for p, *a in points}
    segment = {}
    for seed in sorted((p for p in near if told[p][3] <= 0.05), key=lambda p: (told[p][3], p)):
        if seed in segment:
            continue
        segment[seed], queue = seed, [seed]
        while queue:
            for q in sorted(near[queue.pop(0)]):
                if q not in segment:
                    segment[q] = seed
                    if told[q][3] <= 0.05:
                        queue.append(q)
    sizes = {s: list(segment.values()).count(s) for s in set(segment.values())}
    assert got == {p: s for p, s in segment.items() if sizes[s] >= 3}


def test_greedy_groups_equal_brute_force(spark):
    """The query's groups from the edges of the whole table, grown in plain loops."""
    from terravox.plans import match_plans

    sf = "/root/testdata/sf0.01"
    edges = [(e["robot"], e["src"], e["dst"]) for e in match_plans._edges(spark, sf, capped=True).collect()]
    near: dict = {}
    for robot, a, b in edges:
        near.setdefault((robot, a), set()).add(b)
        near.setdefault((robot, b), set()).add(a)
    used, want = set(), set()
    for robot, seed in sorted(near, key=lambda n: (-len(near[n]), n[1])):
        if (robot, seed) in used:
            continue
        members = [seed]
        for n in sorted(near[robot, seed]):
            if (robot, n) not in used and all(n in near[robot, m] for m in members):
                members.append(n)
        if len(members) >= 3:
            used |= {(robot, m) for m in members}
            want |= {(robot, seed, m) for m in members}
    assert want and {tuple(x) for x in match_plans.greedy_grouping(spark, sf).select("robot", "grp", "member").collect()} == want
    best: dict = {}
    for c, n in ((x["component"], x["n"]) for x in graph.cliques(spark.createDataFrame([e[1:] for e in edges], "src long, dst long"), 3).groupBy("component").count().withColumnRenamed("count", "n").collect()):
        best[c] = n
    front = match_plans.front_cluster(spark, sf).collect()
    top = max(best.values())
    assert len(front) == top


def test_numbers_over_many_ranges(spark):
    """Whatever the columns are called: those that the running sum would use itself, and one that it replaces."""
    rows = spark.range(1000).selectExpr("id", "id * 7919 % 1009 AS h", "'x' AS part", "'y' AS own_n", "'z' AS BEFORE_N", "-1 AS n").repartition(7)
    assert numbered(rows, ["h", "id"]).columns == ["id", "h", "part", "own_n", "BEFORE_N", "n"]
    got = sorted((x["h"], x["n"]) for x in numbered(rows, ["h", "id"]).collect())
    assert [n for _, n in got] == list(range(1, 1001))


def test_first_of_class_looks_at_all(spark):
    r = np.random.default_rng(3)
    x, label = r.normal(size=(150, 4)), r.integers(0, 40, 150)
    df = spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(label, x))], "id long, label long, vector array<double>")
    got = {y["query"]: y["rank"] for y in first_of_class(df, df.filter("id < 30"), block=8).collect()}
    want = {}
    for q in range(30):
        order = sorted((((x[q] - x[t]) ** 2).sum(), t) for t in range(150) if t != q)
        if ranks := [k for k, (_, t) in enumerate(order, 1) if label[t] == label[q]]:
            want[q] = ranks[0]
    assert got == want
