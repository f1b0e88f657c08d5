"""Crowded places: sums over balls are right to the last point, and no pairs of rows are formed."""

import random

import numpy as np
import pandas as pd
import pytest

from terravox.operators import balls, segments
from terravox.operators import normals as N
from terravox.plans import segment_plans

XYZ = "x double, y double, z double"


@pytest.fixture
def no_pairs(monkeypatch):
    def refused(*args, **kwargs):
        raise AssertionError("pairs of rows")

    for module in (N, segment_plans):
        monkeypatch.setattr(module, "range_join", refused)
    monkeypatch.setattr(balls, "CROWD", 2)
    monkeypatch.setattr(balls, "FEW", 0)


def crowd(n, seed=3):
    """Places on a grid of tenths, where many are just as far apart as the radius, on three layers."""
    r = random.Random(seed)
    return [(r.randrange(-12, 13) / 10, r.randrange(20) / 10, float(r.randrange(3))) for _ in range(n)]


def within(a, b, radius):
    gap = [p - q for p, q in zip(a, b)]
    return 0.0 + gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2] <= radius * radius


def sums(at, given, radius):
    near = np.array([g for g in given if within(at, g, radius)]).reshape(-1, 3)
    return [len(near), *near.sum(axis=0), *[(near[:, i] * near[:, j]).sum() for i in range(3) for j in range(i, 3)]]


@pytest.mark.parametrize("radius", [0.5, 1.1])
def test_moments_of_a_crowd(spark, no_pairs, radius):
    places = crowd(900)
    rows = [(i, *p) for i, p in enumerate(places)] + [(900, None, 0.0, 0.0), (901, 50.0, -7.0, 1.0)]
    points = spark.createDataFrame(rows, "pid long, " + XYZ)
    got = {r["pid"]: [r[c] for c in ("n", *N.SUMS)] for r in N.neighbour_moments(points, radius).collect()}
    assert got.keys() == {*range(900), 901} and got[901] == [1, 50.0, -7.0, 1.0, 2500.0, -350.0, 50.0, 49.0, -7.0, 1.0]
    for pid in range(0, 900, 7):
        want = sums(places[pid], places, radius)
        assert got[pid][0] == want[0] and got[pid] == pytest.approx(want, abs=1e-9)


def test_update_of_a_crowd(spark, no_pairs):
    rows = [(i, *p, i % 2) for i, p in enumerate(crowd(1800))]
    points = spark.createDataFrame(rows, "pid long, " + XYZ + ", track long")
    old, new = points.filter("pid % 5 <> 0"), points.filter("pid % 5 = 0")
    empty = spark.createDataFrame([], "pid long, n long, " + ", ".join(f"{c} double" for c in N.SUMS))
    first = N.updated(empty, old.limit(0), old, 0.5, ["track"]).drop("affected")
    got = {r["pid"]: r for r in N.updated(first, old, new, 0.5, ["track"]).collect()}
    assert len(got) == 1800
    for pid in range(0, 1800, 11):
        mine = [r for r in rows if r[4] == pid % 2]
        assert [got[pid][c] for c in ("n", *N.SUMS)] == pytest.approx(sums(rows[pid][1:4], [r[1:4] for r in mine], 0.5), abs=1e-9)
        assert got[pid]["affected"] == any(r[0] % 5 == 0 and within(r[1:4], rows[pid][1:4], 0.5) for r in mine) or pid % 5 == 0


def test_runs_cover_the_points_within(monkeypatch):
    """Groups of points are taken or left whole: few distances are computed, and the sums are the same."""
    r = np.random.default_rng(4)
    at = np.round(r.uniform(0, 4, (6000, 2)), 2)
    values, seen, close = np.ones((6000, 1)), [], balls.close

    def counted(left, right, *rest):
        seen.append(len(left) * len(right))
        return close(left, right, *rest)

    monkeypatch.setattr(balls, "close", counted)
    got = balls.sums_within(at, at, values, 1.0)[:, 0]
    want = [(((a[0] - at[:, 0]) ** 2 + (a[1] - at[:, 1]) ** 2) <= 1.0).sum() for a in at[:500]]
    assert got[:500].tolist() == want and sum(seen) < len(at) ** 2 / 6


def events(spark, tmp_path, n):
    """Events whose places are a crowd, some of them twice."""
    rows = [(i, 10 * (i % 7) + (i // 2) % 2, "a", (i // 2) * 37 % 101 / 10, f"2024-01-01 0{(i // 2) % 2}:{(i // 2) * 7 % 60:02d}:{(i // 2) * 11 % 60:02d}") for i in range(n)]
    frame = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts string").selectExpr("event_id", "CAST(ts AS timestamp) AS ts", "user_id", "event_type", "value")
    frame.write.parquet(str(tmp_path / "events.parquet"))
    return [(r["pid"], r["x"], r["y"], r["z"]) for r in segment_plans.event_points(spark, str(tmp_path)).collect()]


def test_counts_and_curvature_of_crowded_events(spark, no_pairs, tmp_path):
    points = events(spark, tmp_path, 1200)
    n = {r["pid"]: r["n"] for r in segment_plans.radius_neighbors_count(spark, str(tmp_path)).collect()}
    curved = {r["pid"]: r for r in segment_plans.surface_normals(spark, str(tmp_path)).collect()}
    assert len(n) == len(curved) == 1200 and {r["curvature"] for r in curved.values()} == {0.0}
    for pid, *at in points[::13]:
        assert n[pid] == curved[pid]["n"] == sum(within(at, p[1:], 0.5) for p in points)


def test_smooth_segments_of_a_crowd(spark, monkeypatch):
    """Growth by blocks gives what growth by pairs gives, and pairs no rows."""
    r = random.Random(5)
    turns = [(0.0, 0.0, 1.0), (0.6, 0.0, 0.8), (0.28, 0.0, 0.96), (0.0, 0.6, -0.8), (0.0, 1.0, 0.0)]
    rows = [(i, *p, *turns[min(4, int(2 * abs(p[0]) + r.random()))], r.choice([0.01, 0.02, 0.1, 0.3])) for i, p in enumerate(crowd(1100))]
    points = spark.createDataFrame([*rows, (1100, None, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)], "pid long, " + XYZ + ", nx double, ny double, nz double, curvature double")
    want = {tuple(row) for row in segments.smooth(points, 0.21, 0.8, 0.2, 3).collect()}

    def refused(*args, **kwargs):
        raise AssertionError("pairs of rows")

    monkeypatch.setattr(balls, "CROWD", 2)
    monkeypatch.setattr(balls, "FEW", 0)
    monkeypatch.setattr(segments, "radius_pairs", refused)
    got = {tuple(row) for row in segments.smooth(points, 0.21, 0.8, 0.2, 3).collect()}
    assert got == want and len({s for _, s in want}) > 3


@pytest.mark.parametrize("twice", [False, True])
def test_close_pairs_of_crowded_segments(spark, monkeypatch, tmp_path, twice):
    """Pairs are counted, not formed; only the closest are looked for among rows."""
    counted, join = [], segment_plans.range_join

    def count(*args, **kwargs):
        found = join(*args, **kwargs)
        counted.append(found.count())
        return found

    monkeypatch.setattr(segment_plans, "range_join", count)
    r = random.Random(9)
    rows = [(s, 1, 1, r.randrange(2, 3000) / 1000, r.uniform(0, 3) * 1999.7, r.randrange(11) / 100) for s in range(2000)]
    rows += [(2000 + s, *row[1:]) for s, row in enumerate(rows[:50])] if twice else []
    spark.createDataFrame(rows, "l_partkey long, l_linenumber int, l_orderkey long, l_quantity double, l_extendedprice double, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    at = np.array([(x, y / 1999.7, z * 100) for *_, x, y, z in rows])
    d2 = [((a - at[i + 1 :]) ** 2).sum(axis=1) for i, a in enumerate(at)]
    n, least = sum(int((d <= 1).sum()) for d in d2), min(d.min() for d in d2 if len(d))
    monkeypatch.setattr(balls, "CROWD", 4)
    assert list(map(tuple, segment_plans.close_segment_pairs(spark, str(tmp_path)).collect())) == [(n, round(0.0 if twice else least**0.5, 4))]
    assert max(counted) < n / 4


def test_better_ones_of_crowded_segments(spark, monkeypatch, tmp_path):
    """Only places that can be near are compared, and those before a segment are counted to the last one."""
    r, tried, close = random.Random(12), [], balls.close

    def counted(left, right, *rest):
        tried.append(len(left) * len(right))
        return close(left, right, *rest)

    monkeypatch.setattr(balls, "close", counted)
    n = 2500
    at = np.array([(r.randrange(80) / 10, r.randrange(80) / 10, r.randrange(11) / 10) for _ in range(n)])
    born, size = np.array([r.randrange(40) for _ in range(n)]), np.array([r.randrange(1, 4) for _ in range(n)])
    given = pd.DataFrame({"segment": r.sample(range(9000), n), "n": size, "born": born}).assign(x=at[:, 0], y=at[:, 1], z=at[:, 2])
    asked = given.sample(frac=0.5, random_state=1)
    got = {row.segment: (row.n_better, row.first_better) for row in segment_plans._better(1.0)(asked, given).itertuples()}
    ids, want = given["segment"].to_numpy(), {}
    for row in asked.itertuples():
        d2 = (row.x - at[:, 0]) ** 2 + (row.y - at[:, 1]) ** 2 + (row.z - at[:, 2]) ** 2
        better = (d2 <= 1) & ((born < row.born) | ((born == row.born) & ((size > row.n) | ((size == row.n) & (ids < row.segment)))))
        if better.any():
            want[row.segment] = (better.sum(), ids[better].min())
    assert got == want and 0 < sum(tried) < len(asked) * n * 0.6
