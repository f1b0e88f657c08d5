"""Nearest neighbours by pivots and in blocks against plain sorting."""

import random

import numpy as np
import pytest

from terravox.operators import pivots
from terravox.operators.neighbours import nearest
from terravox.operators.pivots import Cells, distances, nearest_join


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "id long, vector array<double>, cell string")


def brute(targets, queries, k):
    def d2(x, y):
        out = 0.0
        for a, b in zip(x, y):
            out += (a - b) * (a - b)
        return out

    return sorted((q, t, d, n + 1) for q, x in queries for n, (d, t) in enumerate(sorted((d2(x, y), t) for t, y in targets if t != q)[:k]))


def rows_of(found):
    return sorted((r["query"], r["target"], r["d2"], r["rank"]) for r in found.collect())


@pytest.mark.parametrize("dims", [1, 3, 17])
def test_join_equals_sorting(spark, dims):
    """Clusters, a third of all rows equal, ties at the k-th place, queries far from everything; cells split over tasks."""
    r = random.Random(dims)
    centres = [[r.uniform(-50, 50) for _ in range(dims)] for _ in range(6)]
    rows = [(i, [c + r.gauss(0, 1) for c in centres[i % 6]]) for i in range(240)]
    rows += [(1000 + i, list(rows[7][1])) for i in range(130)]
    rows += [(2000 + i, [float(r.randrange(3)) for _ in range(dims)]) for i in range(60)]
    asked = rows[::3] + [(5000, [1e3] * dims), (5001, [0.0] * dims)]
    joined = nearest_join(vectors(spark, rows), vectors(spark, asked), 5, pivots=15, cell_rows=32)
    assert rows_of(joined.neighbours) == brute(rows, asked, 5)
    work = {w["phase"]: w["pairs"] for w in joined.work.collect()}
    assert set(work) == {1, 2} and sum(work.values()) < 0.6 * len(rows) * len(asked)
    assert rows_of(nearest(vectors(spark, rows), vectors(spark, asked), 5)) == brute(rows, asked, 5)
    assert rows_of(nearest(vectors(spark, rows), vectors(spark, asked), 5, block=10)) == brute(rows, asked, 5)


def test_join_of_few(spark):
    """Fewer targets than asked for, one target, none, and rows without a vector."""
    few = [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [4.0, 1.0])]
    assert rows_of(nearest_join(vectors(spark, few + [(4, None)]), vectors(spark, few), 5).neighbours) == brute(few, few, 5)
    assert rows_of(nearest_join(vectors(spark, few[:1]), vectors(spark, few[:1]), 2).neighbours) == []
    assert nearest_join(vectors(spark, []), vectors(spark, few), 2).neighbours.count() == 0
    assert nearest_join(vectors(spark, few), vectors(spark, []), 2).neighbours.count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_bounds_are_below_all_distances(seed):
    """No target of a cell is nearer to a query than the cell's bound."""
    r = np.random.default_rng(seed)
    x, q = r.standard_normal((300, 4)), 2 * r.standard_normal((40, 4))
    pivots = x[:20]
    away = np.sqrt(np.maximum(distances(x, pivots), 0))
    home = away.argmin(axis=1)
    stats = [(c, (home == c).sum(), away[home == c, c].min(), away[home == c, c].max()) for c in np.unique(home).tolist()]
    cells = Cells(pivots, stats)
    d, _ = cells.home(q, 3)
    true = np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2))
    bounds = cells.bounds(d)
    assert all((true[:, home == c].min(axis=1) >= bounds[:, c]).all() for c in range(20))
    assert (bounds > 0).mean() > 0.3


def test_rows_meet_the_pivots_a_few_at_a_time(spark, monkeypatch, tmp_path):
    """What a worker holds of distances to pivots does not grow with Arrow's batches, nor do sums of rows that are equally far."""
    seen, plain = tmp_path / "seen", pivots.distances

    def counted(x, y):
        with seen.open("a") as f:
            f.write(f"{len(x)} ")
        return plain(x, y)

    monkeypatch.setattr(pivots, "distances", counted)
    rows = [(i, [float(i % 40), 1.0]) for i in range(1500)]
    joined = nearest_join(vectors(spark, rows).coalesce(1), vectors(spark, rows).coalesce(1), 3, pivots=20)
    assert rows_of(joined.neighbours) == brute(rows, rows, 3)
    assert max(map(int, seen.read_text().split())) <= pivots.QUERY_ROWS
    summed, exact = [], pivots.exact
    monkeypatch.setattr(pivots, "exact", lambda x, y: summed.append(len(x)) or exact(x, y))
    best = pivots.Best(np.arange(256), np.zeros((256, 2)), 3)
    best.offer(np.arange(300, 1324), np.zeros((1024, 2)))
    assert best.t.tolist() == [[300, 301, 302]] * 256 and max(summed) <= 8192


def test_a_query_goes_to_each_block_once(spark, monkeypatch):
    """Where the bounds rule out no cell, rows that are shuffled do not grow with the cells."""
    sent, written = [], pivots.written

    def counted(df, what):
        out = written(df, what)
        if what == "asked":
            lists = next(f.name for f in out.schema if f.dataType.simpleString() == "array<int>")
            sent.append(out.selectExpr(f"sum(size({lists}))").first()[0])
        return out

    monkeypatch.setattr(pivots, "written", counted)
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(24)]) for i in range(400)]
    joined = nearest_join(vectors(spark, rows), vectors(spark, rows), 3, pivots=100, cell_rows=16)
    assert rows_of(joined.neighbours) == brute(rows, rows, 3)
    assert len(sent) == 2 and sum(sent) <= 2 * 16 * len(rows)
    assert sum(w["asked"] for w in joined.work.collect()) > 2 * sum(sent)
