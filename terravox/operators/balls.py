"""Sums over balls of points, by blocks: no pairs of rows, and few in numpy where whole groups lie within or beyond the radius."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravox.functions.geometry import voxel_index
from terravox.operators.graph import stars
from terravox.ship import ship

#: Squared distances this near to the squared radius are computed again, as SQL sums them.
SLACK = 1e-9
#: A mean point shares its cell of the radius's size with more points than this, where balls are summed by blocks.
CROWD = 16
#: So few pairs in all are rows, however they lie.
FEW = 5000


class Halves:
    """Points in an order in which equal runs are compact: halves across the longest side, down to runs of ``leaf`` points at most.

    order: (runs, points of a run), -1 where a run is filled up; levels: the lowest and highest corners of 1, 2, 4 .. runs of runs.
    """

    def __init__(self, at: np.ndarray, leaf: int):
        depth = max(0, int(np.ceil(np.log2(len(at) / leaf))))
        size = -(-len(at) // 2**depth)
        padded = np.append(at, at[:1], axis=0)
        order = np.append(np.arange(len(at)), np.full(2**depth * size - len(at), -1)).reshape(1, -1)
        self.levels = []
        for level in range(depth + 1):
            here = padded[order]
            self.levels.append((here.min(axis=1), here.max(axis=1)))
            if level < depth:
                longest = (self.levels[-1][1] - self.levels[-1][0]).argmax(axis=1)
                along = np.take_along_axis(here, longest[:, None, None], 2)[:, :, 0]
                half = order.shape[1] // 2
                order = np.take_along_axis(order, np.argpartition(along, half, axis=1), 1).reshape(-1, half)
        self.order = order

    def summed(self, values: np.ndarray) -> list[np.ndarray]:
        """The sums over each level's nodes of the values of points in ``order``."""
        sums = [values.sum(axis=1)]
        while len(sums[0]) > 1:
            sums.insert(0, sums[0].reshape(-1, 2, sums[0].shape[1]).sum(axis=1))
        return sums


def met(asked: Halves, given: Halves, radius: float, at_once: int = 256) -> Iterator[tuple[range, list[tuple[np.ndarray, np.ndarray]], tuple[np.ndarray, np.ndarray]]]:
    """For some of the asked runs at a time: per level the (run, node) wholly within the radius of each other, and the (run, run) left to compare."""
    low, high = asked.levels[-1]
    for start in range(0, len(low), at_once):
        runs = range(start, min(start + at_once, len(low)))
        q, g, within = np.arange(runs.start, runs.stop), np.zeros(len(runs), np.int64), []
        for level, (least, most) in enumerate(given.levels):
            if level:
                q, g = np.repeat(q, 2), np.stack([2 * g, 2 * g + 1], axis=1).reshape(-1)
            far = near = 0.0
            for i in range(low.shape[1]):
                ql, qh, gl, gh = low[q, i], high[q, i], least[g, i], most[g, i]
                apart, across = np.maximum(np.maximum(gl - qh, ql - gh), 0), np.maximum(gh - ql, qh - gl)
                near, far = near + apart * apart, far + across * across
            whole = far <= radius * radius - SLACK
            within.append((q[whole], g[whole]))
            part = ~whole & (near <= radius * radius + SLACK)
            q, g = q[part], g[part]
        yield runs, within, (q, g)


def lifted(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose products are the squared distances of points from points, up to rounding."""
    size, one = (at * at).sum(axis=1, keepdims=True), np.ones((len(at), 1))
    return np.hstack([-2 * at, one, size]), np.hstack([at, size, one])


def close(left: np.ndarray, right: np.ndarray, radius: float, at: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Which points are within the radius of which, by the distances as SQL sums them; left and right: ``lifted`` rows, at(i, j): the places of some of each."""
    d2 = left @ right.T
    sure, near = d2 <= radius * radius - SLACK, d2 <= radius * radius + SLACK
    if np.count_nonzero(sure) != np.count_nonzero(near):
        i, j = np.nonzero(sure ^ near)
        a, b = at(i, j)
        exact = np.zeros(len(i))
        for axis in range(a.shape[1]):
            gap = a[:, axis] - b[:, axis]
            exact += gap * gap
        sure[i, j] = exact <= radius * radius
    return sure


def layers(at: np.ndarray) -> list[np.ndarray]:
    """The points as parts of equal values on each axis that has few values: halves across such an axis would not be compact."""
    parts = [np.arange(len(at))]
    for axis in range(at.shape[1]):
        values, of = np.unique(at[:, axis], return_inverse=True)
        if len(values) <= 16 and 64 * len(values) * len(parts) <= len(at):
            parts = [p[of[p] == v] for p in parts for v in range(len(values))]
    return [p for p in parts if len(p)]


def sums_within(asked: np.ndarray, given: np.ndarray, values: np.ndarray, radius: float) -> np.ndarray:
    """For each asked point the sums of the values of all given ones within the radius."""
    out = np.zeros((len(asked), values.shape[1]))
    if not len(asked) or not len(given):
        return out
    middle = asked.mean(axis=0)
    left, right = lifted(asked - middle)[0], lifted(given - middle)[1]
    many = []
    for part in layers(given):
        tree = Halves(given[part], 16)
        # Runs are filled up by points that weigh nothing.
        filled = np.append(values[part], np.zeros_like(values[:1]), axis=0)[tree.order]
        many.append((tree, tree.summed(filled), part[tree.order], right[part][tree.order], filled))
    for mine in layers(asked):
        few = Halves(asked[mine], 32)
        for tree, sums, ids, lift, weigh in many:
            for runs, within, (q, g) in met(few, tree, radius):
                totals = np.zeros((len(runs), values.shape[1]))
                for level, (of, node) in enumerate(within):
                    if len(of):
                        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                        totals[of[starts] - runs.start] += np.add.reduceat(sums[level][node], starts, axis=0)
                ends = np.searchsorted(q, np.arange(runs.start, runs.stop + 1))
                for run, total, lo, hi in zip(runs, totals, ends, ends[1:]):
                    own = few.order[run]
                    own = mine[own[own >= 0]]
                    if hi > lo:
                        some = g[lo:hi]
                        within_reach = close(left[own], lift[some].reshape(-1, lift.shape[2]), radius, lambda i, j: (asked[own[i]], given[ids[some].reshape(-1)[j]]))  # noqa: B023
                        total = total + within_reach.astype("f8") @ weigh[some].reshape(-1, weigh.shape[2])
                    out[own] += total
    return out


def around_runs(asked: np.ndarray, given: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, Callable[[np.ndarray, np.ndarray], np.ndarray]]]:
    """(a, b, near): some asked points at a time with all given ones of a layer that can be near; near(a, b): which of a lie within the radius of which of b."""
    if not len(asked) or not len(given):
        return
    middle = asked.mean(axis=0)
    left, right = lifted(asked - middle)[0], lifted(given - middle)[1]
    many = [(part, Halves(given[part], 16)) for part in layers(given)]
    near = lambda a, b: close(left[a], right[b], radius, lambda i, j: (asked[a[i]], given[b[j]]))
    for mine in layers(asked):
        few = Halves(asked[mine], 32)
        for part, tree in many:
            deep = len(tree.levels) - 1
            for runs, within, (q, g) in met(few, tree, radius):
                # Nodes wholly within are runs like the others here.
                of, run = [q], [g]
                for level, (a, node) in enumerate(within):
                    wide = 1 << (deep - level)
                    of.append(np.repeat(a, wide))
                    run.append((node[:, None] * wide + np.arange(wide)).reshape(-1))
                of, run = np.concatenate(of), np.concatenate(run)
                order = np.argsort(of, kind="stable")
                of, run = of[order], run[order]
                ends = np.searchsorted(of, np.arange(runs.start, runs.stop + 1))
                for i, lo, hi in zip(runs, ends, ends[1:]):
                    if hi > lo:
                        own, others = few.order[i], tree.order[run[lo:hi]].reshape(-1)
                        own, others = mine[own[own >= 0]], part[others[others >= 0]]
                        if len(own) and len(others):
                            yield own, others, near


def agree(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which directions a have a product of at least that with which b, whatever the sign, as SQL computes it."""
    size = np.abs(a @ b.T)
    sure, near = size >= least + SLACK, size >= least - SLACK
    if np.count_nonzero(sure) != np.count_nonzero(near):
        i, j = np.nonzero(sure ^ near)
        sure[i, j] = np.abs(a[i, 0] * b[j, 0] + a[i, 1] * b[j, 1] + a[i, 2] * b[j, 2]) >= least
    return sure


def linked(asked: np.ndarray, given: np.ndarray, radius: float, directions: np.ndarray, least: float) -> np.ndarray:
    """For each given point, the first of those it hangs together with by links of the asked points (indices into given), as far as they tell.

    Points that are known to hang together are not compared again, so the links that are looked at stay few.
    """
    root = np.arange(len(given))

    def roots(of: np.ndarray) -> np.ndarray:
        out = root[of]
        while (root[out] != out).any():
            out = root[out]
        return out

    for a, b, near in around_runs(given[asked], given, radius):
        mine, theirs = roots(asked[a]), roots(b)
        if (mine == mine[0]).all():
            b, theirs = b[theirs != mine[0]], theirs[theirs != mine[0]]
        if not len(b):
            continue
        i, j = np.nonzero(near(a, b) & agree(directions[asked[a]], directions[b], least))
        u, v = mine[i], theirs[j]
        if (u != v).any():
            moved, to = stars(u[u != v], v[u != v])
            root[moved] = to
    return roots(np.arange(len(given)))


def blocks(asked: DataFrame, given: DataFrame, radius: float, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, dims: Sequence[str] = ("x", "y", "z"), on: Sequence[str] = (), side: int = 2) -> DataFrame:
    """run(asked rows of a block, all given rows that can lie within the radius of one) for each block that has asked rows.

    asked and given have the same columns. Blocks are ``side`` radii wide, and those of rows equal in the columns ``on``.
    """
    ship(asked.sparkSession)
    cells, size, reach = [f"cell_{i}" for i in range(len(dims))], side * radius, radius * (1 + SLACK)
    placed = " AND ".join(f"`{c}` IS NOT NULL" for c in (*on, *dims))
    own = asked.filter(placed).select("*", *[voxel_index(F.col(d), size).alias(c) for c, d in zip(cells, dims)], F.lit(True).alias("asks"))
    near = given.filter(placed).select(*asked.columns)
    for c, d in zip(cells, dims):
        near = near.withColumn(c, F.explode(F.sequence(voxel_index(F.col(d) - reach, size), voxel_index(F.col(d) + reach, size))))

    def both(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy(bool)
        return run(pdf[asks], pdf[~asks])

    return own.unionByName(near.withColumn("asks", F.lit(False))).groupBy(*on, *cells).applyInPandas(both, schema)


def crowded(given: DataFrame, radius: float, dims: Sequence[str] = ("x", "y", "z"), on: Sequence[str] = ()) -> float:
    """The mean number of points beside a point in its cell of the radius's size if pairs within the radius are too many to be rows, else 0."""
    n = given.groupBy(*on, *[voxel_index(F.col(d), radius).alias(f"cell_{d}") for d in dims]).agg(F.count("*").alias("n"))
    pairs, points = n.agg(F.sum(F.col("n") * F.col("n")), F.sum("n")).first()
    return pairs / points if points and pairs > max(FEW, CROWD * points) else 0.0


def wide(crowd: float) -> int:
    """How many radii wide blocks are that hold some thousand points: the more there are, the smaller."""
    return next((side for side in (2, 4, 8) if crowd * side * side >= 2000), 16)


def ball_sums(asked: DataFrame, given: DataFrame, radius: float, crowd: float, products: bool, dims: Sequence[str] = ("x", "y", "z"), on: Sequence[str] = (), offsets: bool = False) -> DataFrame:
    """(on, dims, n) of each asked site that has given ones (weight) within the radius; with their sums and sums of products, of offsets from the asked one or not."""
    names = [f"s{a}" for a in dims] if products else []
    pairs = [(i, j) for i in range(len(dims)) for j in range(i, len(dims))] if products else []
    names += [f"s{dims[i]}{dims[j]}" for i, j in pairs]

    def run(asks: pd.DataFrame, has: pd.DataFrame) -> pd.DataFrame:
        at, of, weight = asks[list(dims)].to_numpy("f8"), has[list(dims)].to_numpy("f8"), has["weight"].to_numpy("f8")[:, None]
        # Sums are of offsets from the middle, so that they lose no digits, and are moved at the end.
        middle = at.mean(axis=0) if len(at) else 0.0
        local = of - middle
        values = np.hstack([weight, weight * local, *[weight * (local[:, i] * local[:, j])[:, None] for i, j in pairs]]) if products else weight
        found = sums_within(at, of, values, radius)
        some = found[:, 0] > 0
        at, found = at[some], found[some]
        n, out = found[:, 0], asks.loc[some, [*on, *dims]].assign(n=np.rint(found[:, 0]).astype("i8"))
        if products:
            shift = (middle - at) if offsets else np.broadcast_to(middle, at.shape)
            first, square = found[:, 1 : 1 + len(dims)], dict(zip(pairs, found[:, 1 + len(dims) :].T))
            for i, a in enumerate(dims):
                out[f"s{a}"] = first[:, i] + n * shift[:, i]
            for i, j in pairs:
                out[f"s{dims[i]}{dims[j]}"] = square[i, j] + shift[:, i] * first[:, j] + shift[:, j] * first[:, i] + n * (shift[:, i] * shift[:, j])
        return out

    kept = [*on, *dims, "weight"]
    kinds = [f"`{c}` {asked.schema[c].dataType.simpleString()}" for c in (*on, *dims)]
    schema = ", ".join([*kinds, "n long", *[f"{c} double" for c in names]])
    return blocks(asked.select(*on, *dims, F.lit(0).cast("long").alias("weight")), given.select(*kept), radius, run, schema, dims, on, wide(crowd))
