"""Range joins by a grid, and nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravox.functions.geometry import voxel_index
from terravox.operators.pivots import Best, nearest_join
from terravox.shared import written
from terravox.ship import ship


def squared(dims: Sequence[str], left: str, right: str) -> Column:
    out = F.lit(0.0)
    for d in dims:
        gap = F.col(f"{left}.{d}") - F.col(f"{right}.{d}")
        out = out + gap * gap
    return out


def range_join(left: DataFrame, right: DataFrame, radius: float, dims: Sequence[str] = ("x", "y", "z"), on: Sequence[str] = ()) -> DataFrame:
    """Pairs (l, r, d2) of rows at most ``radius`` apart, as structs; only rows equal in the columns ``on`` meet.

    Cells of the radius's size make it an equi-join: each left row is dealt to the 3^n cells around it, each
    right row to its own, and the exact distance is checked on what meets. Nothing is broadcast or crossed.
    """
    cell = [voxel_index(F.col(d), radius) for d in dims]
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(on)]
    near = left.select(F.struct(*left.columns).alias("l"), *keys, *[c.alias(f"c{i}") for i, c in enumerate(cell)])
    for i in range(len(dims)):
        near = near.withColumn(f"c{i}", F.explode(F.sequence(F.col(f"c{i}") - 1, F.col(f"c{i}") + 1)))
    own = right.select(F.struct(*right.columns).alias("r"), *keys, *[c.alias(f"c{i}") for i, c in enumerate(cell)])
    pairs = near.join(own, [f"k{i}" for i in range(len(on))] + [f"c{i}" for i in range(len(dims))])
    return pairs.withColumn("d2", squared(dims, "l", "r")).filter(F.col("d2") <= radius * radius).select("l", "r", "d2")


def sites(points: DataFrame, dims: Sequence[str] = ("x", "y", "z"), on: Sequence[str] = ()) -> DataFrame:
    """One row per place that holds points: dims, on, weight (how many), all combined per task before the shuffle.

    Points of one place have one neighbourhood, so neighbours are looked for once per place; its pairs do not grow with copies. Points that lack a coordinate lie nowhere.
    """
    placed = points.filter(" AND ".join(f"`{d}` IS NOT NULL" for d in dims))
    found = placed.groupBy(*on, *dims).agg(F.count("*").alias("weight"))
    # Few bytes, but the joins around them are the work: a fixed number of parts, since Spark would put small ones together.
    return found.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on, *dims)


def by_cells(asked: DataFrame, given: DataFrame, radius: float, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, dims: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """run(asked rows of a cell, all given rows that can lie within the radius of one) for each cell that has asked rows.

    asked and given have the same columns. Cells have the radius's size, so a task holds a cell's surroundings and no pairs.
    """
    ship(asked.sparkSession)
    cells = [f"cell_{i}" for i in range(len(dims))]
    own = asked.select("*", *[voxel_index(F.col(d), radius).alias(c) for c, d in zip(cells, dims)]).filter(f"{cells[0]} IS NOT NULL")
    near = given.select(*asked.columns, *[voxel_index(F.col(d), radius).alias(c) for c, d in zip(cells, dims)])
    for c in cells:
        near = near.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    near = near.join(own.select(*cells).distinct(), cells, "left_semi")

    def both(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy(bool)
        return run(pdf[asks], pdf[~asks])

    dealt = own.withColumn("asks", F.lit(True)).unionByName(near.withColumn("asks", F.lit(False)))
    return dealt.groupBy(*cells).applyInPandas(both, schema)


def placed(pdf: pd.DataFrame, dims: Sequence[str] = ("x", "y", "z")) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places of rows, and which one each row has."""
    at, of = np.unique(pdf[list(dims)].to_numpy("f8"), axis=0, return_inverse=True)
    return at, of.reshape(-1)


def squares(at: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Squared distances of places from one of them, summed as SQL sums them."""
    out = np.zeros(len(places))
    for i in range(places.shape[1]):
        gap = at[i] - places[:, i]
        out += gap * gap
    return out


def radius_pairs(points: DataFrame, radius: float, dims: Sequence[str] = ("x", "y", "z"), key: str = "pid", on: Sequence[str] = (), held: Sequence[str] = ()) -> DataFrame:
    """(src, dst, d2): unordered pairs of distinct points within the radius, src < dst; at least one of a pair has 0 in the columns ``held``."""
    slim = points.select(F.col(key).alias("pid"), *dims, *on, *held)
    pairs = range_join(slim, slim, radius, dims, on).filter("l.pid < r.pid")
    for c in held:
        pairs = pairs.filter(f"l.{c} = 0 OR r.{c} = 0")
    return pairs.select(F.col("l.pid").alias("src"), F.col("r.pid").alias("dst"), "d2")


def _blocks(queries: DataFrame, columns: list, key: str, block: int):
    """The queries' columns, the first an id, as lists of rows: blocks of about ``block`` rows by the id's hash, one at a time."""
    ids = queries.select(*columns)
    blocks = max(1, -(-ids.count() // block))
    for b in range(blocks):
        rows = ids.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).collect()
        if rows:
            yield rows


def _rounds(spark, blocks, run) -> DataFrame | None:
    """run(broadcast block) for each block in turn, each result written before the next block is sent."""
    found = None
    for rows in blocks:
        sent = spark.sparkContext.broadcast(rows)
        got = written(run(sent), "block")
        sent.unpersist(blocking=False)
        found = got if found is None else found.unionByName(got)
    return found


def nearest(targets: DataFrame, queries: DataFrame, k: int, vector: str = "vector", key: str = "id", block: int = 4096) -> DataFrame:
    """(query, target, d2, rank): for each query the k nearest other targets by Euclidean distance; ties go to the smaller id.

    Up to ``block`` queries go out at once and pass over the targets once: each task keeps its k best, a window ranks what the tasks found.
    More queries are joined by pivots, whose work does not grow with passes. Both are exact.
    """
    if queries.count() > block:
        return nearest_join(targets, queries, k, vector, key).neighbours
    spark = ship(targets.sparkSession)

    def run(sent):
        def best(batches):
            rows = sent.value
            kept = Best(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], "f8"), k)
            for pdf in batches:
                t, y = pdf["t"].to_numpy(), np.array(pdf["v"].tolist(), "f8")
                for lo in range(0, len(t), 1024):
                    kept.offer(t[lo : lo + 1024], y[lo : lo + 1024])
            query, target, d2 = kept.rows()
            yield pd.DataFrame({"query": query, "target": target, "d2": d2})

        return targets.select(F.col(key).alias("t"), F.col(vector).alias("v")).mapInPandas(best, "query long, target long, d2 double")

    found = _rounds(spark, _blocks(queries, [F.col(key).alias("q"), F.col(vector).alias("v")], "q", block), run)
    if found is None:
        return spark.createDataFrame([], "query long, target long, d2 double, rank int")
    order = Window.partitionBy("query").orderBy("d2", "target")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "target", "d2", "rank")


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, summed dimension by dimension: a pair's sum never depends on the rows around it."""
    out = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        gap = x[:, i, None] - y[None, :, i]
        out += gap * gap
    return out


def first_of_class(targets: DataFrame, queries: DataFrame, label: str = "label", vector: str = "vector", key: str = "id", block: int = 1024) -> DataFrame:
    """(query, rank): the place of the first other target of a query's class among all other targets by distance; ties by id.

    One pass over the targets finds the nearest of the class, a second counts what lies before it. Queries alone in their class have no row.
    """
    spark = ship(targets.sparkSession)
    slim = targets.select(F.col(key).alias("t"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"))
    columns = [F.col(key).alias("q"), F.col(vector).alias("v"), F.col(label).cast("long").alias("label")]

    def closest(sent):
        def run(batches):
            rows = sent.value
            q, x, mine = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], "f8"), np.array([r[2] for r in rows])
            for pdf in batches:
                t, y, theirs = pdf["t"].to_numpy(), np.array(pdf["v"].tolist(), "f8"), pdf["label"].to_numpy()
                for lo in range(0, len(t), 1024):
                    ids = t[lo : lo + 1024]
                    d = _distances(x, y[lo : lo + 1024])
                    d[(mine[:, None] != theirs[None, lo : lo + 1024]) | (q[:, None] == ids[None, :])] = np.inf
                    at = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, 0]
                    best = d[np.arange(len(q)), at]
                    ok = np.isfinite(best)
                    yield pd.DataFrame({"q": q[ok], "d": best[ok], "t": ids[at][ok]})

        return slim.mapInPandas(run, "q long, d double, t long")

    found = _rounds(spark, _blocks(queries, columns, "q", block), closest)
    if found is None:
        return spark.createDataFrame([], "query long, rank long")
    best = found.groupBy("q").agg(F.min(F.struct("d", "t")).alias("b"))
    known = written(queries.select(*columns).join(best, "q").select("q", "v", F.col("b.d").alias("d"), F.col("b.t").alias("t")), "closest")

    def before(sent):
        def run(batches):
            rows = sent.value
            q, x, limit, last = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], "f8"), np.array([r[2] for r in rows])[:, None], np.array([r[3] for r in rows])[:, None]
            n = np.zeros(len(q), np.int64)
            for pdf in batches:
                t, y = pdf["t"].to_numpy(), np.array(pdf["v"].tolist(), "f8")
                for lo in range(0, len(t), 1024):
                    ids = t[None, lo : lo + 1024]
                    d = _distances(x, y[lo : lo + 1024])
                    n += (((d < limit) | ((d == limit) & (ids < last))) & (ids != q[:, None])).sum(axis=1)
            yield pd.DataFrame({"query": q, "n": n})

        return slim.mapInPandas(run, "query long, n long")

    counted = _rounds(spark, _blocks(known, ["q", "v", "d", "t"], "q", block), before)
    if counted is None:
        return spark.createDataFrame([], "query long, rank long")
    return counted.groupBy("query").agg((F.sum("n") + 1).alias("rank"))
