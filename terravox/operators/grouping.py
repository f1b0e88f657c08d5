"""Consensus groups of mutually consistent matches: greedy grouping in turn, then rejection by sample consensus."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravox.operators.folds import numbered
from terravox.operators.graph import degrees
from terravox.operators.reservations import leaders
from terravox.operators.rigid import fitted
from terravox.shared import written
from terravox.ship import ship

#: A group's motion: quaternion, shift, root mean square of what it leaves.
MOTION = ["qw", "qx", "qy", "qz", "dx", "dy", "dz", "error"]


def _taken(seed: int, near: dict[int, set[int]], used: set[int]) -> list[int]:
    """The seed and, in the order of ids, every neighbour still free that is consistent with all taken so far."""
    members = [seed]
    for n in sorted(near[seed] - used):
        if all(n in near[m] for m in members):
            members.append(n)
    return members


def greedy_groups(edges: DataFrame, least: int = 3, at_once: int = 500_000) -> DataFrame:
    """(grp, member): seeds in the order of (most neighbours, id) take all free matches consistent with the whole group; edges: src, dst.

    A seed touches itself and its neighbours. While more than ``at_once`` edges are open, all seeds whose turn cannot be told from being
    first act together; what is left is grouped in one task. Both give what the loop over all seeds gives.
    """
    ship(edges.sparkSession)
    both = edges.filter("src <> dst").select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("e")).select("e.a", "e.b").distinct()
    order = numbered(degrees(written(both, "edges").filter("a < b").withColumnsRenamed({"a": "src", "b": "dst"})).select("node", (-F.col("degree")).alias("few")), ["few", "node"], "turn").select("node", "turn")
    order = written(order, "order")
    now, seeds, groups = written(both, "edges"), order, None

    def grouped(batches):
        """Rows (turn, node, a, b): edges among what a seed can take, or all edges that are left (turn of a, a, a, b), by turn."""
        near: dict[int, set[int]] = {}
        turns: dict[int, int] = {}
        for pdf in batches:
            for turn, seed, a, b in zip(pdf["turn"].tolist(), pdf["node"].tolist(), pdf["a"].tolist(), pdf["b"].tolist()):
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
                if turn:
                    turns[seed] = turn
        used: set[int] = set()
        out = []
        for seed in sorted(turns, key=turns.get):
            if seed in used:
                continue
            members = _taken(seed, near, used)
            if len(members) >= least:
                used.update(members)
                out += [(seed, m) for m in members]
        yield pd.DataFrame(out, columns=["grp", "member"]).astype("int64")

    while True:
        n = now.count()
        if not n:
            break
        if n <= at_once:
            rows = now.join(seeds.select(F.col("node").alias("a"), "turn"), "a", "left").select(F.coalesce("turn", F.lit(0)).alias("turn"), F.col("a").alias("node"), "a", "b")
            found = written(rows.repartition(1).mapInPandas(grouped, "grp long, member long"), "groups")
            return found if groups is None else groups.unionByName(found)
        claims = now.join(seeds.select(F.col("node").alias("a"), F.col("turn").alias("item")), "a").select("item", F.col("b").alias("cell"))
        claims = written(claims.unionByName(seeds.select(F.col("turn").alias("item"), F.col("node").alias("cell"))), "claims")
        first = written(leaders(claims).withColumnRenamed("item", "turn").join(seeds, "turn"), "leaders")
        # Each cell has one leader at most, so edges among what a leader can take are those whose ends have the same one.
        of = written(claims.join(first.select(F.col("turn").alias("item"), F.col("node").alias("seed")), "item").select("cell", F.col("item").alias("turn"), "seed"), "cells")
        side = lambda c: of.select(F.col("cell").alias(c), F.col("turn").alias(f"{c}_turn"), "seed")
        inner = now.filter("a < b").join(side("a"), "a").join(side("b").drop("seed"), "b").filter("a_turn = b_turn")
        rows = inner.select(F.col("a_turn").alias("turn"), F.col("seed").alias("node"), "a", "b").repartition("turn").sortWithinPartitions("turn")
        found = written(rows.mapInPandas(grouped, "grp long, member long"), "groups")
        groups = found if groups is None else groups.unionByName(found)
        used = found.select(F.col("member").alias("node"))
        seeds = written(seeds.join(first.select("node"), "node", "left_anti").join(used, "node", "left_anti"), "seeds")
        for c in "ab":
            now = now.join(used.withColumnRenamed("node", c), c, "left_anti")
        now = written(now.select("a", "b"), "edges")
    return groups if groups is not None else edges.sparkSession.createDataFrame([], "grp long, member long")


def sample_consensus(scene: np.ndarray, model: np.ndarray, within: float, trials: int, seed: tuple[int, ...]) -> tuple[np.ndarray, tuple[float, ...]] | None:
    """(which rows agree, their motion): of the motions that three rows each define, that which brings most others within a distance.

    All triples are tried if there are at most ``trials``, else as many drawn with the seed; of equally many the smaller error
    counts, then the earlier. The motion is fitted once more to all that agree. None if no triple finds a third.
    """
    n = len(scene)
    if n < 3:
        return None
    if n * (n - 1) * (n - 2) // 6 <= trials:
        picks = [list(t) for t in combinations(range(n), 3)]
    else:
        rng = np.random.default_rng(seed)
        picks = [rng.choice(n, 3, replace=False).tolist() for _ in range(trials)]

    def agreeing(motion) -> tuple[np.ndarray, float]:
        w, x, y, z, *shift, _ = motion
        turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
        apart = np.sqrt((((scene @ turn.T + shift) - model) ** 2).sum(axis=1))
        ok = apart <= within
        return ok, float((apart[ok] ** 2).sum())

    best = None
    for pick in picks:
        ok, error = agreeing(fitted(scene[pick], model[pick]))
        if ok.sum() >= 3 and (best is None or (-ok.sum(), round(error, 12)) < (-best[0].sum(), round(best[1], 12))):
            best = ok, error
    if best is None:
        return None
    motion = fitted(scene[best[0]], model[best[0]])
    return best[0], motion


def consensus_groups(groups: DataFrame, within: float, least: int = 3, trials: int = 200, seed: int = 0) -> DataFrame:
    """(grp, member, and the group's MOTION): members that agree on one motion; groups of fewer than ``least`` such members go.

    groups: grp, member, sx, sy, sz, mx, my, mz. A group is the work of one task, so its size is bounded by what one match is consistent with.
    """
    ship(groups.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("member")
        grp = int(pdf["grp"].iloc[0])
        found = sample_consensus(pdf[["sx", "sy", "sz"]].to_numpy("f8"), pdf[["mx", "my", "mz"]].to_numpy("f8"), within, trials, (seed, grp & (2**63 - 1)))
        members = pdf["member"][found[0]].tolist() if found else []
        if len(members) < least:
            members = []
        out = pd.DataFrame({"grp": [grp] * len(members), "member": members}).astype("int64")
        for i, name in enumerate(MOTION):
            out[name] = float(found[1][i]) if members else 0.0
        return out

    return groups.groupBy("grp").applyInPandas(run, "grp long, member long, " + ", ".join(f"{c} double" for c in MOTION))
