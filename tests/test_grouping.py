"""Greedy groups in rounds and in one task against the plain loop; rejection of planted outliers."""

import random
from itertools import combinations

import numpy as np
import pytest

from terravox.operators.grouping import MOTION, consensus_groups, greedy_groups, sample_consensus
from terravox.operators.rigid import fitted


def brute(pairs, least):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    used, out = set(), []
    for seed in sorted(near, key=lambda n: (-len(near[n]), n)):
        if seed in used:
            continue
        members = [seed]
        for n in sorted(near[seed] - used):
            if all(n in near[m] for m in members):
                members.append(n)
        if len(members) >= least:
            used |= set(members)
            out += [(seed, m) for m in members]
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_groups_equal_the_loop(spark, seed):
    r = random.Random(seed)
    pairs = []
    for n, size in ((0, 30), (100, 12), (200, 3), (300, 2)):
        pairs += [(n + a, n + b) for a, b in combinations(range(size), 2) if r.random() < 0.45]
    df = spark.createDataFrame([p if r.random() < 0.5 else p[::-1] for p in pairs] + pairs[:4], "src long, dst long")
    for at_once in (40, 500_000):
        assert sorted(map(tuple, greedy_groups(df, 3, at_once).collect())) == brute(pairs, 3)
    assert greedy_groups(df.limit(0)).count() == 0


def turn_of(w, x, y, z):
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def test_planted_outliers_are_rejected(spark):
    """Groups of one motion with outliers, one group without any agreement, one too small; a plain run with the same seed agrees."""
    r, rows, good = np.random.default_rng(5), [], {}
    for grp, (n, bad) in {1: (9, 3), 2: (30, 12), 3: (3, 0), 4: (2, 0)}.items():
        q = r.standard_normal(4)
        q /= np.sqrt((q * q).sum())
        shift, scene = r.uniform(-9, 9, 3), r.uniform(-20, 20, (n + bad, 3))
        model = scene @ turn_of(*q).T + shift + r.normal(0, 0.01, (n + bad, 3))
        model[n:] += r.choice([-1, 1], (bad, 3)) * r.uniform(3, 9, (bad, 3))
        order = r.permutation(n + bad)
        rows += [(grp, 100 * grp + int(k), *scene[i].tolist(), *model[i].tolist()) for k, i in enumerate(order)]
        good[grp] = {100 * grp + k for k, i in enumerate(order) if i < n} if n >= 3 else set()
    rows += [(5, 500 + k, *r.uniform(-20, 20, 6).tolist()) for k in range(6)]
    df = spark.createDataFrame(rows, "grp long, member long, sx double, sy double, sz double, mx double, my double, mz double")
    found = {}
    for row in consensus_groups(df, 0.2, least=3, trials=150, seed=3).collect():
        found.setdefault(row["grp"], []).append(row)
    assert {g: {row["member"] for row in got} for g, got in found.items()} == {g: m for g, m in good.items() if m}
    for grp, got in found.items():
        mine = np.array([row[2:] for row in sorted(rows, key=lambda row: row[1]) if row[0] == grp])
        ok, motion = sample_consensus(mine[:, :3], mine[:, 3:], 0.2, 150, (3, grp))
        assert ok.sum() == len(got) and [got[0][m] for m in MOTION] == pytest.approx(list(motion))
        assert list(motion) == pytest.approx(list(fitted(mine[ok, :3], mine[ok, 3:]))) and got[0]["error"] < 0.05
