"""Removal of near segments in turn: rounds and one task against the plain loop."""

import random

import pytest

from terravox.operators.duplicates import without_near


def brute(rows, apart, neighbours, grace):
    at = {r[0]: list(r[1:]) for r in rows}
    gone, of = set(), {s: s for s in at}
    d2 = lambda s, o: sum((at[s][k] - at[o][k]) ** 2 for k in (3, 4, 5))
    for s in sorted(at):
        near = sorted((d2(s, o), o) for o in at if o != s)[: neighbours - 1]
        for d, o in near:
            if s in gone:
                break
            if o in gone or d > apart * apart:
                continue
            (n, track, sec), (m, other, then) = at[s][:3], at[o][:3]
            if sec != then:
                if track != other and abs(sec - then) < grace:
                    continue
                new, old = (s, o) if sec > then else (o, s)
                gone.add(new)
                of[old] = of[new]
            else:
                gone.add(o if n > m else s)
    return sorted((s, of[s]) for s in at if s not in gone)


@pytest.mark.parametrize("seed", range(2))
def test_turns_equal_the_loop(spark, seed):
    r = random.Random(seed)
    ids = r.sample(range(1000), 40)
    rows = [(s, r.randrange(3, 9), r.randrange(2), float(r.choice([0, 5, 30, 60])), r.uniform(0, 4), r.uniform(0, 4), 0.0) for s in ids]
    rows += [(2000 + k, 5, 0, 7.0, 1.0, 1.0, 1.0) for k in range(12)]
    df = spark.createDataFrame(rows, "segment long, n long, track long, sec double, x double, y double, z double")
    for at_once in (12, 100_000):
        got = sorted(map(tuple, without_near(df, 0.5, at_once=at_once).collect()))
        assert got == brute(rows, 0.5, 5, 20.0)


def test_what_is_gone_removes_nothing(spark):
    """Of a chain of three, the largest removes the second, and the third stays. The older gets the features of the newer, through two turns."""
    chain = [(1, 9, 0, 0.0, 0.0, 0.0, 0.0), (2, 8, 0, 0.0, 0.4, 0.0, 0.0), (3, 7, 0, 0.0, 0.8, 0.0, 0.0)]
    ages = [(11, 5, 0, 40.0, 50.0, 0.0, 0.0), (12, 5, 0, 90.0, 50.1, 0.0, 0.0), (13, 5, 0, 5.0, 50.2, 0.0, 0.0), (14, 5, 1, 20.0, 50.3, 0.0, 0.0)]
    df = spark.createDataFrame(chain + ages, "segment long, n long, track long, sec double, x double, y double, z double")
    assert sorted(map(tuple, without_near(df, 0.5).collect())) == [(1, 1), (3, 3), (13, 12), (14, 14)]
    assert without_near(df.limit(0), 0.5).count() == 0 and without_near(df.limit(1), 0.5).count() == 1
