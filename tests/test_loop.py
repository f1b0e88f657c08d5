"""The whole loop and the clique search on cases whose answer is known."""

import random
from itertools import combinations

import pytest

from terravox.operators.graph import cliques, largest_clique, peeled
from terravox.plans.loop_plans import local_map_loop
from terravox.plans.shape_plans import ensemble


def test_local_map_finds_its_place(spark, tmp_path):
    """All segments seen again are matched with themselves and put back where they were; one that is new is put in by the same motion."""
    r = random.Random(3)
    rows, centre = [], {}
    for k in range(36):
        segment = 50 * (k + 1) if k % 2 else 50 * (k + 1) + 7
        at = (3 * (k % 6) + r.uniform(-0.4, 0.4), 3 * (k // 6) + r.uniform(-0.4, 0.4), r.uniform(0, 2))
        spread = [r.uniform(0.1, 3) for _ in at]
        points = [[a + r.uniform(-s, s) for a, s in zip(at, spread)] for _ in range(12)]
        centre[segment] = [sum(p[i] for p in points) / 12 for i in range(3)]
        rows += [(segment, 4, n, x, y * 1999.7, z / 100) for n, (x, y, z) in enumerate(points)]
    stranger = [[200 + r.uniform(-9, 9), 300 + r.uniform(-9, 9), r.uniform(-9, 9)] for _ in range(12)]
    centre[50_000] = [sum(p[i] for p in stranger) / 12 for i in range(3)]
    rows += [(50_000, 5, n, x, y * 1999.7, z / 100) for n, (x, y, z) in enumerate(stranger)]
    columns = "l_partkey long, l_linenumber int, l_orderkey long, l_quantity double, l_extendedprice double, l_discount double"
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "lineitem.parquet"))

    rows = local_map_loop(spark, str(tmp_path)).collect()
    assert len({row["segment"] for row in rows}) == len(rows) == 36 + 1
    assert {row["segment"] for row in rows if row["action"] == "kept"} == {s for s in centre if s % 50}
    got = {row["source"]: row for row in rows if row["action"] != "kept"}
    assert set(got) == {s for s in centre if s % 50 == 0}
    for segment, row in got.items():
        assert (row["action"], row["segment"]) == (("inserted", max(s for s in centre if s < 50_000) + 1) if segment == 50_000 else ("updated", segment))
        assert [row[a] for a in "xyz"] == pytest.approx(centre[segment], abs=2e-3)


@pytest.mark.parametrize("seed", range(20))
def test_largest_clique_equals_enumeration(seed):
    r = random.Random(seed)
    n = r.randrange(4, 12)
    pairs = [p for p in combinations(range(n), 2) if r.random() < r.choice((0.4, 0.7, 0.9))]
    held = set(pairs)
    sizes = {k: [c for c in combinations(range(n), k) if all(e in held for e in combinations(c, 2))] for k in range(2, n + 1)}
    for least in (2, 3, 4):
        full = [k for k, found in sizes.items() if found and k >= least]
        assert largest_clique(pairs, least) == (list(min(sizes[max(full)])) if full else [])


def test_large_dense_graph_is_bounded_by_colours():
    """A clique of 30 among parts that hold no clique of over 12: the colours cut what counting nodes would search."""
    pairs = list(combinations(range(1000, 1030), 2))
    pairs += [(a, b) for a, b in combinations(range(60), 2) if a % 12 != b % 12]
    assert largest_clique(pairs, 3) == list(range(1000, 1030))


def test_shapes_of_few_points(spark):
    """A right triangle with sides 3, 4 and 5, points that coincide, and too few points."""
    rows = [(1, 0, 0.0, 0.0, 0.0), (1, 1, 3.0, 0.0, 0.0), (1, 2, 0.0, 4.0, 0.0)]
    rows += [(2, i, 1.0, 1.0, 1.0) for i in range(3)] + [(3, 0, 0.0, 0.0, 0.0), (3, 1, 1.0, 1.0, 1.0)]
    got = ensemble(spark.createDataFrame(rows, "segment long, i int, x double, y double, z double"), ["i"]).collect()
    found = {s: sorted((r["histogram"].split("_")[0], r["bin"], r["n"]) for r in got if r["segment"] == s) for s in (1, 2, 3)}
    assert found[3] == []
    assert found[2] == [("a3", 0, 3), ("d2", 0, 3), ("d3", 0, 1), ("ratio", 63, 3)]
    kinds = {k: [x for x in found[1] if x[0] == k] for k in ("a3", "d2", "d3")}
    # Angles of 36.87, 53.13 and 90 degrees; sides of 12, 16 and 20 of 27.7; an area of 96 of 256.
    assert [b for _, b, _ in kinds["a3"]] == [13, 18, 32]
    assert [b for _, b, _ in kinds["d2"]] == [27, 36, 46]
    assert [b for _, b, _ in kinds["d3"]] == [39]
    assert sum(r["share"] for r in got if r["segment"] == 1) == pytest.approx(1, abs=1e-4)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("at_once", [0, 500_000])
def test_cliques_by_later_neighbours(spark, seed, at_once):
    """One task or rounds of peeling: the same clique per component, the smallest of the largest; loops and repeated edges count for nothing."""
    r = random.Random(seed)
    pairs, n = [], 0
    for size, share in ((9, 0.8), (7, 0.5), (12, 0.6), (3, 1.0), (2, 1.0), (5, 0.5)):
        pairs += [(n + a, n + b) for a, b in combinations(range(size), 2) if r.random() < share]
        n += size
    edges = spark.createDataFrame([(b, a) if r.random() < 0.5 else (a, b) for a, b in pairs] + pairs[:5] + [(1, 1)], "src long, dst long")
    for least in (2, 3, 4):
        got = {}
        for row in cliques(edges, least, at_once).collect():
            got.setdefault(row["component"], []).append(row["member"])
        held, want = set(pairs), {}
        # Components of what is left when nodes of too few neighbours are gone.
        left = set(range(n))
        while weak := {v for v in left if sum((min(u, v), max(u, v)) in held for u in left) < least - 1}:
            left -= weak
        while left:
            part, new = set(), {min(left)}
            while new:
                part |= new
                new = {u for u in left - part if any((min(u, v), max(u, v)) in held for v in new)}
            left -= part
            best = largest_clique([(a, b) for a, b in pairs if a in part and b in part], least)
            if best:
                want[min(part)] = best
        assert {k: sorted(v) for k, v in got.items()} == want


@pytest.mark.parametrize("at_once", [0, 500_000])
def test_peeling_bounds_later_neighbours(spark, at_once):
    """A hub of a thousand neighbours and a clique of twelve: no node has many later neighbours, and a component is many searches."""
    r = random.Random(1)
    pairs = {(0, v) for v in range(1, 1001)} | {tuple(sorted(r.sample(range(1, 1001), 2))) for _ in range(3000)} | set(combinations(range(2000, 2012), 2)) | {(1, 2000)}
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
    place = {p["node"]: (p["place"], p["node"]) for p in peeled(edges, 2, at_once).collect()}
    assert set(place) == {v for e in pairs for v in e}
    later = {}
    for a, b in pairs:
        first = min(a, b, key=place.get)
        later[first] = later.get(first, 0) + 1
    # The graph's degeneracy is 11: each member of the clique has 11 neighbours in it.
    assert max(later.values()) <= (11 if at_once else 33)
    assert sorted(m["member"] for m in cliques(edges, 3, at_once).collect()) == list(range(2000, 2012))
