"""Graphs as edge tables: components, degrees, cores and cliques."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravox.shared import written
from terravox.ship import ship


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges (node, smallest node of its component) of the graph with edges u, v; smallest nodes have none."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root[moved]]


def contracted(edges: DataFrame, at_once: int) -> DataFrame:
    """Edges (u, v) with the same components: each task gives stars for its own, and holds some ``at_once`` of them."""
    ship(edges.sparkSession)

    def contract(batches):
        held, n = [], 0
        for batch in batches:
            held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
            n += batch.num_rows
            if n > at_once:
                u, v = stars(*map(np.concatenate, zip(*held)))
                held, n = [(u, v)], len(u)
                if 2 * n > at_once:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                    held, n = [], 0
        if held:
            u, v = stars(*map(np.concatenate, zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return edges.mapInArrow(contract, "u long, v long")


def components(edges: DataFrame, max_rounds: int = 60, at_once: int = 500_000) -> DataFrame:
    """(src, dst) integers -> (node, component) for every node that has an edge; component: its smallest node.

    Tasks first contract what edges they have, without a shuffle. Should at most ``at_once`` edges be left in all, one
    task contracts those. Else nodes give way to neighbours in rounds, each of which leaves a fraction of the edges, until one task
    can contract them; only counts reach the driver. Edges of a node to itself or to null count for nothing.
    """
    kind = edges.schema["src"].dataType
    ends = [F.col(c).cast("long") for c in ("src", "dst")]
    now = edges.filter("src <> dst").select(F.greatest(*ends).alias("u"), F.least(*ends).alias("v"))
    now = written(contracted(now, at_once), "edges")
    if now.count() <= at_once:
        now = written(contracted(now.coalesce(1), at_once), "edges")
    else:
        now = _settled(now, max_rounds, at_once)
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    return found.select(*[F.col(c).cast(kind).alias(c) for c in found.columns])


def _settled(now: DataFrame, max_rounds: int, at_once: int) -> DataFrame:
    """Edges (u, v), u > v, as stars around the smallest node of each component.

    In each round every node gives way to the first of itself and its neighbours, and only edges between those that stay are left. First
    are the smallest, in every other round those of the smallest hash: ids along a path may lie so that only its last node goes.
    """
    ways = []
    for number in range(max_rounds):
        order = (lambda c: F.struct(F.col(c).alias("id"))) if number % 2 == 0 else (lambda c, n=number: F.struct(F.xxhash64(c, F.lit(n)), F.col(c).alias("id")))
        ends = now.select("u", order("v").alias("other")).unionByName(now.select(F.col("v").alias("u"), order("u").alias("other")))
        way = ends.groupBy("u").agg(F.min("other").alias("other")).select("u", F.least("other", order("u"))["id"].alias("to"))
        ways.append(written(way.filter("u <> to"), "ways"))
        for c in ("u", "v"):
            now = now.join(ways[-1].withColumnsRenamed({"u": c}), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        now = now.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        now = written(contracted(now, at_once), "edges")
        if now.count() <= at_once:
            break
    else:
        raise RuntimeError("components did not settle")
    # (u, to): the node that is left where u was, round by round back to the first. One to which others gave way can give way itself and still be
    # left: it is found again then, with the same end or as its own.
    found = written(contracted(now.coalesce(1), at_once).withColumnRenamed("v", "to"), "found")
    for way in reversed(ways):
        last = found.select(F.col("u").alias("to"), F.col("to").alias("last"))
        found = written(found.unionByName(way.join(last, "to", "left").select("u", F.coalesce("last", "to").alias("to")).filter("u <> to")).distinct(), "found")
    # Which node is left is a matter of the rounds; a component is named by its smallest.
    least = found.groupBy("to").agg(F.least(F.min("u"), F.col("to")).alias("v"))
    named = found.join(least, "to").select("u", "v").unionByName(least.select(F.col("to").alias("u"), "v"))
    return named.filter("u <> v")


def labelled(nodes: DataFrame, edges: DataFrame, node_col: str = "node") -> DataFrame:
    """Every row of nodes with its component; nodes without an edge are their own."""
    found = components(edges).withColumnRenamed("node", node_col)
    return nodes.join(found, node_col, "left").withColumn("component", F.coalesce("component", F.col(node_col)))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree) of undirected edges (src, dst)."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def core(edges: DataFrame, k: int, max_rounds: int = 50) -> DataFrame:
    """The edges left once nodes of fewer than k neighbours are removed again and again."""
    now, before = edges, -1
    for _ in range(max_rounds):
        now = written(now, "core")
        n = now.count()
        if n == before or not n:
            break
        before = n
        weak = degrees(now).filter(F.col("degree") < k).select("node")
        now = now.join(weak.withColumnRenamed("node", "src"), "src", "left_anti").join(weak.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
    return now


def _neighbours(pairs) -> dict[int, set[int]]:
    near: dict[int, set[int]] = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def largest_clique(pairs: list[tuple[int, int]], least: int) -> list[int]:
    """A largest clique of at least ``least`` nodes, the smallest as a sorted list of all; empty if there is none.

    Branch and bound: nodes are tried in order, candidates shrink to common neighbours, and a branch that cannot
    exceed the best so far is left. Of nodes that share a colour, no two are neighbours, so a clique among the
    candidates has at most as many nodes as they have colours.
    """
    return _largest(_neighbours((a, b) for a, b in pairs if a != b), least)


def _largest(near: dict[int, set[int]], least: int) -> list[int]:
    """The same of a graph given by the neighbours of each node."""
    best: list[int] = []

    def colours(candidates: list[int]) -> list[int]:
        """For each place, how many colours the nodes from there on need when each takes the first that is free."""
        groups: list[set[int]] = []
        counts = []
        for node in reversed(candidates):
            for group in groups:
                if group.isdisjoint(near[node]):
                    group.add(node)
                    break
            else:
                groups.append({node})
            counts.append(len(groups))
        return counts[::-1]

    def grow(chosen: list[int], candidates: list[int]) -> None:
        nonlocal best
        if len(chosen) > len(best):
            best = chosen
        for i, (node, most) in enumerate(zip(candidates, colours(candidates))):
            if len(chosen) + most <= max(len(best), least - 1):
                return
            grow([*chosen, node], [c for c in candidates[i + 1 :] if c in near[node]])

    grow([], sorted(near))
    return best if len(best) >= least else []


def _peel(near: dict[int, set[int]], least: int) -> list[int]:
    """The nodes of the (least - 1)-core, always that of fewest neighbours left; near is used up."""
    bins: list[set[int]] = []
    for node, others in near.items():
        bins += [set() for _ in range(len(others) + 1 - len(bins))]
        bins[len(others)].add(node)
    low, core, out = 0, 0, []
    for _ in range(len(near)):
        low = max(0, low - 1)
        while not bins[low]:
            low += 1
        core = max(core, low)
        node = bins[low].pop()
        if core >= least - 1:
            out.append(node)
        for other in near.pop(node):
            mine = near[other]
            bins[len(mine)].discard(other)
            mine.discard(node)
            bins[len(mine)].add(other)
    return out


def clique_of(pairs, least: int, part: int = 0, parts: int = 1) -> list[int]:
    """A largest clique among those whose first node in the peeling order is dealt to this part: the smallest as a sorted list; empty if none has ``least`` nodes.

    Every part finds the same greedy cliques first, which its own nodes' later neighbours must be able to match.
    """
    near = _neighbours(pairs)
    order = _peel({n: set(o) for n, o in near.items()}, least)
    place = {node: i for i, node in enumerate(order)}
    later = {node: {u for u in near[node] if place.get(u, -1) > i} for node, i in place.items()}
    wanted, best = least, []
    for node in order:
        n, left = 1, later[node]
        while left and n + len(left) > wanted:
            left = left & near[max(left, key=lambda u: (place[u], u))]
            n += 1
        wanted = max(wanted, n)
    for node in order[part::parts]:
        left, before = later[node], -1
        while before != len(left) and len(left) + 1 >= wanted:
            before, left = len(left), {u for u in left if len(near[u] & left) >= wanted - 2}
        if len(left) + 1 < wanted:
            continue
        found = _largest({u: near[u] & left for u in left}, wanted - 1)
        if found and (not best or (-len(found) - 1, sorted([node, *found])) < (-len(best), best)):
            best = sorted([node, *found])
            wanted = len(best)
    return best


def peeled(edges: DataFrame, least: int, at_once: int = 500_000, slack: float = 0.5) -> DataFrame:
    """(node, place): an order in which no node has many later neighbours, for the nodes of the (least - 1)-core.

    Up to ``at_once`` edges are peeled in one task, always the node of fewest neighbours left: no node then has more later ones than the
    graph's degeneracy. More are peeled in rounds, each of which takes all nodes of at most (1 + slack) times the mean degree, a share of
    slack / (1 + slack) of them or more; places count rounds, ties go by id, and no node has over 2 (1 + slack) times the degeneracy.
    """
    ship(edges.sparkSession)
    now = written(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).filter("src <> dst").distinct(), "edges")
    if now.count() <= at_once:

        def peel(batches):
            out = _peel(_neighbours(pair for pdf in batches for pair in zip(pdf["src"].tolist(), pdf["dst"].tolist())), least)
            yield pd.DataFrame({"node": out, "place": range(len(out))}).astype("int64")

        return written(now.coalesce(1).mapInPandas(peel, "node long, place long"), "peeled")
    now, done, number = core(now, least - 1), None, 0
    while True:
        of = written(degrees(now), "degrees")
        nodes, ends = of.agg(F.count("*"), F.sum("degree")).first()
        if not nodes:
            break
        gone = written(of.filter(F.col("degree") <= (1 + slack) * ends / nodes).select("node", F.lit(number).cast("long").alias("place")), "peeled")
        done = gone if done is None else done.unionByName(gone)
        for name in ("src", "dst"):
            now = now.join(gone.select(F.col("node").alias(name)), name, "left_anti")
        now, number = written(now.select("src", "dst"), "edges"), number + 1
        # Nodes whose last neighbours went are left out of the edges: they have no later neighbour, so they are needed as such only.
        last = of.join(gone, "node", "left_anti").join(written(degrees(now), "degrees"), "node", "left_anti").select("node", F.lit(number).cast("long").alias("place"))
        done = done.unionByName(written(last, "peeled"))
    return done if done is not None else edges.sparkSession.createDataFrame([], "node long, place long")


def cliques(edges: DataFrame, least: int = 3, at_once: int = 500_000, part: int = 20_000) -> DataFrame:
    """(component, member): one largest clique per connected component that has one of ``least`` nodes: the smallest as a sorted list.

    A component of up to ``at_once`` edges goes as it is to one task, or to one for each ``part`` edges, each of which searches its share of the
    nodes; no lists of neighbours are written. Larger components are searched by node.
    """
    ship(edges.sparkSession)
    ends = [F.col(c).cast("long") for c in ("src", "dst")]
    pairs = written(edges.filter("src <> dst").select(F.least(*ends).alias("src"), F.greatest(*ends).alias("dst")).distinct(), "pairs")
    of = written(pairs.join(components(pairs).withColumnRenamed("node", "src"), "src").select("component", "src", "dst"), "of-components")
    sizes = written(of.groupBy("component").agg(F.count("*").alias("n")), "sizes")

    def found(batches):
        key, rows = None, []

        def out():
            members = clique_of(rows, least, key[1], key[2]) if rows else []
            return [(key[0], members)] if members else []

        for pdf in batches:
            done = []
            for *at, src, dst in zip(*(pdf[c].tolist() for c in ("component", "part", "parts", "src", "dst"))):
                if at != key:
                    done += out()
                    key, rows = at, []
                rows.append((src, dst))
            yield pd.DataFrame(done, columns=["component", "members"])
        yield pd.DataFrame(out(), columns=["component", "members"])

    parts = F.ceil(F.col("n") / part)
    small = of.join(sizes.filter((F.col("n") <= at_once) & (F.col("n") >= least * (least - 1) // 2)), "component").withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    small = small.select("component", "part", "parts", "src", "dst").repartition("component", "part").sortWithinPartitions("component", "part")
    best = _best(written(small.mapInPandas(found, "component long, members array<long>"), "found"))
    large = sizes.filter(F.col("n") > at_once)
    if large.isEmpty():
        return best
    return best.unionByName(_cliques_by_node(of.join(large, "component", "left_semi").select("src", "dst"), least, at_once))


def _best(found: DataFrame) -> DataFrame:
    """(component, member) of the first of each component's cliques (component, members)."""
    best = found.groupBy("component").agg(F.min(F.struct((-F.size("members")).alias("size"), "members")).alias("best"))
    return best.select("component", F.explode("best.members").alias("member"))


def _cliques_by_node(edges: DataFrame, least: int, at_once: int) -> DataFrame:
    """The cliques of components of any size.

    Nodes are put in an order in which each has few later neighbours. A clique lies among the later neighbours of its first node, so each
    node is a search of its own, of a size that the degeneracy bounds, whatever the component's. A first round takes one greedy clique
    per node; the second searches only nodes with enough later neighbours to match the best of their component.
    """
    ship(edges.sparkSession)
    order = peeled(edges, least, at_once)
    end = lambda name, n: order.select(F.col("node").alias(name), F.col("place").alias(n))
    first = F.col("a") < F.col("b")
    kept = edges.filter("src <> dst").join(end("src", "a"), "src").join(end("dst", "b"), "dst")
    first = first | ((F.col("a") == F.col("b")) & (F.col("src") < F.col("dst")))
    later = written(kept.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("v"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("u")).distinct(), "later")
    # Lists are as long as a node has later neighbours, at most.
    lists = later.groupBy(F.col("v").alias("u")).agg(F.sort_array(F.collect_list("u")).alias("to"))
    around = later.join(lists, "u", "left").join(components(later.select(F.col("v").alias("src"), F.col("u").alias("dst"))).select(F.col("node").alias("v"), "component"), "v")
    around = written(around.repartition("v").sortWithinPartitions("v", "u").select("component", "v", "u", "to"), "around")

    def found(batches, judge):
        """judge(component, v, its later neighbours, their later neighbours, wanted size) for each node; batches are in order of nodes."""
        v, rows, out = None, [], []
        for pdf in batches:
            for component, node, u, to, wanted in zip(pdf["component"], pdf["v"], pdf["u"], pdf["to"], pdf["wanted"]):
                if node != v:
                    out += [judge(*rows[0][:2], rows)] if rows else []
                    v, rows = node, []
                rows.append((component, node, u, to, wanted))
            yield pd.DataFrame([o for o in out if o], columns=["component", "members"])
            out = []
        yield pd.DataFrame([o for o in [judge(*rows[0][:2], rows)] if o] if rows else [], columns=["component", "members"])

    def greedy(component, v, rows):
        near = {u: set(() if to is None else to) for _, _, u, to, _ in rows}
        members, left = [v], set(near)
        while left:
            best = max(left, key=lambda u: (len(near[u] & left), -u))
            members.append(best)
            left = {u for u in left if u in near[best] or best in near[u]}
        return (component, sorted(members)) if len(members) >= least else None

    def search(component, v, rows):
        wanted = rows[0][4]
        near = {u: to for _, _, u, to, _ in rows}
        if len(near) + 1 < wanted:
            return None
        pairs = [(u, w) for u, to in near.items() if to is not None for w in to if w in near]
        members = largest_clique(pairs, wanted - 1) if wanted > 2 or pairs else [min(near)]
        return (component, sorted([v, *members])) if members else None

    # Batches must not be dealt anew: a node's rows follow each other in what was written.
    run = lambda rows, judge: rows.repartition("v").sortWithinPartitions("v", "u").mapInPandas(lambda batches: found(batches, judge), "component long, members array<long>")
    quick = written(run(around.withColumn("wanted", F.lit(least)), greedy), "greedy")
    known = quick.groupBy("component").agg(F.max(F.size("members")).alias("known"))
    # Without a greedy clique there may still be a larger one: the component is searched with the least size.
    counts = later.groupBy("v").agg(F.count("*").alias("n"))
    asked = around.join(known, "component", "left").withColumn("wanted", F.coalesce("known", F.lit(least))).join(counts, "v").filter("n + 1 >= wanted")
    every = written(run(asked.select("component", "v", "u", "to", "wanted"), search), "found")
    return _best(every)
