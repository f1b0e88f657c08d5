"""Removal of segments that lie on one another, in the order of their ids, with features handed to the one that stays.

In its turn, a segment that is still there looks at the nearest others that are still there, within a distance and in the order of
nearness. Of two seen at different times the older stays and gets the features of the newer; two tracks that saw the place within
``grace`` of each other both keep theirs. Of two seen at one time the one of more points stays, the other one among equals. A segment
that has to go ends its turn; one that is gone removes nothing.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravox.functions.geometry import AXES
from terravox.operators.pivots import nearest_join
from terravox.operators.reservations import leaders
from terravox.shared import written
from terravox.ship import ship

_ROW = ["item", "place", "cell", "n", "track", "sec", "gone", "features_of"]
_CHANGED = "cell long, gone boolean, features_of long"


def _turn(own: list, others: list[list], grace: float) -> None:
    """Changes the rows [cell, n, track, sec, gone, features_of] of a segment and of those near it."""
    if own[4]:
        return
    for other in others:
        if other[4]:
            continue
        if own[3] != other[3]:
            newer, older = (own, other) if own[3] > other[3] else (other, own)
            if own[2] != other[2] and newer[3] < older[3] + grace:
                continue
            newer[4], older[5] = True, newer[5]
        elif own[1] > other[1]:
            other[4] = True
        else:
            own[4] = True
        if own[4]:
            return


def _turns(grace: float, in_one: bool):
    """Takes the turns of a partition, its rows in the order of (item, place). in_one: the partition holds all turns, so changes last."""

    def run(batches):
        live: dict[int, list] = {}
        item, rows = None, []

        def act():
            held = [live.get(r[0]) or r for r in rows]
            _turn(held[0], held[1:], grace)
            for r in held:
                live[r[0]] = r

        def out():
            frame = pd.DataFrame([(r[0], r[4], r[5]) for r in live.values()], columns=["cell", "gone", "features_of"])
            return frame.astype({"cell": "int64", "gone": "bool", "features_of": "int64"})

        for pdf in batches:
            for at, _, *row in pdf[_ROW].itertuples(index=False, name=None):
                if at != item:
                    if rows:
                        act()
                    item, rows = at, []
                rows.append(row)
            if not in_one and live:
                yield out()
                live.clear()
        if rows:
            act()
        yield out()

    return run


def without_near(segments: DataFrame, apart: float, neighbours: int = 5, grace: float = 20.0, at_once: int = 100_000) -> DataFrame:
    """(segment, features_of): the segments that stay, and whose features each has now.

    segments: segment, n, track, sec, x, y, z, one row each; ``neighbours`` counts the segment itself. While more than ``at_once`` turns
    are open, those that cannot touch each other's segments are taken together; what is left is taken in one task. Both give the same.
    """
    ship(segments.sparkSession)
    slim = segments.select(F.col("segment").cast("long").alias("id"), F.array(*[F.col(a).cast("double") for a in AXES]).alias("vector"))
    near = nearest_join(slim, slim, neighbours - 1).neighbours.filter(F.col("d2") <= apart * apart)
    cells = near.select(F.col("query").alias("item"), F.col("rank").alias("place"), F.col("target").alias("cell"))
    cells = written(cells.unionByName(cells.select("item", F.lit(0).alias("place"), F.col("item").alias("cell")).distinct()), "turns")
    start = segments.select(F.col("segment").cast("long").alias("cell"), F.col("n").cast("long"), F.col("track").cast("long"), F.col("sec").cast("double"), F.lit(False).alias("gone"), F.col("segment").cast("long").alias("features_of"))
    state = written(start, "state")
    while True:
        n = cells.select("item").distinct().count()
        if not n:
            break
        in_one = n <= at_once
        now = cells.select("item") if in_one else written(leaders(cells.select("item", "cell")), "leaders")
        rows = (cells if in_one else cells.join(now, "item", "left_semi")).join(state, "cell").select(*_ROW)
        rows = (rows.repartition(1) if in_one else rows.repartition("item")).sortWithinPartitions("item", "place")
        changed = written(rows.mapInPandas(_turns(grace, in_one), _CHANGED), "changed").select("cell", F.col("gone").alias("now_gone"), F.col("features_of").alias("now_of"))
        state = written(state.join(changed, "cell", "left").select("cell", "n", "track", "sec", F.coalesce("now_gone", "gone").alias("gone"), F.coalesce("now_of", "features_of").alias("features_of")), "state")
        if in_one:
            break
        cells = written(cells.join(now, "item", "left_anti"), "turns")
    return state.filter("NOT gone").select(F.col("cell").alias("segment"), "features_of")


def near_sql(apart: float, neighbours: int = 5, grace: float = 20.0) -> str:
    """DuckDB common table expressions for d (segment, n, track, sec, x, y, z): turns in a recursion, last in ``told`` (gone, features)."""
    d2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in AXES)
    soon = f"a.track <> b.track AND greatest(a.sec, b.sec) < least(a.sec, b.sec) + {grace}"
    return f"""
pairs AS (SELECT a.segment s, b.segment o, CASE WHEN a.sec <> b.sec AND {soon} THEN 0 WHEN a.sec > b.sec THEN 1 WHEN a.sec < b.sec THEN 3 WHEN a.n > b.n THEN 4 ELSE 2 END v, row_number() OVER (PARTITION BY a.segment ORDER BY {d2}, b.segment) place
  FROM d a JOIN d b ON a.segment <> b.segment AND {' AND '.join(f'abs(a.{c} - b.{c}) <= {apart}' for c in AXES)} WHERE {d2} <= {apart * apart}),
turn AS MATERIALIZED (SELECT s, list({{'o': o, 'v': v}} ORDER BY place) l, row_number() OVER (ORDER BY s) i FROM pairs WHERE place < {neighbours} GROUP BY s),
told(i, gone, features) AS (SELECT 0::BIGINT, []::BIGINT[], MAP {{}}::MAP(BIGINT, BIGINT) UNION ALL
  SELECT i, CASE WHEN off THEN gone ELSE gone || list_transform(list_filter(before, lambda e: e.v IN (3, 4)), lambda e: e.o) || CASE WHEN p > 0 THEN [s] ELSE [] END END,
    CASE WHEN off THEN features ELSE map_concat(features, MAP {{s: mine}}, CASE WHEN p > 0 AND alive[p].v = 1 THEN MAP {{alive[p].o: mine}} ELSE MAP {{}}::MAP(BIGINT, BIGINT) END) END
  FROM (SELECT *, CASE WHEN len(given) > 0 THEN coalesce(features[given[-1].o], given[-1].o) ELSE coalesce(features[s], s) END mine
    FROM (SELECT *, list_filter(before, lambda e: e.v = 3) given FROM (SELECT *, CASE WHEN p > 0 THEN alive[1 : p - 1] ELSE alive END before
      FROM (SELECT *, coalesce(list_position(list_transform(alive, lambda e: e.v IN (1, 2)), true), 0) p FROM (
        SELECT turn.i, turn.s, told.gone, told.features, list_contains(told.gone, turn.s) off, list_filter(turn.l, lambda e: NOT list_contains(told.gone, e.o)) alive FROM told JOIN turn ON turn.i = told.i + 1))))))
"""
