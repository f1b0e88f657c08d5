"""Order-dependent steps on disjoint footprints: what a loop would do in turn, in rounds.

Each open item, in the order of its number, would read and change the cells of its footprint. Items whose footprints are disjoint
commute, so in each round all items act that hold the earliest claim on every one of their cells. No earlier item that is still open touches
what they touch, so the rounds give exactly what the loop gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def leaders(claims: DataFrame) -> DataFrame:
    """(item): the items of (item, cell) that come first on each of their cells."""
    first = claims.groupBy("cell").agg(F.min("item").alias("first"))
    held = claims.join(first, "cell").groupBy("item").agg(F.min(F.col("first") == F.col("item")).alias("ok"))
    return held.filter("ok").select("item")
