"""Ordered folds: filters that compare a row with the last one accepted, and running sums over a global order."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terravox.shared import free, written
from terravox.ship import ship


def accepted(rows: DataFrame, key: str, order: list[str], value: str, accept: Callable[[float, float], bool]) -> DataFrame:
    """Rows of each key, in order, for which accept(value, last accepted value) holds; the first always does.

    Keys are dealt out and sorted by Spark; a task streams them batch by batch and holds one number, so a key may be of any size.
    """
    ship(rows.sparkSession)
    columns = rows.columns

    def run(batches):
        at = last = None
        for pdf in batches:
            keep = []
            for k, v in zip(pdf[key], pdf[value]):
                ok = k != at or accept(v, last)
                at = k
                if ok:
                    last = v
                keep.append(ok)
            yield pdf[pd.Series(keep, index=pdf.index, dtype=bool)][columns]

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, rows.schema)


def running(rows: DataFrame, order: list[str], **sums) -> DataFrame:
    """rows with running sums in a global order, name=column, without gathering them in one task.

    Rows are dealt by ranges of the order and written; only one total per range is added up in one place. A column of rows
    that has the name of a sum gives way to it.
    """
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in sums]
    part, *own = free(rows, "part", *[f"own_{name}" for name in sums])
    before = free(rows, *[f"before_{name}" for name in sums])
    parts = rows.withColumns({o: value for o, value in zip(own, sums.values())}).repartitionByRange(*order)
    dealt = written(parts.withColumn(part, F.spark_partition_id()), "ordered")
    upto = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(part).agg(*[F.sum(o).alias(o) for o in own])
    totals = totals.select(part, *[F.coalesce(F.sum(o).over(earlier), F.lit(0)).alias(b) for o, b in zip(own, before)])
    inside = dealt.select(*kept, part, *[F.sum(o).over(upto).alias(o) for o in own])
    return inside.join(F.broadcast(totals), part).select(*kept, *[(F.col(o) + F.col(b)).alias(name) for o, b, name in zip(own, before, sums)])


def numbered(rows: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """rows with their place, from 1, in a global order that ends in a unique column."""
    return running(rows, order, **{name: F.lit(1).cast("long")})
