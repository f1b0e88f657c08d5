"""The domain's inputs, read from Parquet tables.

Roles: ``lineitem`` rows are points of segments (one segment per part), ``events`` are points with identity, time and track,
``embeddings`` are segment descriptors with a class, and an event of a user is a pose of a robot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points without identity: (segment, view, x, y, z); adding 0.0 turns a negative zero into zero."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("segment"),
        F.col("l_linenumber").cast("long").alias("view"),
        F.col("l_orderkey").alias("batch"),
        F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 1999.7).alias("y"),
        ((F.col("l_discount") + F.lit(0.0)) * 100).alias("z"),
    )


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with identity: (pid, track, robot, sec, kind, x, y, z); sec counts whole seconds since 1970."""
    return points_of_events(table(spark, sf_dir, "events"))


def points_of_events(events: DataFrame) -> DataFrame:
    """The same for any frame of events, streaming ones as well."""
    ts = F.col("ts")
    return events.select(
        F.col("event_id").alias("pid"),
        F.pmod("user_id", F.lit(4)).cast("long").alias("track"),
        F.col("user_id").alias("robot"),
        (F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).alias("sec"),
        F.col("event_type").alias("kind"),
        (F.col("value") / 10).alias("x"),
        ((F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)) / 1800).alias("y"),
        F.pmod("user_id", F.lit(10)).cast("double").alias("z"),
    )


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, vector)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("vector"))


#: The same inputs as DuckDB common table expressions.
PTS_LI = "pts AS (SELECT l_partkey AS segment, CAST(l_linenumber AS BIGINT) AS view, l_orderkey AS batch, l_quantity AS x, l_extendedprice / 1999.7 AS y, (l_discount + 0.0) * 100 AS z FROM lineitem)"
PTS_EV = "pts AS (SELECT event_id AS pid, CAST(user_id % 4 AS BIGINT) AS track, user_id AS robot, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS sec, event_type AS kind, value / 10 AS x, (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 1800.0 AS y, CAST(user_id % 10 AS DOUBLE) AS z FROM events)"
