"""Streams of points: voxel state and the gate that lets a pose pass.

Each runs with ``availableNow`` over files of a folder, so a batch of files drives it to the end; sinks are written per
batch id, which makes a replayed batch overwrite itself.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravox.shared import shared_dir
from terravox.ship import ship


def points_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """The table ``name`` of a folder (a file, or a folder of files) as a stream of rows; files_per_batch bounds a micro-batch."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder}/{name}.parquet*")


def finish(writer, path: str) -> None:
    """Runs a stream over all that there is."""
    query = writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def voxel_state(points: DataFrame, size: float) -> DataFrame:
    """Counts and sums per voxel after all batches.

    State lives in Spark's store. Each batch writes the voxels it changed under its own number, so a batch that runs again overwrites
    itself; the state is the row of the largest number of each voxel.
    """
    spark = points.sparkSession
    path = shared_dir(spark, "voxel-stream")
    cell = [F.floor(F.col(a) / size).cast("long").alias(f"i{a}") for a in "xyz"]
    state = points.groupBy(*cell).agg(F.count("*").alias("n"), *[F.sum(a).alias(f"s{a}") for a in "xyz"])

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/voxels/version={number}")

    # An empty version, so that the table exists whatever comes.
    spark.createDataFrame([], state.schema).write.parquet(f"{path}/voxels/version=-1")
    finish(state.writeStream.outputMode("update").foreachBatch(put), path)
    every = spark.read.option("basePath", f"{path}/voxels").schema(state.schema.add("version", "long")).parquet(f"{path}/voxels")
    last = every.groupBy("ix", "iy", "iz").agg(F.max_by(F.struct("n", "sx", "sy", "sz"), "version").alias("v"))
    return last.select("ix", "iy", "iz", "v.*")


def gate(poses: DataFrame, apart: float) -> DataFrame:
    """Poses more than ``apart`` along x from the last accepted one of their robot; poses: robot, sec, pid, x.

    The state of a robot is one number; within a batch its poses are taken in time order.
    """
    spark = ship(poses.sparkSession)
    path = shared_dir(spark, "gate-stream")

    def step(key, batches, state):
        rows = pd.concat(list(batches)).sort_values(["sec", "pid"])
        last = state.get[0] if state.exists else None
        kept = []
        for pid, x in zip(rows["pid"], rows["x"]):
            if last is None or abs(x - last) > apart:
                kept.append(pid)
                last = x
        state.update((last,))
        yield pd.DataFrame({"robot": [key[0]] * len(kept), "pid": kept}).astype("int64")

    passed = poses.groupBy("robot").applyInPandasWithState(step, "robot long, pid long", "last double", "append", "NoTimeout")
    finish(passed.writeStream.outputMode("append").format("parquet").option("path", f"{path}/passed"), path)
    return spark.read.schema("robot long, pid long").parquet(f"{path}/passed")
