"""The sliding window around a moving robot as keyed state: voxels that come, fill and leave as poses arrive.

A step of a robot is a pose and the points scanned there; of several poses that of the largest ``at`` counts. First the voxels whose centroid lies outside the cylinder around the new pose
leave, then the points enter; a voxel is active once it holds ``least`` points. State is a map from voxel to count and sums per robot and
sector, kept by ``transformWithState``; sectors are an arithmetic hash of the voxel, so a robot's window is the work of as many
tasks, and each of its poses (one row per scan) goes to all of them. A call into Python costs more than most windows, so the state's key is
a bucket of windows, by a hash of robot and sector. A window is bounded by the cylinder, and a batch's rows are added up frame by frame,
so a task holds the voxels of a bucket, never points.

Rows of a step that a window has passed are late: late points enter with the next step of their window, late poses count for nothing.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from terravox.shared import shared_dir
from terravox.ship import ship
from terravox.streaming.streams import finish

CELL = "ix long, iy long, iz long"
WINDOW = ["robot", "sector"]
MOVES = f"robot long, sector long, step long, {CELL}, old_place long, new_place long, n long, cx double, cy double, cz double"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# The process that sets a processor up does not get Spark's Python files, so what it runs is sent whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@contextmanager
def on_disk_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, on the executors' disks; the session's own choice comes back afterwards."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


class Window(StatefulProcessor):
    """The voxels of a bucket of windows, each the part of a robot's window that lies in one sector."""

    def __init__(self, size: float, least: int, radius: float, low: float, high: float):
        self.size, self.least, self.radius, self.low, self.high = size, least, radius, low, high

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "robot long, sector long, step long")
        self.voxels = handle.getMapState("voxels", f"robot long, sector long, {CELL}", "n long, sx double, sy double, sz double")

    def _sums(self, frames: Iterator[pd.DataFrame], last: dict):
        """Per window: poses by step, count and sums of each voxel by step, and those of late points, added up frame by frame."""
        poses, points, passed = {}, {}, {}
        for frame in frames:
            late = [(w := last.get((r, c))) is not None and step <= w for r, c, step in zip(frame["robot"], frame["sector"], frame["step"])] if last else False
            frame = frame.assign(late=late)
            here = frame[frame["pose"] & ~frame["late"]].sort_values(["at", "x", "y", "z"]).drop_duplicates([*WINDOW, "step"], keep="last")
            for robot, c, step, *pose in here[[*WINDOW, "step", "at", "x", "y", "z"]].itertuples(index=False, name=None):
                held = poses.setdefault((robot, c), {})
                held[step] = max(held.get(step, pose), pose)
            scans = frame[~frame["pose"]]
            if not len(scans):
                continue
            cells = {f"i{a}": (scans[a] // self.size).astype("int64") for a in "xyz"}
            scans = scans.assign(step=scans["step"].where(~scans["late"], 0), n=1, **cells)
            found = scans.groupby([*WINDOW, "late", "step", "ix", "iy", "iz"], as_index=False)[["n", "x", "y", "z"]].sum()
            for robot, c, is_late, step, ix, iy, iz, *row in found.itertuples(index=False, name=None):
                cells = passed.setdefault((robot, c), {}) if is_late else points.setdefault((robot, c), {}).setdefault(step, {})
                held = cells.setdefault((ix, iy, iz), [0, 0.0, 0.0, 0.0])
                for i, v in enumerate(row):
                    held[i] += v
        return poses, points, passed

    def _inside(self, v, pose) -> bool:
        x, y, z = (s / v[0] for s in v[1:])
        _, px, py, pz = pose
        return (x - px) ** 2 + (y - py) ** 2 <= self.radius**2 and self.low <= z - pz <= self.high

    def _moves(self, window, held, poses, points, late, last) -> Iterator[tuple]:
        """Takes the steps of one window, changing what is held; yields rows of moves."""
        for step in sorted({*poses, *points} | ({last} if late and not poses and not points else set())):
            placed = {cell: i for i, cell in enumerate(sorted(c for c, v in held.items() if v[0] >= self.least))}
            gone = {}
            if step in poses:
                gone = {c: v for c, v in held.items() if not self._inside(v, poses[step])}
                for cell in gone:
                    del held[cell]
            for fresh in (late, points.get(step, {})):
                for cell, add in fresh.items():
                    held[cell] = [a + b for a, b in zip(held[cell], add)] if cell in held else list(add)
            late = {}
            now = {cell: i for i, cell in enumerate(sorted(c for c, v in held.items() if v[0] >= self.least))}
            for cell in sorted({*placed, *now}):
                n, *sums = held[cell] if cell in now else gone.get(cell, held.get(cell))
                yield (*window, step, *cell, placed.get(cell, -1), now.get(cell, -1), int(n), *(s / n for s in sums))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in MOVES.split(", ")]
        last = {(robot, c): step for robot, c, step in self.last.get()} if self.last.exists() else {}
        poses, points, late = self._sums(rows, last)
        every, out = {}, []
        for (robot, c, *cell), v in self.voxels.iterator():
            every.setdefault((robot, c), {})[tuple(cell)] = list(v)
        for window in sorted({*poses, *points, *late}):
            held = every.get(window, {})
            before = {cell: list(v) for cell, v in held.items()}
            mine = poses.get(window, {}), points.get(window, {})
            out += self._moves(window, held, *mine, late.get(window, {}), last.get(window))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
            for cell in before.keys() - held.keys():
                self.voxels.removeKey((*window, *cell))
            for cell, (n, *sums) in held.items():
                if before.get(cell) != held[cell]:
                    self.voxels.updateValue((*window, *cell), (int(n), *map(float, sums)))
            if mine[0] or mine[1]:
                last[window] = max([*mine[0], *mine[1]])
        if out:
            yield pd.DataFrame(out, columns=names)
        if last:
            self.last.put([(int(robot), int(c), int(step)) for (robot, c), step in last.items()])

    def close(self) -> None:
        pass


def sector(sectors: int):
    """Which part of a robot's window a voxel belongs to."""
    return F.pmod(F.col("ix") * 7 + F.col("iy") * 13 + F.col("iz") * 29, F.lit(sectors))


def sliding_window(scans: DataFrame, size: float, least: int, radius: float, low: float, high: float, sectors: int = 8, path: str | None = None, buckets: int = 512) -> tuple[DataFrame, str]:
    """What each step did to the active voxels, and the folder of the stream's checkpoint.

    scans, a stream: robot, step, at, pose (a pose, or else a point), x, y, z. Rows of the result: voxels active before or after a step, with
    their places among the sector's active ones before and after it (-1: not there), and count and centroid; of a voxel that left, the last.

    A stream that is given the ``path`` of an earlier one goes on where that one stopped; ``buckets`` must stay what it was. Points without a place are in no voxel.
    """
    spark = ship(scans.sparkSession)
    path = path or shared_dir(spark, "window-stream")
    cells = scans.withColumns({f"i{a}": F.floor(F.col(a) / size).cast("long") for a in "xyz"})
    all_of = F.sequence(F.lit(0).cast("long"), F.lit(sectors - 1).cast("long"))
    dealt = cells.withColumn("sector", F.explode(F.when(F.col("pose"), all_of).otherwise(F.array(sector(sectors)))))
    bucket = F.pmod(F.xxhash64(*WINDOW), F.lit(buckets)).alias("bucket")
    keyed = dealt.filter("sector IS NOT NULL").select(bucket, *WINDOW, "step", "at", "pose", "x", "y", "z").groupBy("bucket")
    moves = keyed.transformWithStateInPandas(Window(size, least, radius, low, high), MOVES, "append", "none")
    with on_disk_state(spark):
        finish(moves.writeStream.outputMode("append").format("parquet").option("path", f"{path}/moves"), path)
    return spark.read.schema(MOVES).parquet(f"{path}/moves"), f"{path}/checkpoint"


def snapshot(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """(robot, sector, ix, iy, iz, n, sx, sy, sz): the voxels of all windows as the state stood after a batch, the last one if none is named."""
    reader = spark.read.format("statestore").option("stateVarName", "voxels")
    if batch is not None:
        reader = reader.option("batchId", batch)
    state = reader.load(checkpoint)
    return state.select("user_map_key.*", "user_map_value.*")
