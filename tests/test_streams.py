"""Streams of several micro-batches against the same rows at once."""

import duckdb
import pytest
from pyspark.sql import functions as F

from terravox.plans import window_plans
from terravox.shared import shared_dir
from terravox.sources.tables import event_points, points_of_events
from terravox.operators.folds import accepted
from terravox.operators.voxels import voxels
from terravox.streaming.streams import gate, points_stream, voxel_state
from terravox.streaming.window import sliding_window, snapshot


def test_state_merges_over_batches(spark, tmp_path):
    """Five micro-batches: voxels add up, and the gate remembers the last pose it let pass."""
    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id").coalesce(1)
    for i in range(5):
        events.filter(f"event_id % 1000 >= {200 * i} AND event_id % 1000 < {200 * i + 200}").write.mode("append").parquet(str(tmp_path / "events.parquet"))
    stream = lambda: points_of_events(points_stream(spark, str(tmp_path), "events", files_per_batch=1))
    points = event_points(spark, sf)
    key = lambda df: sorted((r["ix"], r["iy"], r["iz"], r["n"], round(r["sx"], 6)) for r in df.collect())
    assert key(voxel_state(stream(), 1.0)) == key(voxels(points, 1.0))
    passed = gate(stream().select("robot", "sec", "pid", "x"), 10.0)
    want = accepted(points.select("robot", "sec", "pid", "x"), "robot", ["sec", "pid"], "x", lambda x, last: abs(x - last) > 10).select("robot", "pid")
    assert sorted(map(tuple, passed.collect())) == sorted(map(tuple, want.collect()))


def plain(rows):
    return sorted(tuple(r[c] for c in sorted(r.asDict())) for r in rows)


def of_sql(path, query):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    frame = con.execute(query).fetch_df()
    return sorted(map(tuple, frame[sorted(frame.columns)].itertuples(index=False)))


def test_window_goes_on_from_its_checkpoint(spark, tmp_path):
    """Micro-batches of ten days each; the stream stops after two, and a new one takes up its state. Each state is what SQL finds in the files so far."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    path, folder = shared_dir(spark, "window-test"), str(tmp_path)
    add = lambda lo: events.filter(f"day(ts) > {lo} AND day(ts) <= {lo + 10}").coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    rounded = lambda state: state.select("robot", "sector", "ix", "iy", "iz", "n", *[F.round(F.col(f"s{a}") / F.col("n") + window_plans.TIE, 4).alias(f"c{a}") for a in "xyz"])
    add(0)
    add(10)
    checkpoint = window_plans.windows(spark, folder, 1, path)[1]
    first_two = of_sql(folder, window_plans.WINDOW_STATE)
    assert plain(rounded(snapshot(spark, checkpoint)).collect()) == first_two
    add(20)
    add(30)
    moves, checkpoint = window_plans.windows(spark, folder, 1, path)
    assert plain(moves.select(*window_plans._rounded(moves, moves.columns)).collect()) == of_sql(folder, window_plans.STREAM_WINDOW)
    assert plain(rounded(snapshot(spark, checkpoint)).collect()) == of_sql(folder, window_plans.WINDOW_STATE)
    # The state as it stood after the second micro-batch can still be read.
    assert plain(rounded(snapshot(spark, checkpoint, 1)).collect()) == first_two


def test_window_on_known_points(spark, tmp_path):
    """A voxel fills over two steps, leaves when the pose moves on and comes back empty; what comes late enters with the next step."""
    schema = "robot long, step long, at long, pose boolean, x double, y double, z double"
    batches = [
        [(1, 1, 0, True, 0.0, 0.0, 0.0), (1, 1, 1, False, 0.2, 0.2, 0.2), (1, 1, 2, False, 5.1, 0.5, 0.5), (1, 1, 3, False, 5.3, 0.5, 0.5)],
        [(1, 2, 0, True, 1.0, 0.0, 0.0), (1, 2, 1, False, 0.4, 0.4, 0.4), (1, 2, 9, True, 2.0, 0.0, 0.0), (1, 3, 0, True, 8.0, 0.0, 0.0)],
        [(1, 2, 0, False, 7.5, 0.5, 0.5), (1, 1, 7, True, 0.0, 0.0, 0.0), (1, 4, 0, True, 8.0, 0.0, 0.0), (1, 4, 1, False, 7.5, 0.5, 0.5), (1, 4, 2, False, 0.4, 0.4, 0.4)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "scans"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "scans"))
    moves, checkpoint = sliding_window(stream, 1.0, 2, 4.0, -2.0, 2.0, sectors=1)
    got = sorted((r["step"], r["ix"], r["old_place"], r["new_place"], r["n"]) for r in moves.collect())
    assert got == [(1, 5, -1, 0, 2), (2, 0, -1, 0, 2), (2, 5, 0, 1, 2), (3, 0, 0, -1, 2), (3, 5, 1, 0, 2), (4, 5, 0, 0, 2), (4, 7, -1, 1, 2)]
    held = {r["ix"]: (r["n"], r["sx"]) for r in snapshot(spark, checkpoint).collect()}
    assert held == {0: (1, 0.4), 5: (2, pytest.approx(10.4)), 7: (2, 15.0)}


def test_windows_share_calls_into_python(spark):
    # 200 windows, and not a call for each: every bucket of windows is one.
    calls = spark.range(100).selectExpr("id AS robot", "1L AS step", "id AS at", "explode(array(true, false)) AS pose", "1.0D AS x", "2.0D AS y", "0.0D AS z")
    folder = shared_dir(spark, "scans")
    calls.write.parquet(folder)
    stream = spark.readStream.schema(calls.schema).parquet(folder)
    moves, checkpoint = sliding_window(stream, 1.0, 1, 4.0, -2.0, 2.0, sectors=2, buckets=3)
    assert moves.count() == 100 and {(r["n"], r["new_place"]) for r in moves.collect()} == {(1, 0)}
    assert snapshot(spark, checkpoint).count() == 100
    state = spark.read.format("statestore").option("stateVarName", "voxels").load(checkpoint)
    assert state.select("key.*").distinct().count() <= 3
