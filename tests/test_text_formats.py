import numpy as np
import pytest

from terravox.sources import clouds as C
from terravox.sources import text_formats as T
from terravox.ship import ship


def put(path, text):
    path.write_text(text)
    return str(path)


def test_segments_in_runs(spark, tmp_path):
    path = put(tmp_path / "s.csv", "7 0 1 2 3 \n7 0 4 5 6\n8 0 0 0 0\n7 0 9 9 9\n")
    rows = T.read_segments(spark, path).orderBy("line").drop("line").collect()
    assert [tuple(r) for r in rows] == [(7, 0, 1, 2, 3), (7, 0, 4, 5, 6), (8, 0, 0, 0, 0)]
    with pytest.raises(ValueError):
        T.read_segments(spark, path, repeated="error")


def test_positions_may_be_missing(spark, tmp_path):
    assert T.read_positions(spark, str(tmp_path / "none.csv")).count() == 0


def test_features_round_trip(spark, tmp_path):
    path = put(tmp_path / "f.csv", "1 0 linearity 0.5 size 3\n2 1\n")
    rows = T.read_features(spark, path)
    T.write_features(rows.filter("size(features) > 0"), str(tmp_path / "out"))
    again = T.read_features(spark, str(tmp_path / "out")).collect()
    assert [(r["segment_id"], [tuple(f) for f in r["features"]]) for r in again] == [(1, [("linearity", 0.5), ("size", 3.0)])]
    assert sorted(r["segment_id"] for r in rows.collect()) == [1, 2]


def test_ragged_matches(spark, tmp_path):
    rows = T.read_matches(spark, put(tmp_path / "m.csv", "1.0 2.0\n3 4 5\n")).orderBy("line").collect()
    assert [r["ids"] for r in rows] == [[1, 2], [3, 4, 5]]


@pytest.mark.parametrize("blocks", [None, 600])
def test_runs_across_splits(spark, tmp_path, blocks):
    """However a file is split among tasks, a run that crosses the cut is one, and a later one of the same key is another."""
    ids = [7] * 50 + [8] * 10 + [9] * 220 + [7] * 30 + [8] * 20 + [10] * 90 + [9]
    path = put(tmp_path / "s.csv", "\n".join(f"{i} 0 {n} 0 0" for n, i in enumerate(ids)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(blocks) if blocks else before)
    try:
        got = sorted((r["segment_id"], int(r["x"])) for r in T.read_segments(spark, path).collect())
        raw = spark.read.text(path).selectExpr("_metadata.file_path file", "_metadata.file_block_start block", "monotonically_increasing_id() line", "cast(split(value, ' ')[0] as int) id")
        runs = [r["run"] for r in T.numbered_runs(raw, ["id"], ["file", "block"], "line").orderBy("file", "block", "line").collect()]
        if blocks:
            assert raw.select("block").distinct().count() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [1] * 50 + [2] * 10 + [3] * 220 + [4] * 30 + [5] * 20 + [6] * 90 + [7]
    assert runs == want
    first = {i: w for i, w in reversed(list(zip(ids, want)))}
    assert got == sorted((i, n) for n, (i, w) in enumerate(zip(ids, want)) if w == first[i])


def cloud(spark):
    ship(spark)
    spark.dataSource.register(C.PointCloud)
    return spark.read.format("pcd")


def test_ascii_cloud_in_ranges(spark, tmp_path):
    path = put(tmp_path / "c.pcd", "# made\nVERSION 0.7\nFIELDS x y id\nSIZE 4 8 8\nTYPE F F I\nCOUNT 1 1 1\nPOINTS 40\nDATA ascii\n" + "".join(f"{i}.5 nan {2**60 + i}\n" for i in range(40)))
    for size in (1, 7, 60, 1 << 20):
        rows = cloud(spark).option("bytes", size).load(path)
        assert rows.dtypes == [("x", "float"), ("y", "double"), ("id", "bigint")] and rows.rdd.getNumPartitions() >= min(40, 900 // size)
        assert sorted((r["id"], r["x"]) for r in rows.collect()) == [(2**60 + i, i + 0.5) for i in range(40)]


def test_binary_cloud_in_ranges(spark, tmp_path):
    """All kinds of numbers, a field of two values, rows dealt to tasks; columns that are not wanted are not made."""
    kinds = {"a": "<f4", "b": "<f8", "c": "<i1", "d": "<u1", "e": "<i2", "f": "<u2", "g": "<i4", "h": "<u4", "i": "<i8", "j": "<u8", "k_0": "<f4", "k_1": "<f4"}
    r = np.random.default_rng(1)
    rows = np.zeros(1000, list(kinds.items()))
    for n, k in kinds.items():
        rows[n] = r.standard_normal(1000) if "f" in k else r.integers(*((0, 2**7) if k[2] == "1" else (0, 2 ** (8 * int(k[2]) - 1))), 1000)
    rows["j"][0] = 2**64 - 1
    head = "VERSION 0.7\nFIELDS a b c d e f g h i j k\nSIZE 4 8 1 1 2 2 4 4 8 8 4\nTYPE F F I U I U I U I U F\nCOUNT 1 1 1 1 1 1 1 1 1 1 2\nWIDTH 500\nHEIGHT 2\nDATA "
    plain = tmp_path / "b.pcd"
    plain.write_bytes(head.encode() + b"binary\n" + rows.tobytes())
    body = b"".join(np.ascontiguousarray(rows[n]).tobytes() for n in kinds)
    tight = tmp_path / "c.pcd"
    small = C.packed(body)
    tight.write_bytes(head.encode() + b"binary_compressed\n" + np.array([len(small), len(body)], "<u4").tobytes() + small)
    want = sorted(zip(*(rows[n].tolist() for n in kinds)))
    for path, many in ((plain, 8), (tight, 1)):
        got = cloud(spark).option("rows", 130).load(str(path))
        assert got.columns == list(kinds) and got.rdd.getNumPartitions() == many
        assert sorted(tuple(int(v) if n == "j" else v for n, v in zip(kinds, g)) for g in got.collect()) == want
    assert got.select("h").agg({"h": "sum"}).first()[0] == int(rows["h"].astype(object).sum())
    plain.write_bytes(plain.read_bytes()[:-1])
    with pytest.raises(Exception, match="999 points of 1000"):
        cloud(spark).load(str(plain)).count()


@pytest.mark.parametrize("data", ["binary", "ascii", "compressed"])
def test_cloud_written_in_one_commit(spark, tmp_path, data):
    """One file of one header, whatever the number of tasks; nothing is left beside it, not even when a task fails."""
    points = spark.createDataFrame([(float(i) / 3, -1e-7, i, 2**40 + i) for i in range(500)], "x double, y float, id int, far long").repartition(5)
    path = tmp_path / "out.pcd"
    cloud(spark)
    for _ in range(2):
        points.write.format("pcd").option("data", data).mode("overwrite").save(str(path))
    assert [p.name for p in tmp_path.iterdir()] == ["out.pcd"]
    assert sorted(map(tuple, cloud(spark).load(str(path)).collect())) == sorted(map(tuple, points.collect()))
    kept = path.read_bytes()
    broken = points.selectExpr("x", "y", "CASE WHEN id = 77 THEN raise_error('lost')::int ELSE id END id", "far")
    with pytest.raises(Exception, match="lost"):
        broken.write.format("pcd").option("data", data).mode("overwrite").save(str(path))
    assert path.read_bytes() == kept and [p.name for p in tmp_path.iterdir()] == ["out.pcd"]


@pytest.mark.parametrize("seed", range(5))
def test_packed_bytes_come_back(seed):
    r = np.random.default_rng(seed)
    for data in (b"", b"a", b"ab" * 5000, bytes(r.integers(0, 256, 3000, dtype=np.uint8)), bytes(r.integers(0, 3, 20_000, dtype=np.uint8)), b"x" * 100_000, bytes(range(256)) * 40):
        assert C.unpacked(C.packed(data), len(data)) == data
    assert C.unpacked(bytes([2]) + b"abc" + bytes([7 << 5, 1, 2]), 13) == b"abcabcabcabca"


def test_classes_and_trajectory(spark, tmp_path):
    rows = T.read_classes(spark, put(tmp_path / "c.csv", "1 2 \n3 4.5 x\n")).orderBy("line").collect()
    assert [(r["segment_id"], r["classes"]) for r in rows] == [(1, [2.0]), (3, [4.5, None])]
    T.write_classes(T.read_classes(spark, str(tmp_path / "c.csv")).limit(1), str(tmp_path / "cc"))
    assert T.read_classes(spark, str(tmp_path / "cc")).first()["classes"] == [2.0]
    path = put(tmp_path / "t.csv", "time, x, y\n1, 2.5, 3\n4,5,6\n")
    assert [r["values"] for r in T.read_trajectory(spark, path, header=True).orderBy("line").collect()] == [[1.0, 2.5, 3.0], [4.0, 5.0, 6.0]]
    assert T.read_trajectory(spark, path).count() == 3


def test_session_round_trip(spark, tmp_path):
    points = spark.createDataFrame([(1, 0, 0.0, 1.0, 2.0), (1, 1, 3.0, 4.0, 5.0), (2, 0, 6.0, 7.0, 8.0)], "segment_id long, view_id int, x double, y double, z double")
    places = points.withColumnsRenamed({"x": "px", "y": "py", "z": "pz"})
    features = spark.createDataFrame([(1, 1, [("a", 0.5)])], "segment_id long, view_id int, features array<struct<name: string, value: double>>")
    merges = spark.createDataFrame([(10, 2, 1)], "timestamp_ns long, id_before long, id_after long")
    matches = spark.createDataFrame([([1, 2, 3],)], "ids array<long>")
    T.write_session(points, places, features, merges, matches, str(tmp_path / "s"))
    back = T.read_session(spark, str(tmp_path / "s"))
    plain = lambda df: sorted(map(tuple, df.drop("line").collect()))
    assert plain(back["segments"]) == plain(points) and plain(back["positions"]) == plain(places)
    assert plain(back["merge_events"]) == [(10, 2, 1)] and plain(back["matches"]) == [([1, 2, 3],)]
    T.write_segments(points, str(tmp_path / "last"))
    assert sorted(tuple(r["cells"]) for r in T.lines(spark, str(tmp_path / "last")).collect()) == [("1", "3.0", "4.0", "5.0"), ("2", "6.0", "7.0", "8.0")]
    T.write_timestamps(points.selectExpr("segment_id", "view_id", "cast(7 as long) timestamp_ns"), str(tmp_path / "times"), all_views=True)
    assert T.read_timestamps(spark, str(tmp_path / "times")).count() == 3


def test_features_join_their_segments(spark):
    kind = "segment_id long, view_id int, features array<struct<name: string, value: double>>"
    held = spark.createDataFrame([(1, 0, [("a", 1.0)]), (2, 0, None)], kind)
    read = spark.createDataFrame([(1, 0, [("b", 2.0)]), (9, 0, [("c", 3.0)])], kind)
    names = lambda df: {r["segment_id"]: [f["name"] for f in r["features"] or []] for r in df.collect()}
    assert names(T.joined_features(held, read)) == {1: ["a", "b"], 2: []}
    assert names(T.joined_features(held, read, how="replace")) == {1: ["b"], 2: []}
    with pytest.raises(ValueError):
        T.joined_features(held, read, missing="abort")


def test_clouds_written_and_read(spark, tmp_path):
    points = spark.createDataFrame([(float(i), -1e-7, 2.5) for i in range(50)], "x double, y double, z double").repartition(3)
    T.write_cloud(points, str(tmp_path / "cloud"))
    assert sorted(map(tuple, T.read_cloud(spark, str(tmp_path / "cloud")).collect())) == sorted(map(tuple, points.collect()))
    path = put(tmp_path / "a12.pcd", "VERSION 0.7\nFIELDS x y z label\nPOINTS 2\nDATA ascii\n1 2 3 9\n4 5 6 nan\n")
    assert T.read_cloud(spark, path).columns == ["x", "y", "z", "label"] and T.read_cloud(spark, path).count() == 2
    put(tmp_path / "DON_b3.pcd", "FIELDS x y z\nDATA ascii\n7 8 9\n")
    assert [tuple(r) for r in T.read_labelled_clouds(spark, str(tmp_path)).filter("x = 1").collect()] == [("a", 12, 1.0, 2.0, 3.0)]
    assert [tuple(r) for r in T.read_labelled_clouds(spark, str(tmp_path), r"DON_([ab])(\d+)\.pcd$").collect()] == [("b", 3, 7.0, 8.0, 9.0)]
    with pytest.raises(ValueError):
        T.read_cloud(spark, put(tmp_path / "x.pcd", "FIELDS x y z\nDATA binary\n"))
