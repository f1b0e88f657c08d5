"""Readers and writers of the space-separated text tables and of ASCII point clouds.

Lines are numbered in file order, since runs of equal ids and "first one wins" depend on it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from terravox.shared import written
from terravox.ship import ship


def lines(spark: SparkSession, path: str, drop_first_row: bool = False) -> DataFrame:
    """(line, cells): the cells of each non-empty line; line increases in file order."""
    raw = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"\s+").alias("cells")).filter("cells[0] <> ''")
    if drop_first_row:
        first = raw.agg(F.min("line")).first()[0]
        raw = raw.filter(F.col("line") > (first if first is not None else -1))
    return raw


def _cell(i: int, kind: str) -> Column:
    return F.expr(f"try_cast(cells[{i}] AS {kind})")


def _columns(found: DataFrame, spec: list[tuple[str, str]]) -> DataFrame:
    return found.select("line", *[_cell(i, kind).alias(name) for i, (name, kind) in enumerate(spec)])


def numbered_runs(rows: DataFrame, keys: list[str], split: list[str], order: str) -> DataFrame:
    """rows with ``run``, which counts runs of equal keys in the order of (split, order), and grows by one where a key changes.

    rows come as they were read: the rows of a split in their order, in one task. Runs are counted inside each split without a shuffle; of a
    split only its first and last key and its number of runs go on, and a scan over splits says where each goes on counting.
    """
    ship(rows.sparkSession)

    def count(batches):
        at = last = None
        n = 0
        for batch in batches:
            runs = []
            for here, key in zip(zip(*(batch.column(c).to_pylist() for c in split)), zip(*(batch.column(c).to_pylist() for c in keys))):
                n = 1 if here != at else n if key == last else n + 1
                at, last = here, key
                runs.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs, pa.int64())], names=[*batch.schema.names, "inner"])

    inside = written(rows.mapInArrow(count, StructType([*rows.schema.fields, StructField("inner", LongType())])), "runs")
    key = F.struct(*keys)
    ends = inside.groupBy(*split).agg(F.min_by(key, order).alias("head"), F.max_by(key, order).alias("tail"), F.max("inner").alias("many"))
    # One row per split.
    every = Window.orderBy(*split)
    joins = F.coalesce(F.col("head").eqNullSafe(F.lag("tail").over(every)) & F.lag("many").over(every).isNotNull(), F.lit(False)).cast("int")
    new = ends.withColumn("joins", joins).withColumn("upto", F.sum(F.col("many") - F.col("joins")).over(every.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    offset = new.select(*split, (F.col("upto") - F.col("many")).alias("offset"))
    return inside.join(offset, split).withColumn("run", F.col("inner") + F.col("offset")).drop("inner", "offset")


def read_segments(spark: SparkSession, path: str, views: bool = True, repeated: str = "first") -> DataFrame:
    """(segment_id, view_id, x, y, z, line) in runs of equal (id, view).

    repeated: "first" keeps the first run of an id and view, "error" raises where there is a second one. Files are taken in the order of their names.
    """
    spec = [("segment_id", "bigint"), *([("view_id", "int")] if views else []), ("x", "double"), ("y", "double"), ("z", "double")]
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"\s+").alias("cells"))
    rows = raw.filter("cells[0] <> ''").select("file", "block", "line", *[_cell(i, kind).alias(name) for i, (name, kind) in enumerate(spec)])
    if not views:
        rows = rows.withColumn("view_id", F.lit(0))
    runs = written(numbered_runs(rows, ["segment_id", "view_id"], ["file", "block"], "line"), "segments")
    first = runs.groupBy("segment_id", "view_id").agg(F.min("run").alias("first_run"), F.max("run").alias("last_run"))
    if repeated == "error" and not first.filter("first_run < last_run").isEmpty():
        raise ValueError(f"{path}: a segment and view occur in two runs")
    kept = runs.join(first.select(F.col("segment_id").alias("s"), F.col("view_id").alias("v"), "first_run"), F.col("segment_id").eqNullSafe(F.col("s")) & F.col("view_id").eqNullSafe(F.col("v"))).filter("run = first_run")
    return kept.select("segment_id", "view_id", "x", "y", "z", "line")


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """(segment_id, view_id, px, py, pz); a missing file is an empty table."""
    spec = [("segment_id", "bigint"), ("view_id", "int"), ("px", "double"), ("py", "double"), ("pz", "double")]
    try:
        return _columns(lines(spark, path), spec).drop("line")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], ", ".join(f"{n} {k}" for n, k in spec))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(segment_id, view_id, features): name and value pairs of each line, in order."""
    pairs = F.transform(F.sequence(F.lit(2), F.size("cells") - 2, F.lit(2)), lambda i: F.struct(F.col("cells")[i].alias("name"), F.col("cells")[i + 1].try_cast("double").alias("value")))
    features = F.when(F.size("cells") >= 4, pairs).otherwise(F.array())
    return lines(spark, path).select(_cell(0, "bigint").alias("segment_id"), _cell(1, "int").alias("view_id"), features.alias("features"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return _columns(lines(spark, path), [("segment_id", "bigint"), ("label", "int")]).drop("line")


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    return _columns(lines(spark, path), [("timestamp_ns", "bigint"), ("id_before", "bigint"), ("id_after", "bigint")])


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """(line, segment_id, classes): an id and its numbers; what is no number is null."""
    numbers = F.transform(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))), lambda c: c.try_cast("double"))
    return lines(spark, path).select("line", _cell(0, "bigint").alias("segment_id"), numbers.alias("classes"))


def read_trajectory(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """(line, values): comma-separated poses, one per line; ``header`` drops the first line."""
    raw = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.trim("value").alias("value")).filter("value <> ''")
    if header:
        first = raw.agg(F.min("line")).first()[0]
        raw = raw.filter(F.col("line") > (first if first is not None else -1))
    return raw.select("line", F.transform(F.split("value", r"\s*,\s*"), lambda c: c.try_cast("double")).alias("values"))


def read_timestamps(spark: SparkSession, path: str) -> DataFrame:
    return _columns(lines(spark, path), [("segment_id", "bigint"), ("view_id", "int"), ("timestamp_ns", "bigint")])


def joined_features(segments: DataFrame, features: DataFrame, how: str = "concatenate", missing: str = "ignore") -> DataFrame:
    """segments (segment_id, view_id, features) with the features read for them.

    how: "concatenate" puts them behind those held, "replace" in place of them. missing: what to do with rows that name a segment
    and view that are not there: "ignore" them, or "abort" with an error.
    """
    if how not in ("concatenate", "replace") or missing not in ("ignore", "abort"):
        raise ValueError(f"{how}, {missing}: unknown way of joining features")
    if missing == "abort" and features.join(segments, ["segment_id", "view_id"], "left_anti").limit(1).count():
        raise ValueError("features name a segment and view that are not there")
    more = features.select("segment_id", "view_id", F.col("features").alias("more"))
    held, none = F.coalesce("features", F.array().cast(segments.schema["features"].dataType)), F.col("more").isNull()
    out = F.when(none, F.col("features")).otherwise(F.concat(held, "more") if how == "concatenate" else F.col("more"))
    return segments.join(more, ["segment_id", "view_id"], "left").withColumn("features", out).drop("more")


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """(line, ids): one ragged group of ids per line; ids may be written as floats."""
    return lines(spark, path).select("line", F.transform("cells", lambda c: c.cast("double").cast("bigint")).alias("ids"))


def write_lines(rows: DataFrame, columns: list[str], path: str) -> None:
    """Columns as space-separated lines; array columns are laid flat."""
    parts = [F.array_join(F.col(c).cast("array<string>"), " ") if rows.schema[c].dataType.typeName() == "array" else F.col(c).cast("string") for c in columns]
    rows.select(F.concat_ws(" ", *parts).alias("value")).write.mode("overwrite").text(path)


def write_features(rows: DataFrame, path: str) -> None:
    """segment_id, view_id and then the names and values in turn."""
    flat = F.transform("features", lambda f: F.concat_ws(" ", f["name"], f["value"].cast("string")))
    write_lines(rows.withColumn("flat", flat), ["segment_id", "view_id", "flat"], path)


def last_views(rows: DataFrame) -> DataFrame:
    """The rows of each segment's last view."""
    last = rows.groupBy("segment_id").agg(F.max("view_id").alias("view_id"))
    return rows.join(last, ["segment_id", "view_id"], "left_semi")


def write_segments(points: DataFrame, path: str, all_views: bool = False) -> None:
    """id, view (if all are written) and place of every point; else those of the last view alone."""
    rows = points if all_views else last_views(points)
    write_lines(rows, ["segment_id", *(["view_id"] if all_views else []), "x", "y", "z"], path)


def write_positions(rows: DataFrame, path: str, all_views: bool = False) -> None:
    write_lines(rows if all_views else last_views(rows), ["segment_id", *(["view_id"] if all_views else []), "px", "py", "pz"], path)


def write_timestamps(rows: DataFrame, path: str, all_views: bool = False) -> None:
    write_lines(rows if all_views else last_views(rows), ["segment_id", *(["view_id"] if all_views else []), "timestamp_ns"], path)


def write_merges(rows: DataFrame, path: str) -> None:
    write_lines(rows, ["timestamp_ns", "id_before", "id_after"], path)


def write_matches(rows: DataFrame, path: str) -> None:
    write_lines(rows, ["ids"], path)


def write_classes(rows: DataFrame, path: str) -> None:
    write_lines(rows, ["segment_id", "classes"], path)


def write_session(segments: DataFrame, positions: DataFrame, features: DataFrame, merges: DataFrame, matches: DataFrame, path: str) -> None:
    """All tables of a session below one folder, as ``read_session`` reads them."""
    write_segments(segments, f"{path}/segments", all_views=True)
    write_positions(positions, f"{path}/positions", all_views=True)
    write_features(features, f"{path}/features")
    write_merges(merges, f"{path}/merge_events")
    write_matches(matches, f"{path}/matches")


def read_session(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {"segments": read_segments(spark, f"{path}/segments"), "positions": read_positions(spark, f"{path}/positions"), "features": read_features(spark, f"{path}/features"),
            "merge_events": read_merges(spark, f"{path}/merge_events"), "matches": read_matches(spark, f"{path}/matches")}


def read_cloud(spark: SparkSession, path: str) -> DataFrame:
    """An ASCII cloud, its fields as columns of doubles: a file, a folder of files of the same fields, or what ``write_cloud`` wrote.

    Lines are read as text, so a large file is split among tasks; header lines are those that begin with a word of the format.
    """
    every = spark.read.option("recursiveFileLookup", "true").text(path).select(F.trim("value").alias("value"))
    head = every.filter("value RLIKE '^(FIELDS|DATA) '").distinct().collect()
    fields = {tuple(r["value"].split()[1:]) for r in head if r["value"].startswith("FIELDS")}
    kinds = {r["value"].split()[1] for r in head if r["value"].startswith("DATA")}
    if len(fields) != 1 or kinds != {"ascii"}:
        raise ValueError(f"{path}: one set of fields and ascii data are read, not {fields} and {kinds}")
    body = every.filter("value RLIKE '^[-+0-9.nN]'").select(F.split("value", r"\s+").alias("cells"))
    return body.select(*[_cell(i, "double").alias(name) for i, name in enumerate(fields.pop())])


def read_labelled_clouds(spark: SparkSession, path: str, names: str = r"([ab])(\d+)\.pcd$") -> DataFrame:
    """(group, number, x, y, z) of all files of a folder whose name matches; the pattern's two parts name the group and number."""
    raw = spark.read.option("pathGlobFilter", "*.pcd").text(path).select(F.trim("value").alias("value"), F.input_file_name().alias("file"))
    found = raw.withColumns({"group": F.regexp_extract("file", "/" + names, 1), "number": F.regexp_extract("file", "/" + names, 2).try_cast("long")})
    body = found.filter("number IS NOT NULL AND value RLIKE '^[-+0-9.]'").withColumn("cells", F.split("value", r"\s+"))
    return body.select("group", "number", *[_cell(i, "double").alias(a) for i, a in enumerate("xyz")])


def write_cloud(points: DataFrame, path: str) -> None:
    """x, y, z of all points as text lines below a folder, in parallel, beside a header that holds their count; ``read_cloud`` reads it."""
    n = points.count()
    head = ["# .PCD v0.7", "VERSION 0.7", "FIELDS x y z", "SIZE 8 8 8", "TYPE F F F", "COUNT 1 1 1", f"WIDTH {n}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {n}", "DATA ascii"]
    points.sparkSession.createDataFrame([(h,) for h in head], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    write_lines(points, ["x", "y", "z"], f"{path}/points")
