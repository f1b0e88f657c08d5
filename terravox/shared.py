"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only where that is unset and Spark runs locally, as in tests, a local one is set."""
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not top:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="terravox-")
        sc.setCheckpointDir(top)
    if top.startswith("/"):
        top = f"file://{top}"
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, **options: str) -> DataFrame:
    """The rows, written to the shared folder as Parquet and read again: lineage ends here."""
    path = shared_dir(df.sparkSession, what)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file is there, wherever Spark can look."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def free(rows: DataFrame, *names: str) -> list[str]:
    """Names for further columns that no column of rows has, whatever the case of its letters."""
    taken, out = {c.lower() for c in rows.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out
