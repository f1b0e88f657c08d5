"""What the operators share: words and row defaults.

Conventions of every operator of this package
---------------------------------------------
* Input columns are picked by name; further columns are ignored, so their names cannot clash.
* A null text counts as an empty one. Rows are never merged by id: a repeated row gets its own result.
* Where ids are compared, a null id counts as larger than any other.
* An empty input gives an empty result with the same columns.
"""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravox.shared import free, shared_dir, written
from terravox.ship import ship

__all__ = ["LAST_ID", "alnum_words", "begin", "free", "keeps", "lower_words", "read", "same_columns", "shared_dir", "small", "texts", "written"]

#: Stands for a null id where ids are ordered.
LAST_ID = 2**63 - 1
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPLIT_ALNUM = bytes(32 if (c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F) else c for c in range(256))
#: Lower-cases A-Z and turns all but ASCII letters, digits and non-ASCII bytes into spaces.
_ALNUM = bytes(_SPLIT_ALNUM[_LOWER[c]] for c in range(256))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def same_columns(docs: DataFrame) -> list:
    """The columns of docs, whatever characters their names have."""
    return [F.col(f"`{c}`") for c in docs.columns]


#: What operators keep in a worker process between tasks, as what drops it; and whose task ran there last.
_KEPT: dict[str, Callable[[], None]] = {}
_LAST = [""]
#: Where the C library can give free pages of its heap back to the system.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None


def keeps(owner: str, drop: Callable[[], None]) -> None:
    _KEPT[owner] = drop


def begin(owner: str) -> None:
    """Called by tasks: a worker gives back what tasks before have freed, and if they were another operator's, what that one kept.

    Workers live on from task to task; without this their memory adds up over the stages of a pipeline.
    """
    if _LAST[0] != owner:
        for name, drop in _KEPT.items():
            if name != owner:
                drop()
        _LAST[0] = owner
        gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) alone; a null text becomes an empty one."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def small(batches, rows: int = 1000):
    """Arrow batches cut into smaller ones, so that a task turns few texts into Python strings at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def lower_words(text: str) -> list[bytes]:
    """Words without ASCII white space, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def alnum_words(text: str) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_ALNUM).split()
