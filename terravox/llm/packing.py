"""Best-fit packing of token sequences by minimum bin slack.

``token_pieces`` encodes whole texts and cuts only documents that are longer than a sequence;
``pack`` places the pieces. Only the histogram of piece lengths, at most ``capacity`` rows whatever the
input, reaches the driver. There the next bin is planned by a bitset subset-sum over the lengths still
available, and a plan is applied to as many bins as the remaining counts allow. Pieces find their place
by their rank among the pieces of their length, which is counted in buckets, so that no length gathers in one task.

Edge cases: a null or empty text is one piece that holds the end id alone; a null id is kept; repeated
rows are packed each; an empty input gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terravox.llm.common import small, texts, written
from terravox.llm.token_ids import encoder

PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if asked for, the ids themselves."""
    end = int(end_id).to_bytes(4, "little")
    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * keep_ids

    def cut(batches):
        enc = encoder(tokenizer)
        for batch in small(batches):
            out = {n: [] for n in names}
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = enc.encode(text) + end
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, capacity)):
                    part = ids[4 * start : 4 * min(n, start + capacity)]
                    row = (key, k, start, len(part) // 4, zlib.crc32(part))
                    for name, value in zip(names, row):
                        out[name].append(value)
                    if keep_ids:
                        out["ids"].append(np.frombuffer(part, "<u4").astype("int32"))
            types = {"piece": pa.int32(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([pa.array(out[n], types.get(n, pa.int64())) for n in names], names=names)

    return texts(docs, id_col, text_col).mapInArrow(cut, PIECES + ", ids array<int>" * keep_ids)


def fullest(counts: np.ndarray, seed: int, capacity: int) -> dict[int, int]:
    """Lengths that, with one piece of length ``seed``, fill a bin as far as can be.

    counts[l]: pieces of length l. Bit s of a set says that the sum s can be reached; sets are kept per
    step, so that the combination can be read back. Long pieces come first: they are the hardest to place.
    """
    room = capacity - seed
    left = counts.copy()
    left[seed] -= 1
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in np.flatnonzero(left[: room + 1])[::-1].tolist():
        many, k = min(int(left[length]), room // length), 1
        while many > 0:
            k = min(k, many)
            grown = (reach | (reach << (k * length))) & mask
            if grown != reach:
                steps.append((length, k, reach))
                reach = grown
            many, k = many - k, 2 * k
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {seed: 1}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + k
            total -= k * length
    return used


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins as (pieces of each length, number of such bins), the largest remaining piece seeding each."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    bins = []
    for seed in range(capacity, 0, -1):
        while counts[seed]:
            used = fullest(counts, seed, capacity)
            many = min(int(counts[length]) // n for length, n in used.items())
            for length, n in used.items():
                counts[length] -= n * many
            bins.append((used, many))
    return bins


def places(bins: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, pieces of it in a bin, offset of the first), by first rank."""
    rank: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for used, many in bins:
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            first = rank.get(length, 0)
            rows.setdefault(length, []).append((first, sequence, n, offset))
            rank[length] = first + n * many
            offset += n * length
        sequence += many
    return {length: np.array(x, np.int64) for length, x in rows.items()}


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """The pieces with sequence_id and offset. ``pieces`` is read three times: pass a written table."""
    spark = pieces.sparkSession
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n"))
    table = spark.sparkContext.broadcast(places(plan({r["length"]: r["n"] for r in histogram.collect()}, capacity)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(firsts, ["length", "bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("rank") + F.col("first")).alias("rank"))

    @F.pandas_udf("struct<sequence_id long, offset long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        known, ln, rk = table.value, length.to_numpy(), rank.to_numpy()
        out = np.empty((len(ln), 2), np.int64)
        for value in np.unique(ln):
            at = np.flatnonzero(ln == value)
            rows = known[int(value)]
            row = rows[np.searchsorted(rows[:, 0], rk[at], side="right") - 1]
            nth = rk[at] - row[:, 0]
            out[at, 0] = row[:, 1] + nth // row[:, 2]
            out[at, 1] = row[:, 3] + nth % row[:, 2] * value
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    placed = ranked.withColumn("at", place("length", "rank"))
    return placed.select(*pieces.columns, "at.sequence_id", "at.offset")


def best_fit(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, cut and pack: one row per piece."""
    cut = token_pieces(docs, tokenizer, capacity, end_id, keep_ids, id_col, text_col)
    return pack(written(cut, "pieces"), capacity)
