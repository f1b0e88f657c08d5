"""SimHash near-duplicates verified through pivot distance tables.

1. ``fingerprints``: 64-bit SimHash of word shingles.
2. Rows of one fingerprint are one class; everything below works on distinct fingerprints.
3. Two fingerprints that differ in at most ``bits`` of 64 bits agree on at least two of bits + 2 bit blocks
   (each difference spoils one block), so each is dealt out under every pair of blocks. Keys that many
   fingerprints share are dealt out again by the blocks of their other bits, which loses no pair either.
4. Under a key, pairs are discarded by the largest difference of their distances to the reference
   fingerprints (the pivot table): it is a lower bound of their distance. Survivors are verified, and
   a spanning forest of the links found is what leaves the task.
5. Connected components join the classes.

Edge cases: null, empty and wordless texts have fingerprint 0 and are linked like any other; a null id counts as
the largest; an empty input gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravox.llm.common import LAST_ID, begin, free, lower_words, same_columns, small, texts, written
from terravox.operators.graph import components

PIVOTS, SEED, CROWD = 32, 42, 4096
#: How often fingerprints are dealt at most. Each level multiplies the ways of choosing blocks that a plan holds by 15.
LEVELS = 2


def fingerprint(words: list[bytes], shingle: int = 4) -> int:
    """SimHash of the shingles of a word sequence: a bit is set if it is in over half of their hashes."""
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    digest = xxhash.xxh64_intdigest
    first, last = (ends - lengths)[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last)), np.uint64, len(first))
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo : lo + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, fp): row is a hash of the text, fp the fingerprint as a signed long."""

    def run(batches):
        begin("simhash")
        for batch in small(batches):
            fp = [fingerprint(lower_words(t), shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array(np.array(fp, np.uint64).view(np.int64))], names=["id", "row", "fp"])

    rows = texts(docs, id_col, text_col).select("id", F.xxhash64("text").alias("row"), "text")
    return rows.mapInArrow(run, "id long, row long, fp long")


def _cut(spans: list[tuple[int, int]], n: int) -> list[list[tuple[int, int]]]:
    """n parts of about as many bits each; spans and parts hold (first bit, width)."""
    bits = [b for first, width in spans for b in range(first, first + width)]
    parts = []
    for i in range(n):
        part: list[tuple[int, int]] = []
        for b in bits[len(bits) * i // n : len(bits) * (i + 1) // n]:
            if part and sum(part[-1]) == b:
                part[-1] = (part[-1][0], part[-1][1] + 1)
            else:
                part.append((b, 1))
        parts.append(part)
    return parts


def _bits(fp, part: list[tuple[int, int]]) -> list:
    return [F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1)) for first, width in part]


def _dealt(classes: DataFrame, bits: int, crowd: int = CROWD) -> DataFrame:
    """(key, fp) such that fingerprints at up to ``bits`` differences meet under some key.

    Keys that more than ``crowd`` fingerprints share are dealt out again by blocks of the bits that their own blocks leave, LEVELS
    times in all.
    """
    pairs, fp = list(combinations(range(bits + 2), 2)), F.col("fp")
    calm = None
    # The bits that are left depend on the pairs chosen before; those of each path are known when the plan is made.
    todo = classes.select("fp", F.lit(0).cast("long").alias("key"), F.lit(0).alias("path"))
    paths = {0: [(0, 64)]}
    for level in range(1, LEVELS + 1):
        dealt, following = F.array().cast("array<struct<key: bigint, path: int>>"), {}
        for path, spans in paths.items():
            blocks = _cut(spans, bits + 2)
            keys = []
            for i, (a, b) in enumerate(pairs):
                number = path * len(pairs) + i
                following[number] = [x for k, part in enumerate(blocks) if k not in (a, b) for x in part]
                keys.append(F.struct(F.xxhash64(F.lit(number), F.col("key"), *_bits(fp, blocks[a] + blocks[b])).alias("key"), F.lit(number).alias("path")))
            dealt = F.when(F.col("path") == path, F.array(*keys)).otherwise(dealt)
        todo = todo.select("fp", F.inline(dealt))
        if level == LEVELS:
            # Unchecked, so that the plan does not hold the widest expressions many times over.
            return calm.unionByName(todo.select("key", "fp")) if calm is not None else todo.select("key", "fp")
        crowds = todo.groupBy("key").count().filter(F.col("count") > crowd).select("key", F.lit(True).alias("crowd"))
        told = todo.join(crowds, "key", "left")
        settled = told.filter("crowd IS NULL").select("key", "fp")
        calm = settled if calm is None else calm.unionByName(settled)
        todo, paths = told.filter("crowd").select("fp", "key", "path"), following


def pivot_table(fp: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Hamming distance of each fingerprint to each reference fingerprint, one row per reference."""
    refs = np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(pivots)], np.uint64)
    return np.bitwise_count(fp[None, :] ^ refs[:, None]).astype(np.int8)


def forest(key: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among fingerprints of equal key; rows are ordered by key."""
    n = len(fp)
    table, root = pivot_table(fp), np.arange(n)
    ends = np.searchsorted(key, key, side="right")
    out: list[tuple[int, int]] = []
    live = np.flatnonzero(ends - np.arange(n) > 1)
    step = 1
    while len(live):
        a, b = live, live + step
        near = root[a] != root[b]
        a, b = a[near], b[near]
        for coordinate in table:
            if not len(a):
                break
            close = np.abs(coordinate[a] - coordinate[b]) <= bits
            a, b = a[close], b[close]
        if len(a):
            close = np.bitwise_count(fp[a] ^ fp[b]) <= bits
            for x, y in zip(a[close].tolist(), b[close].tolist()):
                p, q = x, y
                while root[p] != p:
                    p = root[p]
                while root[q] != q:
                    q = root[q]
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out.append((x, y))
            while (root != root[root]).any():
                root = root[root]
        step += 1
        live = live[ends[live] - live > step]
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def links(classes: DataFrame, bits: int = 4, crowd: int = CROWD) -> DataFrame:
    """(src, dst): links that connect all distinct fingerprints at up to ``bits`` differences."""
    bits = int(bits)

    def run(batches):
        begin("simhash")
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def edges(k, f):
            a, b = forest(k, f.view(np.uint64), bits)
            return pa.RecordBatch.from_arrays([pa.array(f[a]), pa.array(f[b])], names=["src", "dst"])

        for batch in batches:
            k = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False)])
            cut = np.searchsorted(k, k[-1]) if len(k) else 0
            held_k, held_f = k[cut:], f[cut:]
            if cut:
                yield edges(k[:cut], f[:cut])
        if len(held_k):
            yield edges(held_k, held_f)

    dealt = _dealt(classes, bits, crowd).repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, fingerprint, component_id, kept) per row.

    component_id is the smallest id reachable by links; row is a hash of the text, and kept marks the row of the
    smallest id and hash in its component (all copies of it, if the very row is repeated).
    """
    prints = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    me = F.struct(F.coalesce("id", F.lit(LAST_ID)).alias("id"), "row")
    classes = written(prints.groupBy("fp").agg(F.min(me).alias("least")), "classes")
    joined = components(links(classes, bits))
    least = classes.join(joined.withColumnRenamed("node", "fp"), "fp").groupBy("component").agg(F.min("least").alias("least"))
    linked = joined.join(least, "component").select(F.col("node").alias("fp"), F.col("least").alias("linked"))
    # Written, so that both sides of the last join come straight from a shuffle and a frequent fingerprint can be split.
    label = written(classes.join(linked, "fp", "left").select("fp", F.coalesce("linked", "least").alias("least")), "labels")
    out = prints.join(label, "fp")
    component = F.when(F.col("least.id") != LAST_ID, F.col("least.id"))
    return out.select("id", "row", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component.alias("component_id"), (me == F.col("least")).alias("kept"))


def deduplicated(docs: DataFrame, shingle: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, of which one per component stays.

    Of rows with the same id and text but other values elsewhere, the one whose other values have the smallest hash stays.
    """
    found = near_duplicates(docs, shingle, bits, id_col, text_col).filter("kept")
    key, row, tie = free(docs, "tv_id", "tv_row", "tv_tie")
    keep = found.select(F.coalesce("id", F.lit(LAST_ID)).alias(key), F.col("row").alias(row)).distinct()
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    rest = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)
    keyed = docs.withColumns({key: F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)), row: F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), tie: rest})
    kept = keyed.join(keep, [key, row]).groupBy(key, row).agg(F.min_by(F.struct(*same_columns(docs)), tie).alias("r"))
    return kept.select("r.*")
