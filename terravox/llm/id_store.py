"""Raw token-id shards with keyed access through a minimal perfect hash.

Format of a store (a folder): ``<shard>.ids`` holds the ids of the shard's documents one after the other,
little-endian, 2 or 4 bytes each; ``<shard>.idx`` is a header of HEADER 64-bit integers (levels of the hash function, 512-bit
blocks, slots, documents; then the bits of each level) and four sections of fixed-width records, so that any one is read by its place:

* blocks: set bits before the block (8 bytes), then the block's part of the bit arrays of the hash function (64 bytes);
* slots: per slot of the hash the offset and length, in ids, of a document and the fingerprint of its key;
* keys: the document keys in ascending order (null last, as 2**63 - 1); lengths: ids of each document.

Looking a key up reads the header, one block for each level tried (1.6 on average), one slot and the ids, whatever the size of the shard.

``manifest`` is a Parquet table: shard, first, n_docs, n_ids, width. The hash places a key on each level by one
mix; keys that are alone at their bit stay there, the rest go to the next level. Repeated keys share the slot of their
first record and lie side by side, so that the records of a key are one range.

A task writes under a name of its own; only shards that the manifest names count, so a task that runs again
leaves no half-written shard behind. Edge cases: a null or empty text holds the end id alone; an empty input
writes an empty manifest.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravox.llm.common import LAST_ID, shared_dir, small, texts
from terravox.llm.token_ids import encoder

GAMMA, BLOCK, HEADER = 1.5, 512, 128
BLOCK_KIND = np.dtype([("before", "<i8"), ("bits", "u1", BLOCK // 8)])
SLOT_KIND = np.dtype([("offset", "<i8"), ("length", "<i8"), ("print", "<u4")])
#: Ids read at a time when whole shards are read.
READ_IDS = 1 << 20
MANIFEST = "part int, shard string, first_key long, n_docs long, n_ids long, width int"


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of integer keys."""
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: each key gets its own slot in 0 .. n-1.

    blocks: function from block numbers to (bits set before each, its 64 bytes).
    """

    def __init__(self, levels: list[int], blocks):
        self.levels, self.blocks = levels, blocks

    @staticmethod
    def build(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Bits of each level, and the records of all blocks."""
        left, arrays, levels = keys, [], []
        while len(left):
            size = max(8, int(GAMMA * len(left)))
            at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            arrays.append(alone)
            levels.append(size)
            left = left[~alone[at]]
        bits = np.concatenate(arrays) if arrays else np.zeros(0, bool)
        bits = np.concatenate([bits, np.zeros(-len(bits) % BLOCK, bool)]).reshape(-1, BLOCK)
        out = np.zeros(len(bits), BLOCK_KIND)
        out["before"] = np.cumsum(bits.sum(axis=1)) - bits.sum(axis=1)
        out["bits"] = np.packbits(bits, axis=1)
        return levels, out

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, records = cls.build(keys)
        return cls(levels, lambda numbers: records[numbers])

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for a key that was not built in, any slot or -1."""
        out, todo, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.levels):
            for lo in range(0, len(todo), 1 << 14):
                mine = todo[lo : lo + (1 << 14)]
                at = base + (_mix(keys[mine], level) % np.uint64(size)).astype(np.int64)
                record, inner = self.blocks(at // BLOCK), at % BLOCK
                bits = np.unpackbits(record["bits"], axis=1)
                hit = bits[np.arange(len(at)), inner] == 1
                before = (bits[hit] * (np.arange(BLOCK)[None, :] < inner[hit][:, None])).sum(axis=1)
                out[mine[hit]] = record["before"][hit] + before
            todo, base = todo[out[todo] < 0], base + size
            if not len(todo):
                break
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1_000) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _put(path: str, data) -> None:
    store, at = pafs.FileSystem.from_uri(path)
    with store.open_output_stream(at) as f:
        f.write(data)


def write_store(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None,
                id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encodes whole texts and writes a store in ascending key order; returns its folder.

    Rows of one key are dealt by a hash of their text as well, so that no key fills a task.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark, "id-store")
    store, at = pafs.FileSystem.from_uri(path)
    store.create_dir(at, recursive=True)
    end = int(end_id).to_bytes(4, "little")

    def shard(batches):
        from pyspark import TaskContext

        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        width = 2 if max(len(enc.packed), end_id + 1) <= 1 << 16 else 4
        name = f"{part:06d}-{uuid.uuid4().hex}"
        keys, lengths, out, where = [], [], None, None
        for batch in small(batches):
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                if out is None:
                    files, where = pafs.FileSystem.from_uri(f"{path}/{name}.ids")
                    out = files.open_output_stream(where)
                ids = np.frombuffer(enc.encode(text) + end, "<u4")
                keys.append(key)
                lengths.append(len(ids))
                out.write(ids.astype(f"<u{width}").tobytes())
        if out is None:
            return
        out.close()
        keys, lengths = np.array(keys, np.int64), np.array(lengths, np.int64)
        firsts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        offsets = np.cumsum(lengths) - lengths
        levels, blocks = PerfectHash.build(keys[firsts])
        slot = PerfectHash(levels, lambda numbers: blocks[numbers]).slots(keys[firsts])
        slots = np.empty(len(firsts), SLOT_KIND)
        for what, values in (("offset", offsets[firsts]), ("length", np.add.reduceat(lengths, firsts)), ("print", fingerprint(keys[firsts]))):
            slots[what][slot] = values
        header = np.zeros(HEADER, "<i8")
        header[: 4 + len(levels)] = [len(levels), len(blocks), len(slots), len(keys), *levels]
        _put(f"{path}/{name}.idx", b"".join(x.tobytes() for x in (header, blocks, slots, keys.astype("<i8"), lengths.astype("<i8"))))
        row = [[part], [name], [int(keys[0])], [len(keys)], [int(lengths.sum())], [width]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=[x.split()[0] for x in MANIFEST.split(", ")])

    keyed = texts(docs, id_col, text_col).select(F.coalesce("id", F.lit(LAST_ID)).alias("key"), "text", F.xxhash64("text").alias("salt"))
    ordered = keyed.repartitionByRange("key", "salt").sortWithinPartitions("key", "salt")
    ordered.select("key", "text").mapInArrow(shard, MANIFEST).write.parquet(f"{path}/manifest")
    return path


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The manifest with the ids before each shard."""
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


class Shard:
    """One shard, opened for keyed access; ``touched`` counts the bytes read from it."""

    def __init__(self, path: str, name: str, width: int):
        files, at = pafs.FileSystem.from_uri(f"{path}/{name}.idx")
        self.index, self.ids, self.width, self.touched = files.open_input_file(at), files.open_input_file(f"{at[:-4]}.ids"), width, 0
        n_levels, n_blocks, n_slots, self.n_docs, *levels = self._records(self.index, "<i8", 0, HEADER).tolist()
        kinds, sizes, at = (BLOCK_KIND, SLOT_KIND, np.dtype("<i8"), np.dtype("<i8")), (n_blocks, n_slots, self.n_docs, self.n_docs), 8 * HEADER
        self.sections = {}
        for what, kind, n in zip(("blocks", "slots", "keys", "lengths"), kinds, sizes):
            self.sections[what] = kind, at, n
            at += kind.itemsize * n
        self.hash = PerfectHash(levels[:n_levels], lambda numbers: self.some("blocks", numbers))

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.index.close()
        self.ids.close()

    def _records(self, file, kind, at: int, n: int) -> np.ndarray:
        kind = np.dtype(kind)
        self.touched += kind.itemsize * n
        return np.frombuffer(file.read_at(kind.itemsize * n, at), kind)

    def some(self, what: str, numbers: np.ndarray) -> np.ndarray:
        """Records of a section: each by its place while they are few, else out of the whole section, read once."""
        kind, at, n = self.sections[what]
        if len(numbers) > 64 and not isinstance(at, np.ndarray):
            at = self._records(self.index, kind, at, n)
            self.sections[what] = kind, at, n
        if isinstance(at, np.ndarray):
            return at[numbers]
        return np.concatenate([self._records(self.index, kind, at + kind.itemsize * int(i), 1) for i in numbers]) if len(numbers) else np.zeros(0, kind)

    def whole(self, what: str) -> np.ndarray:
        kind, at, n = self.sections[what]
        return self._records(self.index, kind, at, n)

    def ranges(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset and length, in ids, of all records of each key; length -1 where the key is not stored."""
        slot = self.hash.slots(keys)
        out = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        held = np.flatnonzero(slot >= 0)
        found = self.some("slots", slot[held])
        same = found["print"] == fingerprint(keys[held])
        out[0][held[same]], out[1][held[same]] = found["offset"][same], found["length"][same]
        return out

    def read(self, offset: int, length: int) -> np.ndarray:
        return self._records(self.ids, f"<u{self.width}", offset * self.width, length)


def lookup(spark: SparkSession, path: str, keys: list[int]) -> dict[int, list[int]]:
    """The ids stored for a list of keys, in one job, by constant-time access to the shards whose key range holds them."""
    rows = shards(spark, path).select("shard", "width", "part", "first_key", F.lead("first_key").over(Window.orderBy("part")).alias("next_key"))
    asked = spark.createDataFrame([(int(k),) for k in keys], "key long").distinct()
    pairs = rows.join(F.broadcast(asked), (F.col("first_key") <= F.col("key")) & F.coalesce(F.col("next_key") >= F.col("key"), F.lit(True)))

    def find(batches):
        for batch in batches:
            out: list[tuple] = []
            for part, name, width, key in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "width", "key"))):
                with Shard(path, name, width) as shard:
                    (offset,), (length,) = shard.ranges(np.array([key], np.int64))
                    if length > 0:
                        out.append((key, part, shard.read(int(offset), int(length)).astype(np.int64)))
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.list_(pa.int64())))], names=["key", "part", "ids"])

    got: dict[int, list[int]] = {}
    for r in pairs.mapInArrow(find, "key long, part int, ids array<long>").orderBy("key", "part").collect():
        got.setdefault(r["key"], []).extend(r["ids"])
    return got


def read_store(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """One row per document, read from the files through their index: id, start, n_tokens, ids_crc32 (and the ids)."""
    names = ["id", "start", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids

    def open_shards(batches):
        for batch in batches:
            for name, width, first in zip(*(batch.column(c).to_pylist() for c in ("shard", "width", "first"))):
                with Shard(path, name, width) as shard:
                    keys, lengths = shard.whole("keys"), shard.whole("lengths")
                    new = np.r_[True, keys[1:] != keys[:-1]]
                    group = np.flatnonzero(new)
                    inner = np.cumsum(lengths) - lengths
                    base, span = shard.ranges(keys[group])
                    if (span < 0).any():
                        raise ValueError(f"shard {name}: a key is missing from its index")
                    run = np.cumsum(new) - 1
                    starts = base[run] + inner - inner[group][run]
                    # Records lie side by side in key order, so some are read at once.
                    lo = 0
                    while lo < len(keys):
                        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + READ_IDS)))
                        ids = shard.read(int(starts[lo]), int(starts[hi - 1] + lengths[hi - 1] - starts[lo])).astype("<u4")
                        cuts = (starts[lo : hi] - starts[lo]).tolist() + [len(ids)]
                        raw = memoryview(ids).cast("B")
                        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:])]
                        key = pa.array([None if k == LAST_ID else k for k in keys[lo:hi].tolist()], pa.int64())
                        cols = [key, pa.array(first + starts[lo:hi]), pa.array(lengths[lo:hi]), pa.array(crc, pa.int64())]
                        if keep_ids:
                            cols.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int64))))
                        yield pa.RecordBatch.from_arrays(cols, names=names)
                        lo = hi

    rows = shards(spark, path).select("shard", "width", "first")
    kind = "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids
    return rows.repartition(max(1, rows.count()), "shard").mapInArrow(open_shards, kind)
