"""Finding windows that occur in several documents, without sending every window.

A document is a sequence of elements, bytes or words. Each window of ``WINDOW`` elements is named by its anchor, the
run of ``ANCHOR`` elements in it with the smallest hash. Equal windows have equal anchors, and neighbouring
windows mostly share one, so a document falls into segments (runs of windows of one anchor), about one per 13
elements. Only segments are exchanged, as hashes:

* segments of equal content form a class (a 48-bit anchor hash within its bucket, and 48 bits of the content);
  only the smallest id of a class matters, so copies are aggregated in their block before anything is sent;
* a segment whose class has a smaller id elsewhere holds repeated windows only: status DUP;
* a segment of the smallest id, whose anchor also occurs in classes of other content, has to be compared with
  those, window by window: status COMPARE or above. How is up to the operator, which gets such segments by bucket;
  an anchor with over ``CROWD`` classes has the status COMPARE + n, which lets the operator deal its windows to 2**n parts;
* all others have no equal anywhere.

Documents are packed into blocks of some megabytes and written once, bucketed by block, so that later passes
join what was found to the texts without shuffling the texts again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravox.llm.common import LAST_ID, begin, shared_dir, small, texts, written

WINDOW, ANCHOR = 50, 25
BLOCK_BYTES, CHUNK = 2 << 20, 1 << 18
NONE, DUP, COMPARE = 0, 1, 2
CROWD, MOST_PARTS = 4096, 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.array([xxhash.xxh3_64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)
LOW48 = np.uint64((1 << 48) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def element_hashes(raw: np.ndarray) -> np.ndarray:
    return _BYTES[raw]


def zip_(data: np.ndarray | bytes) -> bytes:
    return zstandard.compress(data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes(), 3)


def unzip(data: bytes, kind=None):
    raw = zstandard.decompress(data)
    return raw if kind is None else np.frombuffer(raw, kind)


@dataclass
class Block:
    """ids of the documents (LAST_ID for null), hashes of their texts, and the whole texts as UTF-8."""

    ids: np.ndarray
    rows: np.ndarray
    texts: list[bytes]
    words: bool

    def elements(self, row: int) -> list[bytes] | bytes:
        return self.texts[row].split() if self.words else self.texts[row]

    def hashes(self, rows: range) -> tuple[np.ndarray, np.ndarray]:
        """Element hashes of some documents and the number of elements of each."""
        if not self.words:
            lengths = np.fromiter((len(self.texts[r]) for r in rows), np.int64, len(rows))
            return element_hashes(np.frombuffer(b"".join(self.texts[r] for r in rows), np.uint8)), lengths
        split = [self.texts[r].split() for r in rows]
        lengths = np.fromiter(map(len, split), np.int64, len(rows))
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter((digest(w) for ws in split for w in ws), np.uint64, int(lengths.sum())), lengths


@dataclass
class Segments:
    """Parallel arrays: anchor hash, content hash, document row, first window, number of windows."""

    key: np.ndarray
    content: np.ndarray
    row: np.ndarray
    start: np.ndarray
    windows: np.ndarray


def _sliding(h: np.ndarray, n: int, join) -> np.ndarray:
    """join over every n neighbours, by doubling."""
    size, out = 1, h
    while 2 * size <= n:
        out = join(out, size, size)
        size *= 2
    return out if size == n else join(out, n - size, size)


def window_hashes(h: np.ndarray) -> np.ndarray:
    """A hash of every run of WINDOW elements."""
    powers = np.cumprod(np.r_[np.uint64(1), np.full(len(h), _INVERSE)])
    forward = np.cumprod(np.r_[np.uint64(1), np.full(len(h), _BASE)])
    prefix = np.r_[np.uint64(0), np.cumsum(h * powers[:-1])]
    return mix((prefix[WINDOW:] - prefix[:-WINDOW]) * forward[: len(h) - WINDOW + 1])


def _segments(h: np.ndarray, lengths: np.ndarray, first_row: int) -> Segments:
    n = len(h)
    starts = np.cumsum(lengths) - lengths
    if n < WINDOW:
        return Segments(*[np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64)])
    powers = np.cumprod(np.r_[np.uint64(1), np.full(n, _INVERSE)])
    prefix = np.r_[np.uint64(0), np.cumsum(h * powers[:-1])]
    forward = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)])
    runs = mix((prefix[ANCHOR:] - prefix[:-ANCHOR]) * forward[: n - ANCHOR + 1])
    least = _sliding(runs, WINDOW - ANCHOR + 1, lambda x, shift, size: np.minimum(x[: len(x) - shift], x[shift:]))
    row = np.repeat(np.arange(len(lengths)), lengths)
    whole = row[: len(least)] == row[WINDOW - 1 :]
    new = np.r_[True, (least[1:] != least[:-1]) | (row[1 : len(least)] != row[: len(least) - 1]) | (whole[1:] != whole[:-1])]
    edges = np.append(np.flatnonzero(new), len(least))
    begin, end = edges[:-1], edges[1:]
    inside = whole[begin]
    begin, end = begin[inside], end[inside]
    content = (prefix[end + WINDOW - 1] - prefix[begin]) * forward[begin] + (end - begin).astype(np.uint64)
    r = row[begin]
    return Segments(mix(least[begin] + _BASE), mix(content), r + first_row, begin - starts[r], end - begin)


def segments(block: Block) -> Segments:
    """All segments of a block, document by document."""
    parts, lo, size = [], 0, 0
    with np.errstate(over="ignore"):
        for hi in range(1, len(block.texts) + 1):
            size += len(block.texts[hi - 1])
            if size >= CHUNK or hi == len(block.texts):
                h, lengths = block.hashes(range(lo, hi))
                parts.append(_segments(h, lengths, lo))
                lo, size = hi, 0
    return Segments(*[np.concatenate([getattr(p, f) for p in parts]) for f in Segments.__dataclass_fields__]) if parts else Segments(*[np.zeros(0, np.int64)] * 5)


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _classes(block: Block, seg: Segments, buckets: int):
    """The block's classes by (bucket, key, content): order of the segments, first segment of each class, its bucket."""
    bucket = bucket_of(seg.key, buckets)
    order = np.lexsort((block.ids[seg.row], seg.content & LOW48, seg.key & LOW48, bucket))
    b, k, c = bucket[order], (seg.key & LOW48)[order], (seg.content & LOW48)[order]
    new = np.r_[True, (b[1:] != b[:-1]) | (k[1:] != k[:-1]) | (c[1:] != c[:-1])] if len(order) else np.zeros(0, bool)
    return order, np.flatnonzero(new), b


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def unpacked(batch, words: bool) -> Iterator[tuple[int, Block]]:
    for number, ids, rows, lengths, body in zip(*(batch.column(c).to_pylist() for c in ("block", "ids", "rows", "lengths", "body"))):
        raw, ends = unzip(body), np.cumsum(np.frombuffer(lengths, "<i8")).tolist()
        yield number, Block(np.frombuffer(ids, "<i8"), np.frombuffer(rows, "<i8"), [raw[a:b] for a, b in zip([0, *ends], ends)], words)


class Exchange:
    """Blocks of a corpus and the status of their segments."""

    def __init__(self, docs: DataFrame, words: bool, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD):
        self.spark, self.words = docs.sparkSession, words
        self.table = f"blocks_{uuid.uuid4().hex}"
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        packed = texts(docs, id_col, text_col).select(F.coalesce("id", F.lit(LAST_ID)).alias("id"), F.xxhash64("text").alias("row"), "text")
        packed = packed.mapInArrow(_pack, "block long, ids binary, rows binary, lengths binary, body binary")
        # Dealt before writing, so that a bucket is one file and not one per block.
        packed.repartition(parts, "block").write.bucketBy(parts, "block").option("compression", "none").option("path", shared_dir(self.spark, "blocks")).format("parquet").saveAsTable(self.table)
        self.blocks = self.spark.table(self.table)
        self.buckets = max(64, self.blocks.count() // 2)
        sent = self.blocks.mapInArrow(self._send, "bucket long, block long, ids binary, keys binary, contents binary, rows binary")
        found = sent.groupBy("bucket").applyInArrow(_decider(crowd), "block long, bucket long, status binary")
        found = written(found, "status")
        by_block = found.groupBy("block").agg(F.collect_list(F.struct("bucket", "status")).alias("status"))
        self.known = self.blocks.join(by_block, "block", "left")

    @property
    def _send(self):
        words, buckets = self.words, self.buckets

        def run(batches):
            begin("anchors")
            for batch in batches:
                for number, block in unpacked(batch, words):
                    seg = segments(block)
                    order, first, bucket = _classes(block, seg, buckets)
                    head, at = order[first], bucket[first]
                    used_buckets, cuts = np.unique(at, return_index=True)
                    rows: list[tuple] = []
                    for b, lo, hi in zip(used_buckets.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
                        part = head[lo:hi]
                        used, index = np.unique(block.ids[seg.row[part]], return_inverse=True)
                        rows.append((b, number, used.astype("<i8").tobytes(), _six(seg.key[part] & LOW48), _six(seg.content[part] & LOW48), zip_(index.astype("<u4"))))
                    kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 4
                    cols = list(zip(*rows)) or [()] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["bucket", "block", "ids", "keys", "contents", "rows"])

        return run

    def drop(self) -> None:
        """Forgets the table's name; its files stay in the shared folder, for frames that read them."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _pack(batches):
    from pyspark import TaskContext

    base, count = TaskContext.get().partitionId() << 32, 0
    ids: list[int] = []
    rows: list[int] = []
    bodies: list[bytes] = []
    size = 0

    def packed():
        lengths = np.fromiter(map(len, bodies), "<i8", len(bodies)).tobytes()
        cols = ([base + count], pa.int64()), ([np.array(ids, "<i8").tobytes()], pa.binary()), ([np.array(rows, "<i8").tobytes()], pa.binary()), ([lengths], pa.binary()), ([zip_(b"".join(bodies))], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in cols], names=["block", "ids", "rows", "lengths", "body"])

    for batch in small(batches):
        for key, row, text in zip(*(c.to_pylist() for c in batch.columns)):
            ids.append(key)
            rows.append(row)
            bodies.append(text.encode("utf-8", "surrogatepass"))
            size += len(bodies[-1]) + 64
            if size >= BLOCK_BYTES:
                yield packed()
                ids, rows, bodies, size, count = [], [], [], 0, count + 1
    if ids:
        yield packed()


def _decider(crowd: int):
    """The status of every class of every block within one bucket."""

    def decide(table: pa.Table) -> pa.Table:
        begin("anchors")
        keys, contents, ids, sizes = [], [], [], []
        for i, k, c, r in zip(*(table.column(x).to_pylist() for x in ("ids", "keys", "contents", "rows"))):
            keys.append(_from_six(k))
            contents.append(_from_six(c))
            ids.append(np.frombuffer(i, "<i8")[unzip(r, "<u4")])
            sizes.append(len(keys[-1]))
        k, c, i = np.concatenate(keys), np.concatenate(contents), np.concatenate(ids)
        order = np.lexsort((c, k))
        k, c, i = k[order], c[order], i[order]
        new_key = np.r_[True, k[1:] != k[:-1]]
        new_class = new_key | np.r_[True, c[1:] != c[:-1]]
        first = np.flatnonzero(new_class)
        of_class = np.cumsum(new_class) - 1
        least = np.minimum.reduceat(i, first)[of_class]
        variants = np.add.reduceat(new_class.astype(np.int64), np.flatnonzero(new_key))[np.cumsum(new_key) - 1]
        parts = np.ceil(np.log2(np.maximum(variants / crowd, 1))).astype(np.int64)
        out = np.empty(len(k), np.uint8)
        out[order] = np.where(i > least, DUP, np.where(variants > 1, COMPARE + np.minimum(parts, MOST_PARTS), NONE))
        parts = np.split(out, np.cumsum(sizes)[:-1])
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "status": pa.array([zip_(p) for p in parts], pa.binary())})

    return decide


def statuses(block: Block, found, buckets: int) -> tuple[Segments, np.ndarray]:
    """The segments of a block again, and the status of each."""
    seg = segments(block)
    order, first, _ = _classes(block, seg, buckets)
    out = np.zeros(len(order), np.uint8)
    if len(order):
        by_class = np.concatenate([unzip(x["status"], np.uint8) for x in sorted(found, key=lambda x: x["bucket"])])
        of_class = np.zeros(len(order), np.int64)
        of_class[first] = 1
        of_class = np.cumsum(of_class) - 1
        ids = block.ids[seg.row[order]]
        status = by_class[of_class]
        out[order] = np.where(ids > ids[first][of_class], DUP, status)
    return seg, out


def covered(n: int, starts: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, int]:
    """Which of n elements lie in runs of windows, and the number of maximal covered runs."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + windows + WINDOW - 1, -1)
    hit = np.cumsum(delta[:-1]) > 0
    return hit, int(np.count_nonzero(hit & ~np.r_[False, hit[:-1]]))
