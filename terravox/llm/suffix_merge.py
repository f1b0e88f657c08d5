"""Substring dedup by a distributed merge sort of suffixes that knows common prefixes.

Tasks sort the suffixes that have to be compared (see ``anchors``), some blocks at a time, into one run per bucket and send it
front-coded: for each suffix the length of the prefix it shares with the one before, and the rest of its first
``WINDOW`` bytes. Per bucket the runs are combined by a loser tree. A candidate carries its offset-value code: the length of its
common prefix with the last winner and the byte behind it. Codes that differ order two candidates, and the loser's code holds for the
new winner too; only equal codes ask for bytes, and only for those behind the known prefix, so no byte that is known to be equal is
looked at again. Suffixes that share a whole window come out side by side, and all but those of the smallest id are repeated.
Windows of an anchor that very many texts share are dealt to several parts by their hash, equal ones to the same part.

Edge cases: a null or empty text has no bytes; texts shorter than a window keep all bytes; rows of one id never
remove each other's bytes; a null id counts as the largest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravox.llm.anchors import COMPARE, CROWD, DUP, MOST_PARTS, WINDOW, Block, Exchange, bucket_of, covered, mix, statuses, unpacked, unzip, zip_
from terravox.llm.common import LAST_ID, begin, free, same_columns, written

RUN = "bucket long, blocks binary, shared binary, tails binary, ids binary, which binary, rows binary, starts binary"
#: Windows, and text of the blocks they stand in, that are sorted together; suffixes that leave the tree before their groups are
#: judged; the code of an empty run.
RUN_WINDOWS, RUN_BYTES, FLUSH, END = 1 << 18, 8 << 20, 1 << 18, 1 << 30


def front_coded(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of windows, one per row, then in that order the prefix each shares with the one before, and what follows it."""
    order = np.argsort(np.ascontiguousarray(matrix).view(f"S{WINDOW}").ravel(), kind="stable")
    matrix = matrix[order]
    differ = matrix[1:] != matrix[:-1]
    shared = np.r_[0, np.where(differ.any(axis=1), differ.argmax(axis=1), WINDOW)].astype(np.uint8)
    return order, shared, matrix[np.arange(WINDOW)[None, :] >= shared[:, None]]


def offset_value_codes(shared: np.ndarray, tails: np.ndarray) -> list[int]:
    """Codes against the suffix before: the smaller comes first, 0 means equal."""
    left = WINDOW - shared.astype(np.int64)
    at = np.minimum(np.cumsum(left) - left, max(0, len(tails) - 1))
    return np.where(left > 0, left << 8 | tails[at], 0).tolist()


class Run:
    """A front-coded run, decoded one suffix at a time."""

    __slots__ = ("shared", "tails", "codes", "at", "pos", "head")

    def __init__(self, shared: bytes, tails: bytes):
        self.shared, self.tails, self.at, self.pos, self.head = shared, tails, -1, 0, b""
        self.codes = offset_value_codes(np.frombuffer(shared, np.uint8), np.frombuffer(tails, np.uint8)) if shared else []

    def advance(self) -> int:
        """Goes to the next suffix and returns its code."""
        self.at += 1
        if self.at >= len(self.codes):
            self.head = b""
            return END
        n = self.shared[self.at]
        if n < WINDOW:
            end = self.pos + WINDOW - n
            self.head = self.head[:n] + self.tails[self.pos : end]
            self.pos = end
        return self.codes[self.at]


def merge(runs: list[Run]):
    """Yields (run, index, whether equal to the one yielded before) in the order of all suffixes."""
    k = len(runs)
    code = [run.advance() for run in runs]
    tree = [0] * k

    def behind(a: int, b: int) -> bool:
        """For candidates of equal code: whether b comes first. The later one's code becomes that against the earlier one."""
        x, y, at = runs[a].head, runs[b].head, WINDOW - (code[a] >> 8) + 1
        if x[at:] == y[at:]:
            code[b] = 0
            return False
        while x[at] == y[at]:
            at += 1
        later = b if x[at] < y[at] else a
        code[later] = WINDOW - at << 8 | runs[later].head[at]
        return later == a

    def seed(node: int) -> int:
        if node >= k:
            return node - k
        a, b = seed(2 * node), seed(2 * node + 1)
        if code[b] < code[a] or (0 < code[a] == code[b] < END and behind(a, b)):
            a, b = b, a
        tree[node] = b
        return a

    winner = seed(1) if k > 1 else 0
    while (now := code[winner]) < END:
        run = runs[winner]
        yield winner, run.at, not now
        now = run.advance()
        while not now:
            yield winner, run.at, True
            now = run.advance()
        code[winner] = now
        node = winner + k >> 1
        while node:
            other = tree[node]
            theirs = code[other]
            if theirs < now:
                tree[node], winner, now = winner, other, theirs
            elif theirs == now and 0 < now < END and behind(winner, other):
                tree[node], winner = winner, other
            node >>= 1


def _combine(table: pa.Table) -> pa.Table:
    """Repeated windows of one bucket: per block, rows and starts."""
    begin("suffixes")
    cols = {c: table.column(c).to_pylist() for c in table.column_names}
    runs = [Run(unzip(s), unzip(t)) for s, t in zip(cols["shared"], cols["tails"])]
    ids = np.concatenate([unzip(x, "<i8") for x in cols["ids"]])
    base = np.cumsum([0] + [len(r.codes) for r in runs]).tolist()
    found: list[np.ndarray] = []
    out: list[int] = []  # Places of suffixes in order; the first of each group of equal ones as its complement.

    def judge():
        if not out:
            return
        at = np.array(out)
        new = at < 0
        at = np.where(new, ~at, at)
        least = np.minimum.reduceat(ids[at], np.flatnonzero(new))
        found.append(at[ids[at] > least[np.cumsum(new) - 1]])
        out.clear()

    for r, i, same in merge(runs):
        if same:
            out.append(base[r] + i)
        else:
            if len(out) > FLUSH:
                judge()
            out.append(~(base[r] + i))
    judge()
    at = np.concatenate(found) if found else np.zeros(0, np.int64)
    block, row, start = (np.concatenate(x) for x in zip(*((np.frombuffer(b, "<i8")[unzip(w, "<u4")], unzip(r, "<u4"), unzip(s, "<u4")) for b, w, r, s in zip(*(cols[c] for c in ("blocks", "which", "rows", "starts"))))))
    at = at[np.argsort(block[at], kind="stable")]
    numbers, cuts = np.unique(block[at], return_index=True)
    parts = [at[lo:hi] for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)])]
    return pa.table({"block": pa.array(numbers, pa.int64()), "rows": pa.array([zip_(row[p]) for p in parts], pa.binary()), "starts": pa.array([zip_(start[p]) for p in parts], pa.binary())})


_SPREAD = np.cumprod(np.full(WINDOW, 0x9E3779B97F4A7C15, np.uint64))


def _stretches(block: Block, status: list, buckets: int):
    """(row, start, windows, bucket, level) of the segments of a block to compare, in turn as many as ``RUN_WINDOWS`` windows; a longer segment is cut."""
    seg, state = statuses(block, status, buckets)
    chosen = np.flatnonzero(state >= COMPARE)
    many = seg.windows[chosen]
    cuts = -(-many // RUN_WINDOWS)
    of = np.repeat(np.arange(len(chosen)), cuts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    chosen, many = chosen[of], np.minimum(many[of] - nth * RUN_WINDOWS, RUN_WINDOWS)
    columns = seg.row[chosen], seg.start[chosen] + nth * RUN_WINDOWS, many, bucket_of(seg.key[chosen], buckets), state[chosen].astype(np.int64) - COMPARE
    lo = 0
    while lo < len(many):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(many[lo : lo + RUN_WINDOWS]), RUN_WINDOWS, side="right")))
        yield [c[lo:hi] for c in columns]
        lo = hi


def _sorted(group: list[tuple[int, Block, list[np.ndarray]]]) -> pa.RecordBatch:
    """Sorted runs of some stretches, one per bucket (and part, where the anchor is crowded)."""
    parts: list[list[np.ndarray]] = [[] for _ in range(6)]
    base = 0
    for which, (_, block, (row, start, many, bucket, level)) in enumerate(group):
        lengths = np.fromiter(map(len, block.texts), np.int64, len(block.texts))
        begin = np.cumsum(lengths) - lengths
        inner = np.arange(many.sum(), dtype=np.int32) - np.repeat((np.cumsum(many) - many).astype(np.int32), many)
        at = np.repeat(start.astype(np.int32), many) + inner
        values = (np.repeat(bucket << MOST_PARTS, many), np.repeat(level.astype(np.int8), many), np.full(len(at), which, np.int32), np.repeat(row.astype(np.int32), many), at, np.repeat(begin[row] + base, many) + at)
        for p, v in zip(parts, values):
            p.append(v)
        base += int(lengths.sum())
    key, level, which, row, start, place = (np.concatenate(p) for p in parts)
    parts.clear()
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join(t for _, b, _ in group for t in b.texts), np.uint8), WINDOW)
    crowded = np.flatnonzero(level)
    for lo in range(0, len(crowded), 1 << 16):
        at = crowded[lo : lo + (1 << 16)]
        with np.errstate(over="ignore"):
            h = mix((windows[place[at]].astype(np.uint64) * _SPREAD).sum(axis=1))
        key[at] |= (h >> (64 - level[at].astype(np.int64)).astype(np.uint64)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]).tolist()
    numbers = np.array([n for n, _, _ in group], "<i8").tobytes()
    first = np.cumsum([0] + [len(b.ids) for _, b, _ in group])
    every = np.concatenate([b.ids for _, b, _ in group])
    rows = []
    for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
        mine = order[lo:hi]
        inner, shared, tails = front_coded(windows[place[mine]])
        mine = mine[inner]
        ids = every[first[which[mine]] + row[mine]]
        rows.append((int(key[lo]), numbers, zip_(shared), zip_(tails), zip_(ids.astype("<i8")), *(zip_(x[mine].astype("<u4")) for x in (which, row, start))))
    kinds = [pa.int64()] + [pa.binary()] * 7
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in RUN.split(", ")])


def _runs(blocks, buckets: int):
    """Runs of (number, block, status): as many windows, or as much text, as a task sorts at a time."""
    group: list = []
    windows = size = 0
    for number, block, status in blocks:
        for stretch in _stretches(block, status, buckets):
            n = int(stretch[2].sum())
            if group and (windows + n > RUN_WINDOWS or size >= RUN_BYTES):
                yield _sorted(group)
                group, windows, size = [], 0, 0
            group.append((number, block, stretch))
            windows, size = windows + n, size + sum(map(len, block.texts))
    if group:
        yield _sorted(group)


def repeated(exchange: Exchange) -> DataFrame:
    """(block, rows, starts): the windows of compared segments that repeat a smaller id's."""
    words, buckets = exchange.words, exchange.buckets

    def send(batches):
        begin("suffixes")
        blocks = ((number, block, status or []) for batch in batches for (number, block), status in zip(unpacked(batch, words), batch.column("status").to_pylist()))
        yield from _runs(blocks, buckets)

    runs = exchange.known.mapInArrow(send, RUN)
    return written(runs.groupBy("bucket").applyInArrow(_combine, "block long, rows binary, starts binary"), "repeats")


RESULT = "id long, row long, n_units long, n_removed long, n_spans long, kept_sha256 string"


def removed(exchange: Exchange, found: DataFrame, keep_text: bool = False) -> DataFrame:
    """Per row what is left after all repeated windows are taken out: id, row (a hash of the text), n_units, n_removed, n_spans, kept_sha256 (and text).

    Text is decoded as UTF-8; a character that a cut leaves incomplete is dropped from it (not from the digest).
    """
    buckets, words = exchange.buckets, exchange.words
    by_block = found.groupBy("block").agg(F.collect_list(F.struct("rows", "starts")).alias("more"))
    names = [x.split()[0] for x in RESULT.split(", ")] + ["text"] * keep_text

    def apply(batches):
        begin("suffixes")
        for batch in batches:
            for (number, block), status, more in zip(unpacked(batch, words), batch.column("status").to_pylist(), batch.column("more").to_pylist()):
                seg, state = statuses(block, status or [], buckets)
                dup = state == DUP
                row, start, many = seg.row[dup], seg.start[dup], seg.windows[dup]
                for x in more or []:
                    r = unzip(x["rows"], "<u4").astype(np.int64)
                    row, start, many = np.r_[row, r], np.r_[start, unzip(x["starts"], "<u4").astype(np.int64)], np.r_[many, np.ones(len(r), np.int64)]
                order = np.argsort(row, kind="stable")
                row, start, many = row[order], start[order], many[order]
                cuts = np.searchsorted(row, np.arange(len(block.texts) + 1))
                out = []
                for i, text in enumerate(block.texts):
                    units = block.elements(i)
                    a, b = cuts[i], cuts[i + 1]
                    key = int(block.ids[i])
                    kept, gone, spans = text, 0, 0
                    if words:
                        kept = b" ".join(units)
                    if a < b:
                        hit, spans = covered(len(units), start[a:b], many[a:b])
                        gone = int(hit.sum())
                        left = np.flatnonzero(~hit)
                        kept = b" ".join([units[j] for j in left.tolist()]) if words else np.frombuffer(text, np.uint8)[left].tobytes()
                    whole = [kept.decode("utf-8", "ignore") if gone else text.decode("utf-8", "ignore")] if keep_text else []
                    out.append((None if key == LAST_ID else key, int(block.rows[i]), len(units), gone, spans, hashlib.sha256(kept).hexdigest(), *whole))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names=names)

    both = exchange.known.join(by_block, "block", "left")
    return both.mapInArrow(apply, RESULT + ", text string" * keep_text)


def substring_dedup(docs: DataFrame, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """Takes every byte out that lies in a ``WINDOW``-byte string which also starts in a document of a smaller id.

    crowd: classes of one anchor beyond which its windows are dealt to several tasks.
    """
    exchange = Exchange(docs, words=False, id_col=id_col, text_col=text_col, crowd=crowd)
    out = removed(exchange, repeated(exchange), keep_text)
    exchange.drop()
    return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The rows of docs, all columns, with what is left of their texts; rows that lose all bytes go.

    length_col: a column of docs that counts the text's characters, to be counted again.
    """
    key, row, kept = free(docs, "tv_id", "tv_row", "tv_text")
    left = substring_dedup(docs, keep_text=True, id_col=id_col, text_col=text_col).filter("n_removed = 0 OR n_removed < n_units")
    left = left.select(F.coalesce("id", F.lit(LAST_ID)).alias(key), F.col("row").alias(row), F.col("text").alias(kept)).dropDuplicates([key, row])
    keyed = docs.withColumns({key: F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)), row: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))}).drop(text_col)
    both = left.join(keyed, [key, row]).withColumnRenamed(kept, text_col)
    if length_col:
        both = both.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return both.select(*same_columns(docs))
