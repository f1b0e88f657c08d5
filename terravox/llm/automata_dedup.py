"""Repeated passages by suffix automata of reference shards.

The reference of a document is all documents of smaller id. It is cut into shards by anchor (see ``anchors``) and by size: a
shard holds at most ``SHARD_WORDS`` words of the segments that have to be compared, nothing else. Documents run in ascending
order of their ids: a segment's words are streamed through the automaton of the smaller ids' segments, which gives the longest
match that ends at every word (the matching statistics). Where a match reaches the threshold, the window is repeated.

Sending every shard to every document, as a plain broadcast would, costs shards times corpus. Instead each
shard's automaton is built where the segments that can match in it arrive, which is the same comparison.

The windows of an anchor that occurs with very many different texts are dealt to several tasks by their hashes: equal windows meet.

Edge cases: as in ``suffix_merge``, with words (no ASCII white space in them) instead of bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terravox.llm.anchors import COMPARE, CROWD, MOST_PARTS, WINDOW, Exchange, Segments, bucket_of, statuses, unpacked, unzip, window_hashes, zip_
from terravox.llm.automaton import SuffixAutomaton
from terravox.llm.common import written
from terravox.llm.suffix_merge import removed

SHARD_WORDS = 50_000
SENT = "bucket long, block long, keys binary, ids binary, rows binary, starts binary, lengths binary, words binary"


def _shared_runs(words: np.ndarray, ends: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(segment, first, end): word runs whose windows have hashes that another id holds as well; no others can match."""
    with np.errstate(over="ignore"):
        h = window_hashes(words)
    first = np.repeat(ends - lengths, lengths - WINDOW + 1)
    many = lengths - WINDOW + 1
    inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    h, segment = h[first + inner], np.repeat(np.arange(len(ends)), many)
    order = np.lexsort((ids[segment], h))
    hs, who = h[order], ids[segment[order]]
    new = np.r_[True, hs[1:] != hs[:-1]]
    differs = np.r_[True, (hs[1:] != hs[:-1]) | (who[1:] != who[:-1])]
    starts = np.flatnonzero(new)
    shared = np.add.reduceat(differs.astype(np.int64), starts)[np.cumsum(new) - 1] > 1
    at = np.sort(order[shared])
    if not len(at):
        return []
    cut = np.r_[True, (np.diff(at) != 1) | (segment[at[1:]] != segment[at[:-1]])]
    lo, hi = at[cut], at[np.append(np.flatnonzero(cut)[1:] - 1, len(at) - 1)]
    return list(zip(segment[lo].tolist(), inner[lo].tolist(), (inner[hi] + WINDOW).tolist()))


def _matches(runs: list[tuple[int, list[int]]]) -> list[list[int]]:
    """Per run (id, words), in ascending order of ids, the first words of windows that runs of smaller ids hold.

    The reference is cut into shards of at most SHARD_WORDS words. A shard's automaton grows while its own runs are streamed;
    then all later runs are streamed through it, and it is given up for the next one. A shard ends between two ids only, so
    that no run meets its own id; an id whose runs alone exceed the limit makes the shard that much larger.
    """
    hits: list[set[int]] = [set() for _ in runs]

    def stream(auto: SuffixAutomaton, r: int) -> None:
        words = runs[r][1]
        if len(hits[r]) == len(words) - WINDOW + 1:
            return
        state = matched = 0
        for i, token in enumerate(words):
            state, matched = auto.step(state, matched, token)
            if matched >= WINDOW:
                hits[r].add(i + 1 - WINDOW)

    lo = 0
    while lo < len(runs):
        auto, size, hi, waiting = SuffixAutomaton(), 0, lo, lo
        while hi < len(runs) and (size < SHARD_WORDS or hi == lo or runs[hi][0] == runs[hi - 1][0]):
            while runs[waiting][0] < runs[hi][0]:
                if len(hits[waiting]) < len(runs[waiting][1]) - WINDOW + 1:
                    auto.add(runs[waiting][1])
                    size += len(runs[waiting][1])
                waiting += 1
            stream(auto, hi)
            hi += 1
        for r in range(waiting, hi):
            auto.add(runs[r][1])
        for r in range(hi, len(runs)):
            stream(auto, r)
        lo = hi
    return [sorted(x) for x in hits]


def _stream(table: pa.Table) -> pa.Table:
    """Repeated windows of one bucket: per block, rows and starts."""
    cols = {c: table.column(c).to_pylist() for c in table.column_names}
    n = [unzip(x, "<u4") for x in cols["lengths"]]
    sizes = [len(x) for x in n]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    key, ids, rows, starts, lengths = (np.concatenate([unzip(x, kind) for x in cols[c]]) for c, kind in (("keys", "<u8"), ("ids", "<i8"), ("rows", "<u4"), ("starts", "<u4"), ("lengths", "<u4")))
    words, lengths = np.concatenate([unzip(x, "<u8") for x in cols["words"]]), lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    shards: dict[int, list[tuple[int, int, int, int]]] = {}
    for s, a, b in _shared_runs(words, ends, lengths, ids):
        shards.setdefault(int(key[s]), []).append((int(ids[s]), s, a, b))
    hits: list[list[tuple[int, int]]] = [[] for _ in sizes]
    for found in shards.values():
        found.sort()
        base = [int(ends[s] - lengths[s]) for _, s, _, _ in found]
        runs = [(i, words[o + a : o + b].tolist()) for o, (i, _, a, b) in zip(base, found)]
        for (_, s, a, _), at in zip(found, _matches(runs)):
            hits[owner[s]] += [(int(rows[s]), int(starts[s]) + a + i) for i in at]
    found = [(cols["block"][b], *(zip_(np.array(x, "<u4")) for x in zip(*h))) for b, h in enumerate(hits) if h]
    out = list(zip(*found)) or [()] * 3
    return pa.table({"block": pa.array(list(out[0]), pa.int64()), "rows": pa.array(list(out[1]), pa.binary()), "starts": pa.array(list(out[2]), pa.binary())})


def _dealt(seg: Segments, chosen: np.ndarray, found: np.ndarray, hashes: dict[int, np.ndarray]) -> list[np.ndarray]:
    """(segment, first window, windows, part) of the runs to send.

    A segment is sent whole unless its anchor is crowded: then each of its windows goes to the part that its hash names, and
    neighbours of one part stay together.
    """
    level, none = found[chosen].astype(np.int64) - COMPARE, np.zeros
    calm = chosen[level == 0]
    out = [(calm, none(len(calm)), seg.windows[calm], none(len(calm)))]
    for s, p in zip(chosen[level > 0].tolist(), level[level > 0].tolist()):
        first, n = int(seg.start[s]), int(seg.windows[s])
        with np.errstate(over="ignore"):
            part = (window_hashes(hashes[int(seg.row[s])][first : first + n + WINDOW - 1]) >> np.uint64(64 - p)).astype(np.int64)
        at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        out.append((np.full(len(at), s), at, np.diff(np.append(at, n)), part[at]))
    return [np.concatenate(c).astype(np.int64) for c in zip(*out)]


def repeated(exchange: Exchange) -> DataFrame:
    """(block, rows, starts): the windows of compared segments that repeat a smaller id's."""
    buckets = exchange.buckets

    def send(batches):
        for batch in batches:
            for (number, block), status in zip(unpacked(batch, True), batch.column("status").to_pylist()):
                seg, found = statuses(block, status or [], buckets)
                chosen = np.flatnonzero(found >= COMPARE)
                hashes = {r: block.hashes(range(r, r + 1))[0] for r in sorted(set(seg.row[chosen].tolist()))}
                segment, offset, windows, part = _dealt(seg, chosen, found, hashes)
                bucket = bucket_of(seg.key[segment], buckets) << MOST_PARTS | part
                order = np.argsort(bucket, kind="stable")
                used, cuts = np.unique(bucket[order], return_index=True)
                rows = []
                for b, lo, hi in zip(used.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
                    mine = order[lo:hi]
                    at = segment[mine]
                    start, size = seg.start[at] + offset[mine], windows[mine] + WINDOW - 1
                    parts = [hashes[r][s : s + n] for r, s, n in zip(seg.row[at].tolist(), start.tolist(), size.tolist())]
                    data = (seg.key[at].astype("<u8"), block.ids[seg.row[at]].astype("<i8"), seg.row[at].astype("<u4"), start.astype("<u4"), size.astype("<u4"), np.concatenate(parts).astype("<u8"))
                    rows.append((b, number, *map(zip_, data)))
                kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 6
                cols = list(zip(*rows)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in SENT.split(", ")])

    sent = exchange.known.mapInArrow(send, SENT)
    return written(sent.groupBy("bucket").applyInArrow(_stream, "block long, rows binary, starts binary"), "repeats")


def passage_dedup(docs: DataFrame, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """Takes every word out that lies in a ``WINDOW``-word passage which also starts in a document of a smaller id.

    crowd: classes of one anchor beyond which its windows are dealt to several tasks.
    """
    exchange = Exchange(docs, words=True, id_col=id_col, text_col=text_col, crowd=crowd)
    out = removed(exchange, repeated(exchange), keep_text)
    exchange.drop()
    return out
