"""Benchmark decontamination by a generalised suffix automaton of the test items.

The items' words make one automaton per shard of bounded size; training words are streamed through it and
the longest matching length is tracked. Where it reaches the window, the window's last ``window`` words are hit and the
state names the items that hold them. An item shorter than a window is one window of its own.

A shard holds at most ``shard_words`` words, or one longer item (the words are counted before anything is sent out), so the size of one
broadcast automaton is bounded; larger benchmarks run round after round: a shard is built, sent, streamed against and dropped before
the next one, and the hits of all rounds are united per document.

Edge cases: null and wordless texts have no words and no hits; items without words hit nothing; an item without an id hits as
any other but is not named among the items; items of one id count once; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravox.llm.automaton import SuffixAutomaton
from terravox.llm.common import alnum_words, begin, free, same_columns, small, texts, written

HITS = "id long, row long, n_words long, hits array<struct<start: long, end: long>>, items array<string>"


class Index:
    """Automaton of the items, with the items of each window at the states that stand for it."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window, self.vocabulary = window, {}
        self.auto = SuffixAutomaton()
        sequences = []
        for name, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in alnum_words(text)]
            if words:
                sequences.append((name, words))
                self.auto.add(words)
        self.shortest = min([window, *(len(w) for _, w in sequences)])
        self.full: dict[int, set] = {}
        short: dict[int, list] = {}
        for name, words in sequences:
            state = matched = 0
            for i, w in enumerate(words):
                state, matched = self.auto.step(state, matched, w)
                if i + 1 >= window:
                    self.full.setdefault(self.shrink(state, window), set()).add(name)
            if len(words) < window:
                short.setdefault(self.shrink(state, len(words)), []).append((len(words), name))
        self.short = short
        self.chains: dict[int, list] = {}

    def shrink(self, state: int, length: int) -> int:
        """The state of the last ``length`` tokens of what ``state`` stands for."""
        link, lengths = self.auto.link, self.auto.length
        while lengths[link[state]] >= length:
            state = link[state]
        return state

    def shorts(self, state: int) -> list[tuple[int, str]]:
        """Whole short items that end where the state ends."""
        if state not in self.chains:
            found, at = [], state
            while at > 0:
                found += self.short.get(at, ())
                at = self.auto.link[at]
            self.chains[state] = found
        return self.chains[state]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit runs of word positions, and the items whose windows occur."""
        runs: list[list[int]] = []
        items: set = set()
        if not self.vocabulary or len(words) < self.shortest:
            return [], items
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        edges = np.flatnonzero(np.diff(np.r_[False, ids >= 0, False]))
        step, window = self.auto.step, self.window
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a < self.shortest:
                continue
            state = matched = 0
            for i, token in enumerate(ids[a:b].tolist(), a):
                state, matched = step(state, matched, token)
                reach = 0
                if matched >= window:
                    found = self.full.get(self.shrink(state, window))
                    if found:
                        reach = window
                        items |= found - {None}
                if self.short:
                    for n, name in self.shorts(state):
                        if n <= matched:
                            reach = max(reach, n)
                            if name is not None:
                                items.add(name)
                if reach:
                    start = i + 1 - reach
                    while runs and runs[-1][0] >= start:
                        runs.pop()
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = i + 1
                    else:
                        runs.append([start, i + 1])
        return [(a, b) for a, b in runs], items


def _pass(keyed: DataFrame, index, every: bool) -> DataFrame:
    """Hits against one shard; only documents with hits, unless all are asked for."""

    def run(batches):
        begin("decontamination")
        known = index.value
        for batch in small(batches):
            out: list[tuple] = []
            for key, row, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = alnum_words(text)
                runs, items = known.scan(words)
                if every or runs:
                    out.append((key, row, len(words), [{"start": a, "end": b} for a, b in runs], sorted(items)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["id", "row", "n_words", "hits", "items"])

    return keyed.mapInArrow(run, HITS)


def _index(items: DataFrame, window: int):
    """The automaton of one shard, broadcast."""
    rows = items.select("item", "text").collect()
    return items.sparkSession.sparkContext.broadcast(Index([(r["item"], r["text"]) for r in rows], window))


def hits(docs: DataFrame, items: DataFrame, window: int = 10, shard_words: int = 500_000,
         id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row: id, row (a hash of id and text), n_words, hits (runs of word positions), items (sorted ids)."""
    spark = docs.sparkSession
    n_words = F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")
    known = items.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    known = known.withColumns({"words": n_words, "h": F.xxhash64("item", "text")})
    total, longest = known.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.max("words"), F.lit(0))).first()
    keyed = texts(docs, id_col, text_col).select("id", F.xxhash64("id", "text").alias("row"), "text")
    if total <= shard_words:
        return _pass(keyed, _index(known, window), every=True)
    # Groups of about a quarter of a shard by hash; whole groups make up a shard.
    groups = -(-4 * total // max(1, shard_words - min(longest, shard_words // 2)))
    grouped = known.withColumn("g", F.pmod("h", F.lit(groups)))
    sizes = sorted((r["g"], r["n"]) for r in grouped.groupBy("g").agg(F.sum("words").alias("n")).collect())
    shards, size = [[]], 0
    for g, n in sizes:
        if shards[-1] and size + n > shard_words:
            shards.append([])
            size = 0
        shards[-1].append(g)
        size += n
    rounds = []
    for mine in shards:
        index = _index(grouped.filter(F.col("g").between(mine[0], mine[-1])), window)
        rounds.append(written(_pass(keyed, index, every=not rounds), "hits"))
        index.unpersist(blocking=False)
    if len(rounds) == 1:
        return rounds[0]
    rest = rounds[1]
    for more in rounds[2:]:
        rest = rest.unionByName(more)
    rest = rest.dropDuplicates(["row", "items", "hits"]).groupBy("row").agg(F.flatten(F.collect_list("hits")).alias("more_hits"), F.flatten(F.collect_list("items")).alias("more_items"))
    both = rounds[0].join(rest, "row", "left")
    all_runs = F.array_sort(F.concat("hits", F.coalesce("more_hits", F.array())))
    merged = F.aggregate(
        all_runs, F.slice("hits", 1, 0),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    return both.select("id", "row", "n_words", merged.alias("hits"), F.array_sort(F.array_distinct(F.concat("items", F.coalesce("more_items", F.array())))).alias("items"))


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of ``hits``."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, text, dropped): the text without the characters of its hit runs; dropped where their words
    are over ``max_coverage`` of the text's. What stands between two words goes with the first."""
    ids = hits(docs, items, window, id_col=id_col, text_col=text_col).filter(F.size("hits") > 0).select("row", "n_words", "hits").dropDuplicates(["row"])
    keyed = texts(docs, id_col, text_col).select("id", F.xxhash64("id", "text").alias("row"), "text").join(ids, "row")

    def run(batches):
        import re

        word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        for batch in batches:
            out = []
            for row, key, text, n, runs in zip(*(batch.column(c).to_pylist() for c in ("row", "id", "text", "n_words", "hits"))):
                spans = [m.span() for m in word.finditer(text.translate(upper))]
                keep, at = [], 0
                for r in runs:
                    keep.append(text[at : spans[r["start"]][0]])
                    at = spans[r["end"]][0] if r["end"] < len(spans) else spans[-1][1]
                keep.append(text[at:])
                hit = sum(r["end"] - r["start"] for r in runs)
                out.append((key, row, "".join(keep), hit > max_coverage * n))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.bool_()))], names=["id", "row", "text", "dropped"])

    return keyed.mapInArrow(run, "id long, row long, text string, dropped boolean")


def decontaminated(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5,
                   id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The rows of docs, all columns, with hit runs taken out; rows covered by more than ``max_coverage`` go."""
    key, left, dropped = free(docs, "tv_key", "tv_text", "tv_dropped")
    changed = clean(docs, items, window, max_coverage, id_col, text_col).select(F.col("row").alias(key), F.col("text").alias(left), F.col("dropped").alias(dropped))
    changed = written(changed.dropDuplicates([key]), "changed")
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))))
    both = keyed.join(changed, key, "left").filter(~F.coalesce(dropped, F.lit(False)))
    both = both.withColumn(text_col, F.coalesce(left, text_col))
    if length_col:
        both = both.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return both.select(*same_columns(docs))
