"""How text filters interact, audited by incremental retraction streaming.

Five filters: A few words, B many repeated words, C many capitals, D symbols, E the text of a smaller id. The files of the
documents come as available-now micro-batches:

1. A task reads whole texts and keeps, per document, the bits of A to D and a digest of the text; rows equal in all of that become
   one with a count. Labels are joined to these slim rows, not to texts.
2. Each task then holds, per text, only what stands at the smallest id it has seen. Everything else has certainly failed E and
   goes straight to the counters, so a text that a third of all documents share is a row per task when it is shuffled.
3. The state of a text is its smallest id so far and what stands there: a table keyed by digest, one version per batch, that the next
   batch joins. If a smaller id arrives in a later batch, what was counted without E is retracted and counted with it. Ids of one size do not fail E.
4. The counters of parts (part, mask, label) change by signed rows. A batch writes state and changes under its own number and
   reads only those of the number before, so one that runs again overwrites itself. The sum over batches stands for all files
   read, whatever their order.

From the 32 masks of each part every order of the filters follows without a look at documents.

Edge cases: a null text is an empty one; a null id is larger than any other (and equal to the largest integer); a null part is the empty
string; repeated rows count each; several labels of one id count as set if any is; labels without a document count for nothing.
An empty input has no parts and gives no rows. Texts are one if their SHA-256 is.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravox.llm.common import LAST_ID, shared_dir, written
from terravox.ship import ship

FILTERS = "ABCDE"
BITS = {name: 1 << i for i, name in enumerate(FILTERS)}
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SYMBOLS = re.compile(rb"[#$%&*|]")
_NOT_CAPITALS = bytes(c for c in range(256) if not 0x41 <= c <= 0x5A)
_LATER_BYTES = bytes(range(0x80, 0xC0))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Texts are cut into words some bytes at a time; tasks hold the smallest ids of that many texts at a time.
CHUNK, HELD = 1 << 20, 200_000
DELTA = "part string, mask int, good boolean, toxic boolean, change long"
SLIM = "id long, part string, mask int, digest binary, n long"
#: Rows for the counters, and rows for the state of a text (``digest`` is not null).
MIXED = "digest binary, id long, part string, mask int, good boolean, toxic boolean, n long"


def mask(text: bytes) -> int:
    """The bits of the filters A to D that a text fails."""
    words, distinct, lo = 0, set(), 0
    while lo < len(text):
        hi = lo + CHUNK
        if hi < len(text):
            cut = _SPACE.search(text, hi)
            hi = cut.start() if cut else len(text)
        some = text[lo:hi].split()
        words += len(some)
        distinct.update(some)
        lo = hi
    capitals = len(text.translate(None, _NOT_CAPITALS))
    points = len(text.translate(None, _LATER_BYTES))
    fails = (words < LEAST_WORDS, 100 * len(distinct) < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * points, SYMBOLS.search(text) is not None)
    return sum(1 << i for i, failed in enumerate(fails) if failed)


def _judged(batches):
    """(id, part, text) to SLIM."""
    for batch in batches:
        rows: Counter = Counter()
        texts = batch.column(2).cast(pa.binary())
        for i, (key, part) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            text = texts[i].as_py()
            rows[key, part, mask(text), hashlib.sha256(text).digest()] += 1
        ids, parts, masks, digests = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.string()), pa.array(masks, pa.int32()), pa.array(digests, pa.binary()), pa.array(list(rows.values()), pa.int64())], names=["id", "part", "mask", "digest", "n"])


def _settled(batches):
    """Joined slim rows to MIXED: one row per text, part and label at the smallest id seen; all others as changes of counters."""
    held: dict[bytes, tuple[int, list]] = {}
    counts: Counter = Counter()

    def emit():
        rows = [(d, i, part, m, good, toxic, n) for d, (i, at) in held.items() for part, m, good, toxic, n in at]
        rows += [(None, None, *what, n) for what, n in counts.items()]
        held.clear()
        counts.clear()
        types = [pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64()]
        columns = list(zip(*rows)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f.split()[0] for f in MIXED.split(", ")])

    for batch in batches:
        for digest, key, part, m, good, toxic, n in zip(*(c.to_pylist() for c in batch.columns)):
            row = (part, m, good, toxic, n)
            before = held.get(digest)
            if before is None or key == before[0]:
                held.setdefault(digest, (key, []))[1].append(row)
                continue
            gone = [row]
            if key < before[0]:
                held[digest], gone = (key, [row]), before[1]
            for p, b, g, t, k in gone:
                counts[p, b | BITS["E"], g, t] += k
        if len(held) >= HELD:
            yield emit()
    yield emit()


def _stepped(rows: DataFrame) -> DataFrame:
    """Rows of texts, ``held`` ones from the state and new ones, with the smallest id of their text now."""
    at = rows.groupBy("digest").agg(F.min("id").alias("least"))
    return rows.join(at, "digest")


def changes(step: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, change) of one batch: new rows count, held rows that a smaller id has overtaken move under E."""
    late = F.col("mask").bitwiseOR(F.lit(BITS["E"]))
    over = F.col("id") > F.col("least")
    once = lambda mask, n: F.struct(mask.cast("int").alias("mask"), n.alias("change"))
    moved = F.array(once(F.col("mask"), -F.col("n")), once(late, F.col("n")))
    settled = F.col("digest").isNull()
    signed = F.when(settled, F.array(once(F.col("mask"), F.col("n")))).when(~F.col("held"), F.array(once(F.when(over, late).otherwise(F.col("mask")), F.col("n")))).when(over, moved)
    flat = step.withColumn("signed", F.explode(signed)).select("part", "signed.mask", "good", "toxic", "signed.change")
    return flat.groupBy("part", "mask", "good", "toxic").agg(F.sum("change").alias("change"))


def counters(spark: SparkSession, path: str, labels: DataFrame, batches: int = 4, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n) of all documents in the Parquet files at ``path``, read in about ``batches`` micro-batches."""
    ship(spark)
    source = spark.read.parquet(path)
    files = max(1, -(-len(source.inputFiles()) // batches))
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", files).parquet(path + "*")
    rows = stream.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    slim = rows.mapInArrow(_judged, SLIM)
    flags = labels.groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    flags = flags.filter("of IS NOT NULL AND (good OR toxic)").select("of", F.lit(True).alias("known"), "good", "toxic")
    # Rows without an id have no label: they are dealt by their texts, away from any one task.
    named = F.col("id") != LAST_ID
    slim = slim.withColumn("known", named).withColumn("of", F.when(named, F.col("id")).otherwise(F.xxhash64("digest")))
    joined = slim.join(flags, ["of", "known"], "left").select("digest", "id", "part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")], "n")
    mixed = joined.mapInArrow(_settled, MIXED)
    top = shared_dir(spark, "audit")
    step = lambda number: f"{top}/texts/batch={number}"
    what, kept = ["part", "mask", "good", "toxic"], f"{MIXED}, held boolean, least long"

    def put(batch: DataFrame, number: int) -> None:
        # What the batch before left at the smallest ids is the state; steps are never changed, so a batch can run again.
        state = spark.read.schema(kept).parquet(step(number - 1)).filter("digest IS NOT NULL AND id = least").groupBy("digest", "id", *what).agg(F.sum("n").alias("n"))
        new = written(batch, "batch")
        texts = new.filter("digest IS NOT NULL").select("digest", "id", *what, "n", F.lit(False).alias("held")).unionByName(state.withColumn("held", F.lit(True)))
        settled = new.filter("digest IS NULL").select("digest", "id", *what, "n", F.lit(False).alias("held"), F.lit(None).cast("long").alias("least"))
        _stepped(texts).unionByName(settled).write.mode("overwrite").parquet(step(number))
        changes(spark.read.schema(kept).parquet(step(number))).write.mode("overwrite").parquet(f"{top}/counters/batch={number}")

    # First, empty ones, so that the tables exist whatever comes.
    spark.createDataFrame([], kept).write.parquet(step(-1))
    spark.createDataFrame([], DELTA).write.parquet(f"{top}/counters/batch=-1")
    query = mixed.writeStream.foreachBatch(put).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    every = spark.read.schema(DELTA).option("basePath", f"{top}/counters").parquet(f"{top}/counters")
    return every.groupBy(*what).agg(F.sum("change").alias("n")).filter("n <> 0")


def report(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from (part, mask, good, toxic, n)."""
    steps = [(
        "".join(order), step + 1, BITS[order[step]], sum(BITS[f] for f in order[:step])
    ) for order in permutations(FILTERS) for step in range(len(FILTERS))]
    row = "struct<filter_order: string, step: int, own: int, before: int>"
    table = F.from_json(F.lit("[" + ",".join(f'{{"filter_order":"{o}","step":{s},"own":{own},"before":{before}}}' for o, s, own, before in steps) + "]"), f"array<{row}>")
    masks = counts.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    each = masks.withColumn("at", F.explode(table)).select("*", "at.*")
    failing, earlier = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda when, n="n": F.sum(F.when(when, F.col(n)).otherwise(0)).cast("long")
    found = each.groupBy("part", "filter_order", "step", "own").agg(
        total(~failing & ~earlier).alias("kept"), total(failing & ~earlier).alias("removed"), total(failing & earlier).alias("redundant"), total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(failing & ~earlier, "good").alias("good_lost"), total(failing & ~earlier, "toxic").alias("toxic_lost"))
    shares = found.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return found.join(shares, ["part", "own"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = 4) -> DataFrame:
    """The audit of the documents at ``path``: 600 rows per part."""
    return report(counters(spark, path, labels, batches))
