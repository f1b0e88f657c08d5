"""Mixing sources to target weights by hash-threshold histograms.

1. Every document gets its size in words and a key: 60 bits of the MD5 of its id and text, so that any engine finds the same mix again.
2. Sources get targets. Their weights share ``share`` times all words; no target exceeds ``most`` times its source's words, and what is
   over goes to the others by weight until none is above. The level at which that ends has a closed form over the sources in the
   order of (cap / weight): running sums of caps and weights, dealt by ranges, so the number of sources is not bounded.
3. A source's target is a number of whole passes over it and some words more. Those come from the documents below a threshold of
   the key. A histogram of words by source and the key's first 12 bits finds the bucket in which the threshold lies; only that bucket
   is looked at again, by the next 12 bits, until it holds one key. Documents are filtered by the threshold, never sorted.
4. The document of the threshold itself gives only the words still missing, so a source's taken words equal its target rounded.

Edge cases: a null text has no words; a null source is a source, the last one; rows equal in id and text have equal keys, and if
the threshold falls on them they share the missing words by their sizes, each rounded down, so a source may miss fewer words than
it has such rows. Sources without words have the target 0. An empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terravox.llm.common import written
from terravox.operators.folds import numbered, running

#: Bits of a key, and of a level of the histograms.
KEY_BITS, LEVEL_BITS = 60, 12
#: A source's row is dealt to so many tasks where a join is too large to be broadcast: documents of one source meet in as many.
SALTS = 64
SOURCE = ["absent", "source"]


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, absent, source, size, key); absent marks a null source."""
    text = F.col(text_col)
    # Words become one sign each, then only those are left.
    marks = F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]++", "w"), "[^w]++", "")
    digest = F.md5(F.concat_ws(" ", F.col(id_col).cast("string"), text).cast("binary"))
    return docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).isNull().alias("absent"), F.coalesce(F.col(source_col), F.lit("")).alias("source"),
        F.coalesce(F.length(marks), F.lit(0)).cast("long").alias("size"), F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """(absent, source, source_size, target) from (absent, source, source_size); sources in code point order take the weights in turn."""
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = numbered(sizes, SOURCE).withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    ranked = running(ranked.withColumn("ratio", F.col("cap") / F.col("weight")), ["ratio", "n"], caps=F.col("cap"), shares=F.col("weight"))
    ranked = written(ranked, "sources")
    all_of = ranked.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("every"))
    # The level if exactly the sources before this one stop at their caps.
    level = (F.lit(float(share)) * F.col("total") - (F.col("caps") - F.col("cap"))) / (F.col("every") - (F.col("shares") - F.col("weight")))
    tried = ranked.crossJoin(F.broadcast(all_of)).withColumn("level", level)
    settled = tried.filter("level * weight <= cap").agg(F.min_by("level", F.struct("ratio", "n")).alias("level"))
    cap = F.col("cap").cast("double")
    target = F.least(cap, F.coalesce(F.col("level") * F.col("weight"), cap))
    return ranked.crossJoin(F.broadcast(settled)).select(*SOURCE, "source_size", target.alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(absent, source, limit, missing, tied): keys below limit are in; those equal to it share ``missing`` of their ``tied`` words.

    rows: absent, source, size, key; budgets: absent, source, rest, the words to find (more than none).
    """
    known = budgets.select(*SOURCE, "rest")
    for shift in range(KEY_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        bucket = F.shiftright("key", shift).alias("bucket")
        counts = rows.join(known.select(*SOURCE), SOURCE, "left_semi") if shift == KEY_BITS - LEVEL_BITS else rows
        counts = counts.groupBy(*SOURCE, bucket).agg(F.sum("size").alias("words"))
        # At most 2^12 buckets of a source meet here.
        upto = F.sum("words").over(Window.partitionBy(*SOURCE).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        edge = counts.withColumn("upto", upto).join(known, SOURCE).filter("upto >= rest AND upto - words < rest")
        edge = written(edge.select(*SOURCE, "bucket", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest")), "edges")
        known = edge.select(*SOURCE, "rest")
        rows = written(rows.withColumn("bucket", bucket).join(edge.select(*SOURCE, "bucket"), [*SOURCE, "bucket"], "left_semi").drop("bucket"), "edge-rows")
        if rows.groupBy(*SOURCE).agg((F.min("key") < F.max("key")).alias("more")).filter("more").isEmpty():
            break
    return rows.groupBy(*SOURCE).agg(F.min("key").alias("limit"), F.sum("size").alias("tied")).join(known.withColumnRenamed("rest", "missing"), SOURCE)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, taken), one row per document: the words that the mix takes of it, repeats counted."""
    rows = written(sized(docs, id_col, text_col, source_col), "sizes")
    goals = targets(written(rows.groupBy(*SOURCE).agg(F.sum("size").alias("source_size")), "source-sizes"), weights, share, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target") + 0.5).cast("long") - F.col("passes") * F.col("source_size")
    goals = written(goals.withColumn("passes", passes).withColumn("rest", rest), "goals")
    limits = thresholds(rows, goals.filter("rest > 0"))
    # Spark broadcasts the sources if they turn out to be few; else they are dealt out by salt, so that a hot source is many tasks' work.
    every = goals.join(limits, SOURCE, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(every, [*SOURCE, "salt"])
    part = F.expr("CASE WHEN key < limit THEN size WHEN key = limit THEN size * missing DIV tied ELSE 0 END")
    return dealt.select("id", F.when(~F.col("absent"), F.col("source")).alias("source"), "size", "source_size", "target", (F.col("passes") * F.col("size") + F.coalesce(part, F.lit(0))).alias("taken"))
