"""Queries on data sets and evaluation: classes, splits, ROC, ranks, confusion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terravox.operators.folds import numbered, running
from terravox.operators.neighbours import first_of_class
from terravox.plans.match_plans import SQL_D2
from terravox.sources.tables import PTS_LI, descriptors, lineitem_points, table


def normalize_classes(spark, sf_dir):
    """Classes of two members or more, renumbered without gaps."""
    labels = descriptors(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n")).filter("n >= 2")
    return numbered(labels, ["label"], "class").withColumn("class", F.col("class") - 1)


def class_size_histogram(spark, sf_dir):
    """How many segments have how many points."""
    sizes = lineitem_points(spark, sf_dir).groupBy("segment").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("n_segments"))


def completeness_bins(spark, sf_dir):
    """Quartiles of view sizes by completeness: a view's size over its segment's largest, in tenths."""
    views = lineitem_points(spark, sf_dir).groupBy("segment", "view").agg(F.count("*").alias("n"))
    ratio = F.floor(F.col("n") * 10 / F.max("n").over(Window.partitionBy("segment"))).cast("long")
    return views.withColumn("bin", ratio).groupBy("bin").agg(F.count("*").alias("views"), *[F.expr(f"percentile(n, {q})").alias(name) for q, name in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))])


COMPLETENESS = f"""
WITH {PTS_LI}, v AS (SELECT segment, view, count(*) n FROM pts GROUP BY 1, 2), b AS (SELECT n, CAST(floor(n * 10 / max(n) OVER (PARTITION BY segment)) AS BIGINT) bin FROM v)
SELECT bin, count(*) AS views, quantile_cont(n, 0.25) q1, quantile_cont(n, 0.5) q2, quantile_cont(n, 0.75) q3 FROM b GROUP BY 1
"""


def _scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("score"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


def _steps(spark, sf_dir):
    """Positives and negatives of each distinct score."""
    return _scored(spark, sf_dir).groupBy("score").agg(F.sum(F.col("quality").cast("long")).alias("p"), F.sum(1 - F.col("quality").cast("long")).alias("n"))


def roc_curve(spark, sf_dir):
    """True and false positive rates at every distinct score, from the highest down.

    Rows are summed per score first; the running sums then cover distinct scores alone.
    """
    steps = _steps(spark, sf_dir).withColumn("down", -F.col("score"))
    upto = running(steps, ["down"], tp=F.col("p"), fp=F.col("n"))
    total = upto.agg(F.max("tp").alias("all_p"), F.max("fp").alias("all_n"))
    return upto.crossJoin(F.broadcast(total)).select("score", F.round(F.col("tp") / F.col("all_p"), 6).alias("tpr"), F.round(F.col("fp") / F.col("all_n"), 6).alias("fpr"))


SQL_SCORED = "s AS (SELECT n_chars score, CAST(sum(quality) AS BIGINT) p, CAST(sum(1 - quality) AS BIGINT) n FROM documents JOIN labels USING (doc_id) GROUP BY 1)"
ROC = f"WITH {SQL_SCORED} SELECT score, round(sum(p) OVER (ORDER BY score DESC) / sum(p) OVER (), 6) tpr, round(sum(n) OVER (ORDER BY score DESC) / sum(n) OVER (), 6) fpr FROM s"


def roc_auc(spark, sf_dir):
    """Area under that curve by trapezoids: pairs ranked right, half of the ties."""
    steps = running(_steps(spark, sf_dir), ["score"], upto=F.col("n"))
    return steps.withColumn("right", F.col("p") * (F.col("upto") - F.col("n") / 2)).agg(F.round(F.sum("right") / (F.sum("p") * F.sum("n")), 6).alias("auc"))


AUC = f"WITH {SQL_SCORED}, r AS (SELECT p, n, p * (coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2) ok FROM s) SELECT round(sum(ok) / (sum(p) * sum(n)), 6) auc FROM r"


def confusion_rates(spark, sf_dir):
    """Accuracy and rates of a length threshold as a quality test."""
    hit = F.col("score") >= 1000
    real = F.col("quality") == 1
    c = lambda x: F.count_if(x)
    got = _scored(spark, sf_dir).agg(c(hit & real).alias("tp"), c(hit & ~real).alias("fp"), c(~hit & real).alias("fn"), c(~hit & ~real).alias("tn"))
    return got.select("tp", "fp", "fn", "tn", F.round(F.expr("(tp + tn) / (tp + fp + fn + tn)"), 6).alias("acc"), F.round(F.expr("tp / (tp + fn)"), 6).alias("tpr"), F.round(F.expr("fp / (fp + tn)"), 6).alias("fpr"))


CONFUSION = """
WITH c AS (SELECT count(*) FILTER (n_chars >= 1000 AND quality = 1) tp, count(*) FILTER (n_chars >= 1000 AND quality = 0) fp, count(*) FILTER (n_chars < 1000 AND quality = 1) fn, count(*) FILTER (n_chars < 1000 AND quality = 0) tn FROM documents JOIN labels USING (doc_id))
SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) acc, round(tp / (tp + fn), 6) tpr, round(fp / (fp + tn), 6) fpr FROM c
"""


def rank_first_match(spark, sf_dir):
    """Rank, among all other descriptors by distance from each query, of the first of its class."""
    found = descriptors(spark, sf_dir)
    return first_of_class(found, found.filter("id % 50 = 0"))


RANK = f"""
WITH k AS (SELECT a.vec_id AS query, a.label lq, b.label lt, row_number() OVER (PARTITION BY a.vec_id ORDER BY {SQL_D2}, b.vec_id) rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0)
SELECT query, min(rank) rank FROM k WHERE lq = lt GROUP BY 1
"""


def features_long_format(spark, sf_dir):
    """Descriptors as (id, name, value) rows."""
    flat = descriptors(spark, sf_dir).select("id", F.posexplode("vector").alias("i", "v"))
    return flat.select("id", F.concat(F.lit("f"), F.col("i").cast("string")).alias("name"), F.round(F.col("v").cast("double"), 6).alias("value"))


def feature_lookup(spark, sf_dir):
    """Named values of a descriptor turned into a map and looked up; a missing name gives null."""
    named = F.map_from_entries(F.transform("vector", lambda v, i: F.struct(F.concat(F.lit("f"), i.cast("string")), v.cast("double"))))
    m = descriptors(spark, sf_dir).select("id", named.alias("m"))
    return m.select("id", F.round(F.try_element_at("m", F.lit("f3")), 6).alias("f3"), F.round(F.try_element_at("m", F.lit("scale")), 6).alias("scale"))


def sequence_split(spark, sf_dir):
    """Train and test: the largest view of a segment trains; others test by a fixed hash share of three tenths."""
    views = lineitem_points(spark, sf_dir).groupBy("segment", "view").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("n"), "view")) == 1
    tests = F.pmod(F.col("segment") * 7919 + F.col("view") * 104729, F.lit(10)) < 3
    return views.select("segment", "view", F.when(first | ~tests, "train").otherwise("test").alias("part"))


SPLIT = f"WITH {PTS_LI}, v AS (SELECT segment, view, count(*) n FROM pts GROUP BY 1, 2) SELECT segment, view, CASE WHEN row_number() OVER (PARTITION BY segment ORDER BY n DESC, view) = 1 OR (segment * 7919 + view * 104729) % 10 >= 3 THEN 'train' ELSE 'test' END part FROM v"

PACK = {
    "normalize_classes": (normalize_classes, "SELECT label::BIGINT AS label, n, dense_rank() OVER (ORDER BY label) - 1 AS class FROM (SELECT label, count(*) n FROM embeddings GROUP BY 1 HAVING count(*) >= 2)"),
    "class_size_histogram": (class_size_histogram, f"WITH {PTS_LI} SELECT size, count(*) n_segments FROM (SELECT count(*) size FROM pts GROUP BY segment) GROUP BY 1"),
    "completeness_bins": (completeness_bins, COMPLETENESS),
    "roc_curve": (roc_curve, ROC),
    "roc_auc": (roc_auc, AUC),
    "confusion_rates": (confusion_rates, CONFUSION),
    "rank_first_match": (rank_first_match, RANK),
    "features_long_format": (features_long_format, "SELECT vec_id id, 'f' || i AS name, round(embedding[i + 1]::DOUBLE, 6) AS value FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) i FROM embeddings)"),
    "feature_lookup": (feature_lookup, "SELECT vec_id id, round(embedding[4]::DOUBLE, 6) f3, CAST(NULL AS DOUBLE) scale FROM embeddings"),
    "sequence_split": (sequence_split, SPLIT),
}
