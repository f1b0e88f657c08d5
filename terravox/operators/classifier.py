"""A classifier over descriptors: standardised, then a perceptron of one hidden layer, trained and applied by Spark."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _vectors(rows: DataFrame) -> DataFrame:
    """(id, label, raw): rows without a vector, or without a label, are left out."""
    known = rows.filter("vector IS NOT NULL AND label IS NOT NULL")
    return known.select("id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("vector").cast("array<double>")).alias("raw"))


def trained(rows: DataFrame, classes: int, hidden: int = 64, rounds: int = 100, seed: int = 1) -> PipelineModel:
    """A model of rows (id, label, vector); labels are 0 to classes - 1, vectors of one length."""
    data = _vectors(rows)
    first = data.first()
    if first is None:
        raise ValueError("there is nothing to learn from")
    layers = [len(first["raw"]), hidden, classes]
    return Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True), MultilayerPerceptronClassifier(layers=layers, maxIter=rounds, seed=seed)]).fit(data)


def predicted(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """(id, label, predicted)."""
    return model.transform(_vectors(rows)).select("id", F.col("label").cast("long").alias("label"), F.col("prediction").cast("long").alias("predicted"))


def confusion(found: DataFrame) -> DataFrame:
    """(label, predicted, n, share): how often each class is taken for each; share is of the label's rows."""
    n = found.groupBy("label", "predicted").agg(F.count("*").alias("n"))
    total = n.groupBy("label").agg(F.sum("n").alias("total"))
    return n.join(total, "label").select("label", "predicted", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))
