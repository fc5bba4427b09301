"""Nearest-centroid predictor in column expressions, for checks without a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.functions.text import with_parsed_label
from labelscope.domain import class_array


def fit_centroids(vectors: DataFrame, dims: int) -> DataFrame:
    """Mean vector per label over the first ``dims`` places, as one row of an array.

    Places are averaged as plain columns with partial aggregation: one row per
    label is shuffled, and the result is bounded by labels x dims.
    """
    means = ", ".join(f"avg(double(embedding[{i}]))" for i in range(dims))
    per_label = vectors.groupBy("label").agg(F.expr(f"array({means})").alias("center"))
    return per_label.agg(F.array_sort(F.collect_list(F.struct("label", "center"))).alias("centroids"))


def _distance(vector: Column, center: Column) -> Column:
    squares = F.zip_with(center, vector, lambda c, x: (c - x.cast("double")) * (c - x.cast("double")))
    return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)


def score_centroid(vectors: DataFrame, dims: int) -> DataFrame:
    """Answer every vector with the class of its nearest centroid, lowest label on ties."""
    placed = vectors.withColumn("centroids", fit_centroids(vectors, dims).scalar())
    vector = F.slice("embedding", 1, dims)
    nearest = F.array_min(
        F.transform(
            "centroids",
            lambda c: F.struct(_distance(vector, c["center"]).alias("d"), c["label"].alias("label")),
        )
    )["label"]
    named = placed.withColumn("raw_output", F.element_at(class_array(), nearest + 1))
    return with_parsed_label(named.drop("centroids"))
