"""Counts of entities and properties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake.operators.joins import class_properties
from quadlake.quads import SUBJECT, of_type


def count_entities(quads: DataFrame, classes: Sequence[str]) -> DataFrame:
    """(g, class, entities): distinct subjects of each class in each graph."""
    return (of_type(quads, *classes).distinct()
            .groupBy("g", "class").agg(F.count(F.lit(1)).alias("entities")))


def count_with_property(quads: DataFrame, classes: Sequence[str],
                        properties: Sequence[str]) -> DataFrame:
    """(g, class, property, entities): distinct subjects of the class that have the property.

    The quads are reduced to distinct (g, s, p) before they are joined, so a
    subject with very many values of one property adds one row.
    """
    if not properties:
        return class_properties(quads, classes).where(F.lit(False)).select(
            "g", "class", F.col("p").alias("property"), F.lit(0).cast("bigint").alias("entities"))
    has = quads.where(F.col("p").isin(*properties)).select("g", *SUBJECT, "p").distinct()
    typed = of_type(quads, *classes).distinct()
    return (typed.join(has, ["g", *SUBJECT])
            .groupBy("g", "class", F.col("p").alias("property"))
            .agg(F.count(F.lit(1)).alias("entities")))
