"""Checks of a catalogue that need no shapes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.quads import of_type
from quadlake.spec import CLASSES, SEVERITY, TYPOS


def lookup(table: Mapping[str, str], key: Column) -> Column:
    """Value of a small fixed map, NULL for an unknown key."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def severity_of(requirement: Column) -> Column:
    return lookup(SEVERITY, requirement)


def uri_reuse(quads: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    """(g, uri, types): subjects typed with more than one of the classes."""
    return (
        of_type(quads, *classes)
        .groupBy("g", F.col("s").alias("uri"), "s_kind")
        .agg(F.sort_array(F.collect_set("class")).alias("types"))
        .where(F.size("types") > 1).drop("s_kind")
    )


def type_lists(quads: DataFrame, classes: Sequence[str] = CLASSES, separator: str = ",") -> DataFrame:
    """(g, uri, types): the types of each subject joined into one text."""
    return (
        of_type(quads, *classes)
        .groupBy("g", F.col("s").alias("uri"), "s_kind")
        .agg(F.array_join(F.sort_array(F.collect_set("class")), separator).alias("types")).drop("s_kind")
    )


def capitalization_typos(quads: DataFrame, typos: Mapping[str, str] = TYPOS) -> DataFrame:
    """(g, typo, intended, count): class IRIs used as predicates."""
    return (
        quads.where(F.col("p").isin(*typos))
        .groupBy("g", F.col("p").alias("typo")).agg(F.count(F.lit(1)).alias("count"))
        .select("g", "typo", lookup(typos, F.col("typo")).alias("intended"), "count")
    )
