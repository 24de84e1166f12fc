"""Joins of patterns: stars, hops, paths, optional parts.

All joins are equi-joins that keep the graph in their keys. They carry no
hints: adaptive execution broadcasts a side it has measured to be small and
splits hot keys of a large one (see ``session.tune``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake.operators.scan import match
from quadlake.quads import OBJECT, SUBJECT, of_type
from quadlake.vocab import IRI, LITERAL, RDF_TYPE

_STAR = ["g", *SUBJECT]


def class_properties(quads: DataFrame, classes: Sequence[str],
                     properties: Sequence[str] | None = None) -> DataFrame:
    """(g, s, class, p, o...): every triple of each entity of the classes."""
    facts = quads if properties is None else quads.where(F.col("p").isin(*properties))
    return of_type(quads, *classes).join(facts.select(*_STAR, "p", *OBJECT), _STAR)


def values_of(quads: DataFrame, predicate: str, name: str) -> DataFrame:
    """(g, s, s_kind, name): the objects of one predicate under a new name."""
    return match(quads, p=predicate).select(*_STAR, F.col("o").alias(name))


def star(quads: DataFrame, fields: Mapping[str, str], cls: str | None = None) -> DataFrame:
    """Subjects that have every field, one row per combination of values."""
    frames = [values_of(quads, p, name) for name, p in fields.items()]
    if cls is not None:
        frames.insert(0, of_type(quads, cls).drop("class"))
    result = frames[0]
    for frame in frames[1:]:
        result = result.join(frame, _STAR)
    return result


def optional(left: DataFrame, right: DataFrame, on: Sequence[str] = tuple(_STAR)) -> DataFrame:
    """All of left; columns of right stay NULL where nothing matches."""
    return left.join(right, list(on), "left")


def hop(left: DataFrame, quads: DataFrame, predicate: str) -> DataFrame:
    """Follow the object of left along a predicate: left.o becomes the next object."""
    step = match(quads, p=predicate).select(
        "g", F.col("s").alias("o"), F.col("s_kind").alias("o_kind"),
        *[F.col(c).alias(f"next_{c}") for c in OBJECT])
    near = left.where(F.col("o_kind") != LITERAL).drop("o_dt", "o_lang")
    return near.join(step, ["g", "o", "o_kind"]).drop("o", "o_kind").withColumnsRenamed(
        {f"next_{c}": c for c in OBJECT})


def sequence(quads: DataFrame, *predicates: str) -> DataFrame:
    """(g, s, s_kind, o...) along p1/p2/...; the ways are counted, not only the ends."""
    found = match(quads, p=predicates[0])
    for p in predicates[1:]:
        found = hop(found, quads, p)
    return found.select(*_STAR, *OBJECT)


def path_value(quads: DataFrame, name: str, *predicates: str) -> DataFrame:
    """As ``sequence``, only the text of the end, under a new name."""
    return sequence(quads, *predicates).select(*_STAR, F.col("o").alias(name))


def union_of(*solutions: DataFrame) -> DataFrame:
    """UNION of solutions with the same variables; nothing is removed."""
    result = solutions[0]
    for other in solutions[1:]:
        result = result.unionByName(other)
    return result


def existing(solutions: DataFrame, quads: DataFrame, cls: str, column: str, g: str) -> DataFrame:
    """Solutions whose column names a subject of the class in the graph."""
    subjects = quads.where(
        (F.col("g") == g) & (F.col("p") == RDF_TYPE) & (F.col("o") == cls) & (F.col("o_kind") == IRI)
        & (F.col("s_kind") == IRI)).select(F.col("s").alias(column))
    return solutions.join(subjects, column, "left_semi")
