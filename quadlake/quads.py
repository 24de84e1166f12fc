"""The quad table: one row per statement of a named graph.

A frame of quads is a set. Writers keep it so (see ``sources.store``); the
operators rely on it where a count of rows has to be a count of triples.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadlake.vocab import BNODE, IRI, LANG_STRING, LITERAL, RDF_TYPE, XSD_STRING

QUAD_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType(), False)
     for c in ("g", "s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang")]
)
QUAD = QUAD_SCHEMA.fieldNames()
SUBJECT = ["s", "s_kind"]
OBJECT = ["o", "o_kind", "o_dt", "o_lang"]
FREE = {"s": SUBJECT, "p": ["p"], "o": OBJECT}


class Term(NamedTuple):
    """One RDF term. Datatype and language are '' where they do not apply."""

    kind: str
    value: str
    dt: str = ""
    lang: str = ""


def iri(value: str) -> Term:
    return Term(IRI, value)


def bnode(label: str) -> Term:
    return Term(BNODE, label)


def literal(value: str, dt: str = XSD_STRING, lang: str = "") -> Term:
    return Term(LITERAL, value, LANG_STRING if lang else dt, lang.lower())


def as_term(value: Term | str) -> Term:
    """A bare string stands for an IRI."""
    return value if isinstance(value, Term) else iri(value)


def is_subject(value: Term | str) -> Column:
    t = as_term(value)
    return (F.col("s") == t.value) & (F.col("s_kind") == t.kind)


def is_object(value: Term | str) -> Column:
    t = as_term(value)
    return (
        (F.col("o") == t.value) & (F.col("o_kind") == t.kind)
        & (F.col("o_dt") == t.dt) & (F.col("o_lang") == t.lang)
    )


def as_set(quads: DataFrame) -> DataFrame:
    """Quads in column order, each once."""
    return once(quads.select(*QUAD))


def once(rows: DataFrame) -> DataFrame:
    """Each row once. The rows are dealt out first: where few are repeated, a task that reads
    or derives very many would hold nearly all of them before the shuffle."""
    return rows.repartition(*rows.columns).dropDuplicates()


def sorted_once(rows: DataFrame, order: list[str]) -> DataFrame:
    """Each row once, range-partitioned and sorted by the columns of order.

    Equal rows lie in one part, so one shuffle serves the order and the set, and in the sorted
    part they follow each other: no task holds the rows of its part in a table.
    """
    every = [*order, *[c for c in rows.columns if c not in order]]
    first = F.row_number().over(Window.partitionBy(*every).orderBy(F.lit(0)))
    found = rows.repartitionByRange(*order).withColumn("_n", first).where("_n = 1").drop("_n")
    # The rows have this order already; it is said once more so that writers know.
    return found.sortWithinPartitions(*order)


def of_type(quads: DataFrame, *classes: str) -> DataFrame:
    """(g, s, s_kind, class) of the subjects typed with one of the classes."""
    typed = quads.where((F.col("p") == RDF_TYPE) & (F.col("o_kind") == IRI))
    if classes:
        typed = typed.where(F.col("o").isin(*classes))
    return typed.select("g", *SUBJECT, F.col("o").alias("class"))
