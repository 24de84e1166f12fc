"""Records to quads and back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.quads import QUAD
from quadlake.vocab import IRI, LITERAL, XSD_STRING


class Triple(NamedTuple):
    """Template of one triple over the columns of a solution frame."""

    s: Column
    p: str | Column
    o: Column
    kind: str = LITERAL
    dt: str = XSD_STRING


def link(s: Column, p: str | Column, o: Column | str) -> Triple:
    """A triple whose object is an IRI."""
    return Triple(s, p, F.lit(o) if isinstance(o, str) else o, IRI)


def text(s: Column, p: str, o: Column | str, dt: str = XSD_STRING) -> Triple:
    """A triple whose object is a literal."""
    return Triple(s, p, F.lit(o) if isinstance(o, str) else o, LITERAL, dt)


def struct_of(t: Triple) -> Column:
    return F.struct(
        t.s.alias("s"), F.lit(IRI).alias("s_kind"),
        (F.lit(t.p) if isinstance(t.p, str) else t.p).alias("p"), t.o.cast("string").alias("o"),
        F.lit(t.kind).alias("o_kind"), F.lit(t.dt if t.kind == LITERAL else "").alias("o_dt"),
        F.lit("").alias("o_lang"),
    )


def insert(solutions: DataFrame, g: str | Column, template: Sequence[Triple]) -> DataFrame:
    """Quads of the template for every solution; unbound instances are skipped.

    The result may repeat a quad; writers remove that.
    """
    graph = F.lit(g) if isinstance(g, str) else g
    rows = solutions.select(graph.alias("g"), F.inline(F.array(*map(struct_of, template))))
    bound = F.col("g").isNotNull() & F.col("s").isNotNull() & F.col("p").isNotNull()
    return rows.where(bound & F.col("o").isNotNull()).select(*QUAD)


def records(quads: DataFrame, fields: Mapping[str, str], defaults: Mapping[str, str] | None = None,
            extra: Mapping[str, Column] | None = None) -> DataFrame:
    """(g, uri, field...): one record per subject that has any of the fields.

    A field with several values takes the smallest, one without a value its
    default; ``extra`` sets fields regardless of the quads.
    """
    picks = [F.min(F.when(F.col("p") == p, F.col("o"))).alias(name) for name, p in fields.items()]
    found = (
        quads.where(F.col("p").isin(*fields.values()))
        .groupBy("g", F.col("s").alias("uri"), "s_kind").agg(*picks).drop("s_kind")
    )
    for name, value in (defaults or {}).items():
        known = F.col(name) if name in found.columns else F.lit(None)
        found = found.withColumn(name, F.coalesce(known, F.lit(value)))
    return found.withColumns(dict(extra or {}))
