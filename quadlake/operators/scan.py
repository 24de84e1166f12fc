"""Scans: named graphs, triple patterns, existence, size, order and paging."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.functions.terms import kind_rank, or_undef, skolem
from quadlake.quads import FREE, QUAD, Term, is_object, is_subject, once
from quadlake.session import checkpoint_folder, cut, local_frame
from quadlake.vocab import BNODE, IRI, LITERAL, SKOLEM_BASE

# monotonically_increasing_id: partition above, row within it below.
_ROW_BITS = 33


def in_graph(quads: DataFrame, g: str) -> DataFrame:
    return quads.where(F.col("g") == g)


def default_graph(quads: DataFrame) -> DataFrame:
    """The union of all graphs, each triple once."""
    return once(quads.drop("g"))


def _bound(quads: DataFrame, s, p, o) -> DataFrame:
    if s is not None:
        quads = quads.where(is_subject(s))
    if p is not None:
        quads = quads.where(F.col("p") == p)
    if o is not None:
        quads = quads.where(is_object(o))
    return quads


def _free(s, p, o) -> list[str]:
    return [v for v, bound in (("s", s), ("p", p), ("o", o)) if bound is None]


def match(quads: DataFrame, s: Term | str | None = None, p: str | None = None,
          o: Term | str | None = None) -> DataFrame:
    """A pattern in any graph; the graph stays a column to join on."""
    columns = [c for v in _free(s, p, o) for c in FREE[v]]
    return _bound(quads, s, p, o).select("g", *columns)


def pattern(quads: DataFrame, g: str | None = None, s: Term | str | None = None,
            p: str | None = None, o: Term | str | None = None, order_by: str | None = None,
            limit: int | None = None, offset: int | None = None) -> DataFrame:
    """The solutions of one triple pattern, one column group per free variable.

    Without a graph the default graph is meant. A limit or an offset makes the
    order fixed: by ``order_by`` or else by the first free variable.
    """
    free = _free(s, p, o)
    if not free:
        raise ValueError("nothing is free; use ask")
    if order_by is not None and order_by not in free:
        raise ValueError(f"{order_by} is not a free variable")
    found = match(quads if g is None else in_graph(quads, g), s, p, o).drop("g")
    if g is None:
        found = found.distinct()
    if order_by is None and limit is None and offset is None:
        return found
    return page(found, term_order(found, order_by or free[0]), limit, offset)


def term_order(df: DataFrame, variable: str) -> list[Column]:
    """Sort keys: kind and text of the variable, then all other columns."""
    first = [kind_rank(F.col(f"{variable}_kind"))] if f"{variable}_kind" in df.columns else []
    return first + [F.col(variable)] + [F.col(c) for c in df.columns if c != variable]


class Pages:
    """The rows of a frame in order, kept as sorted parts: any page opens only the parts it lies in.

    The parts are written once, one folder each, with a number for every row; the driver keeps
    one count per part. All pages have the same plan, however deep, and a caller who turns
    pages sorts once. ``files`` tells how many parts a page opens.
    """

    def __init__(self, df: DataFrame, order: list[Column], parts: int | None = None):
        """parts: how many; if not given, adaptive execution sizes them."""
        spark = df.sparkSession
        path = f"{checkpoint_folder(spark).rstrip('/')}/pages-{uuid.uuid4()}"
        laid = df.orderBy(*order) if parts is None else df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        ranked = laid.withColumns({"_id": F.monotonically_increasing_id(), "_part": F.spark_partition_id()})
        ranked.write.partitionBy("_part").parquet(path)
        self.columns = df.columns
        self._rows = spark.read.schema(ranked.schema).parquet(path)
        sizes = sorted((r["_part"], r["count"]) for r in self._rows.groupBy("_part").count().collect())
        ends = list(accumulate(n for _, n in sizes))
        self._parts = [(part, end - n, end) for (part, n), end in zip(sizes, ends)]
        self.total = ends[-1] if ends else 0

    def _near(self, start: int, end: int) -> list[tuple[int, int, int]]:
        return [p for p in self._parts if p[1] < end and p[2] > start]

    def files(self, limit: int | None = None, offset: int = 0) -> int:
        return len(self._near(offset, self.total if limit is None else offset + limit))

    def numbered(self, limit: int | None = None, offset: int = 0) -> DataFrame:
        """Rows offset .. offset + limit with their number, row."""
        end = self.total if limit is None else min(self.total, offset + limit)
        near = self._near(offset, end)
        starts = local_frame(self._rows.sparkSession, [(part, first) for part, first, _ in near], "_part int, _start bigint", most=max(len(near), 1))
        within = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
        # One row for each part: the planner knows the size of both.
        rows = self._rows.where(F.col("_part").isin(*[part for part, _, _ in near])) if near else self._rows.where(F.lit(False))
        found = rows.join(starts, "_part").withColumn("row", F.col("_start") + within)
        return found.where((F.col("row") >= offset) & (F.col("row") < end)).select(*self.columns, "row")

    def page(self, limit: int | None = None, offset: int = 0) -> DataFrame:
        """Rows offset .. offset + limit in order."""
        return self.numbered(limit, offset).orderBy("row").drop("row")


def page(df: DataFrame, order: list[Column], limit: int | None = None,
         offset: int | None = None) -> DataFrame:
    """Rows offset .. offset + limit in the given order, by one plan at every depth."""
    start = offset or 0
    if limit is None and not start:
        return df.orderBy(*order)
    return Pages(df, order).page(limit, start)


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with the column row = 0, 1, ... in the given order, without a single-task sort."""
    return Pages(df, order).numbered()


def sorted_parts(df: DataFrame, order: list[Column]) -> DataFrame:
    """df in order, written as sorted parts, with _part and an _id that grows by 1 in each."""
    ranked = cut(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    return ranked.withColumn("_part", F.shiftright("_id", _ROW_BITS))


def after(df: DataFrame, variable: str, last: Mapping[str, str], limit: int) -> DataFrame:
    """The page that follows the row ``last`` of the page before: cheap at any depth."""
    order = term_order(df, variable)
    kinds = {BNODE: 1, IRI: 2, LITERAL: 3}
    names = [variable] + [c for c in df.columns if c != variable]
    ranks = [kinds[last[f"{variable}_kind"]]] if len(order) > len(names) else []
    seen = [F.lit(x) for x in ranks] + [F.lit(last[n]).cast(df.schema[n].dataType) for n in names]
    # The struct decides; the first condition says less, but reaches the files' statistics.
    near = F.col(variable) >= last[variable]
    if ranks:
        kind = F.col(f"{variable}_kind")
        near = (near & (kind == last[f"{variable}_kind"])) | kind.isin(*[k for k, r in kinds.items() if r > ranks[0]], "")
    return page(df.where(near).where(F.struct(*order) > F.struct(*seen)), order, limit)


def ask(quads: DataFrame, s: Term | str, p: str, o: Term | str, g: str | None = None) -> DataFrame:
    """One row: does the triple exist."""
    found = _bound(quads if g is None else in_graph(quads, g), s, p, o)
    return found.limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


def graph_size(quads: DataFrame) -> DataFrame:
    """(g, triples) for every graph in one pass."""
    return quads.groupBy("g").agg(F.count(F.lit(1)).alias("triples"))


def default_size(quads: DataFrame) -> DataFrame:
    return default_graph(quads).agg(F.count(F.lit(1)).alias("triples"))


def with_values(quads: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Keep the rows whose column is one of the given constants; none keeps none."""
    return quads.where(F.col(column).isin(*values)) if values else quads.where(F.lit(False))


def skolemize(quads: DataFrame, base: str = SKOLEM_BASE) -> DataFrame:
    """Blank nodes to IRIs. Labels are scoped by their graph."""
    scoped = quads
    for c in ("s", "o"):
        blank = F.col(f"{c}_kind") == BNODE
        label = F.concat(F.sha2("g", 256), F.lit("-"), F.col(c))
        scoped = (scoped.withColumn(c, skolem(F.when(blank, label).otherwise(F.col(c)), F.col(f"{c}_kind"), base))
                  .withColumn(f"{c}_kind", F.when(blank, IRI).otherwise(F.col(f"{c}_kind"))))
    return scoped.select(*QUAD)


def fill_unbound(df: DataFrame, *variables: str) -> DataFrame:
    """Unbound variables become urn:undef:<variable>."""
    return df.withColumns({v: or_undef(F.col(v), v) for v in variables})
