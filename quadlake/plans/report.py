"""Roll-ups of validation results and summaries as quads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.functions.terms import key_hash, packed
from quadlake.operators.counts import count_entities
from quadlake.operators.joins import union_of
from quadlake.operators.records import insert, link, text
from quadlake.quads import of_type
from quadlake.session import cut
from quadlake.spec import CLASSES
from quadlake.vocab import (
    CLASS_SUMMARY_PREFIX, ENDPOINT_URL, PUBLIC_GRAPH, RDF_TYPE, RULE_SUMMARY_PREFIX, SHV,
    SUMMARY_PREFIX, UUID, XSD_INTEGER,
)

_GROUP = ["g", "class", "path", "shape", "severity"]


def focus_classes(results: DataFrame, quads: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    """results with the class of the focus node in the data graph g, one row per class."""
    typed = of_type(quads, *classes).select(
        "g", F.col("s").alias("focus"), F.col("s_kind").alias("focus_kind"), "class")
    return results.join(typed, ["g", "focus", "focus_kind"])


def rollup(results: DataFrame, quads: DataFrame, classes: Sequence[str] = CLASSES,
           keyed: bool = True) -> DataFrame:
    """(g, class, path, shape, severity, count): distinct results per group.

    A focus node of two classes counts under both; one of none is left out, as
    is a result without severity. ``keyed`` says that result_id is unique: the
    rows of one focus node are then added up before they meet its classes, so a
    node with very many results is one row in the join.
    """
    valid = results.where(F.col("severity").isNotNull())
    node = ["g", "focus", "focus_kind", "path", "shape", "severity"]
    if not keyed:
        valid = valid.where(F.col("result_id").isNotNull()).select(*node, packed(F.col("result_id")).alias("key"))
        return focus_classes(valid, quads, classes).groupBy(*_GROUP).agg(F.count_distinct("key").alias("count"))
    per_node = valid.groupBy(*node).agg(F.count(F.lit(1)).alias("n"))
    return focus_classes(per_node, quads, classes).groupBy(*_GROUP).agg(F.sum("n").alias("count"))


def of_data_graphs(results: DataFrame, graphs: DataFrame) -> DataFrame:
    """Results read from result graphs, with the data graph as g; roll them up with keyed=False.

    ``graphs`` is the frame of ``jobs.result_graphs``, a row per run. A result graph
    without a record has no data graph and is left out.
    """
    named = graphs.select(F.col("result_graph").alias("g"), "data_graph")
    return results.join(named, "g").drop("g").withColumnRenamed("data_graph", "g")


def rollup_nested(rolled: DataFrame) -> DataFrame:
    """(g, class, rows): the groups of a class as a list, as long as the shapes make it."""
    row = F.struct("path", "shape", "severity", "count")
    return rolled.groupBy("g", "class").agg(F.sort_array(F.collect_list(row)).alias("rows"))


def rollup_total(rolled: DataFrame) -> DataFrame:
    """(g, total_violations): a result counts once per group it is in."""
    return rolled.groupBy("g").agg(F.sum("count").alias("total_violations"))


def distinct_results(results: DataFrame, quads: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    """(g, results, dropped): results once each, and how many the roll-up leaves out."""
    typed = of_type(quads, *classes).select(
        "g", F.col("s").alias("focus"), F.col("s_kind").alias("focus_kind")).distinct()
    node = ["g", "focus", "focus_kind"]
    per_node = results.groupBy(*node).agg(F.count(F.lit(1)).alias("n"), F.count("severity").alias("n_severe"))
    known = per_node.join(typed.withColumn("known", F.lit(True)), node, "left")
    kept = F.sum(F.when(F.col("known"), F.col("n_severe")).otherwise(0))
    return known.groupBy("g").agg(F.sum("n").alias("results"), (F.sum("n") - kept).alias("dropped"))


# -- summaries -------------------------------------------------------------

def _id(run: str, *parts: str) -> Column:
    return key_hash(F.lit(run), *parts)


def _nodes(run: str, level: Sequence[str], prefix: str) -> tuple[Column, Column]:
    """(IRI, uuid) of a summary node identified by the columns of its level."""
    number = _id(run, *level)
    return F.concat(F.lit(prefix), number), number


def summary_iri(run: str, by: str = "g") -> Column:
    """The IRI of the summary that a run writes for a graph (or a task)."""
    return _nodes(run, [by], SUMMARY_PREFIX)[0]


def coverage_summary(covered: DataFrame, run: str, endpoints: DataFrame | None = None,
                     graph: str = PUBLIC_GRAPH, by: str = "g") -> DataFrame:
    """Quads of a coverage run: one summary per data graph, its classes and rules.

    ``endpoints`` may give (g, url). Zeros are written too. With ``by="task"``
    the rows of covered carry a task and each task has a summary of its own. The
    rows, a rule set per graph, are written first, as all levels use them.
    """
    covered = cut(covered)
    summary, summary_id = _nodes(run, [by], SUMMARY_PREFIX)
    cls, cls_id = _nodes(run, [by, "class"], CLASS_SUMMARY_PREFIX)
    rule, rule_id = _nodes(run, [by, "class", "requirement", "property"], RULE_SUMMARY_PREFIX)
    totals = covered.groupBy(by).agg(F.sum("violation_count").alias("total_violations"))
    heads = (totals.join(endpoints, by, "left") if endpoints is not None
             else totals.withColumn("url", F.lit(None).cast("string")))
    classes = covered.groupBy(by, "class").agg(F.max("total_entities").alias("total_entities"))
    return union_of(
        insert(heads, graph, [
            link(summary, RDF_TYPE, SHV + "ValidationSummary"), text(summary, UUID, summary_id),
            text(summary, ENDPOINT_URL, F.col("url")),
            text(summary, SHV + "totalViolations", F.col("total_violations"), XSD_INTEGER)]),
        insert(classes, graph, _class_node(summary, cls, cls_id, F.col("total_entities"))),
        insert(covered, graph, [
            *_rule_node(cls, rule, rule_id, F.col("violation_count")),
            link(rule, SHV + "hasRuleConstraint", F.col("property"))]),
    )


def _class_node(summary: Column, cls: Column, cls_id: Column, entities: Column) -> list:
    return [link(summary, SHV + "hasTargetClassSummary", cls), link(cls, RDF_TYPE, SHV + "TargetClassSummary"),
            text(cls, UUID, cls_id), link(cls, SHV + "hasTargetClass", F.col("class")),
            text(cls, SHV + "resourceCount", entities, XSD_INTEGER)]


def _rule_node(cls: Column, rule: Column, rule_id: Column, count: Column) -> list:
    return [link(cls, SHV + "hasRuleSummary", rule), link(rule, RDF_TYPE, SHV + "RuleSummary"),
            text(rule, UUID, rule_id), text(rule, SHV + "violationCount", count, XSD_INTEGER),
            link(rule, SHV + "hasSeverity", F.col("severity"))]


def validation_summary(rolled: DataFrame, quads: DataFrame, run: str, graph: str = PUBLIC_GRAPH,
                       classes: Sequence[str] = CLASSES) -> DataFrame:
    """Quads of a validation run; only classes with results have a node.

    A validated graph without results has a summary with a total of zero.
    """
    rolled = cut(rolled)
    summary, summary_id = _nodes(run, ["g"], SUMMARY_PREFIX)
    cls, cls_id = _nodes(run, ["g", "class"], CLASS_SUMMARY_PREFIX)
    rule, rule_id = _nodes(run, ["g", "class", "path", "shape", "severity"], RULE_SUMMARY_PREFIX)
    zero = F.lit(0).cast("bigint")
    graphs = quads.select("g").distinct().select("g", zero.alias("total_violations"))
    totals = rollup_total(rolled).unionByName(graphs).groupBy("g").agg(
        F.sum("total_violations").alias("total_violations"))
    entities = count_entities(quads, classes)
    per_class = rolled.select("g", "class").distinct().join(entities, ["g", "class"])
    return union_of(
        insert(totals, graph, [
            link(summary, RDF_TYPE, SHV + "ValidationSummary"), text(summary, UUID, summary_id),
            text(summary, SHV + "totalViolations", F.col("total_violations"), XSD_INTEGER)]),
        insert(per_class, graph, _class_node(summary, cls, cls_id, F.col("entities"))),
        insert(rolled, graph, [
            *_rule_node(cls, rule, rule_id, F.col("count")),
            link(rule, SHV + "hasRuleConstraint", F.col("path")),
            link(rule, SHV + "hasRule", F.col("shape"))]),
    )


# -- text ------------------------------------------------------------------

def report_lines(results: DataFrame) -> DataFrame:
    """(g, result_id, line): the report as lines, one per result; write it with ``write.text``."""
    part = [F.lit("severity"), F.element_at(F.split("severity", "#"), -1), F.lit("focus"), F.col("focus"),
            F.lit("path"), F.coalesce("path", F.lit("-")), F.lit("value"), F.coalesce("value", F.lit("-")),
            F.lit("shape"), F.col("shape"), F.lit("message"), F.col("message")]
    return results.select("g", "result_id", F.concat_ws(" ", *part).alias("line"))


def report_text(results: DataFrame, checked: DataFrame) -> DataFrame:
    """(g, text): whether each graph conforms and its results by severity and component.

    One line per severity and component, so the text stays short however many
    results there are; the results themselves are in ``report_lines``.
    ``checked`` is the frame of ``validation.conforms``.
    """
    local = [F.element_at(F.split(c, "#"), -1).alias(c) for c in ("severity", "component")]
    groups = results.groupBy("g", "severity", "component").agg(F.count(F.lit(1)).alias("n")).select("g", *local, "n")
    line = F.concat_ws(" ", "severity", "component", F.col("n").cast("string"))
    bodies = groups.groupBy("g").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("body"))
    head = F.concat(F.lit("Conforms: "), F.col("conforms").cast("string"),
                    F.lit("\nResults: "), F.col("results").cast("string"))
    return checked.join(bodies, "g", "left").select("g", F.concat_ws("\n", head, "body").alias("text"))
