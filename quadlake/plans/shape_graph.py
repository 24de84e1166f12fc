"""Shapes as quads of a shapes graph, and the table of shapes from them.

What is read: targets (class, node, subjects and objects of a predicate, and shapes that are
classes), paths of steps, all core components, severity, message, deactivated. Blank nodes
get IRIs, scoped by their graph. What a shapes graph says beyond that is in ``unread``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.operators.lists import list_members, list_quads
from quadlake.operators.scan import skolemize
from quadlake.plans.paths import INVERSE, REPEATS, STEP_TEXT, path_quads, path_texts
from quadlake.plans.shapes import FRAME_SCHEMA, Shape
from quadlake.quads import QUAD_SCHEMA
from quadlake.session import MAX_LOCAL_ROWS, cut, local_frame
from quadlake.vocab import (
    IRI, LITERAL, OWL, RDF_NIL, RDF_TYPE, RDFS, SH, SKOLEM_BASE, XSD_BOOLEAN, XSD_INTEGER, XSD_STRING,
)

_TARGETS = {"class": SH + "targetClass", "node": SH + "targetNode", "subjectsOf": SH + "targetSubjectsOf",
            "objectsOf": SH + "targetObjectsOf"}
# Components by the form of their parameters; the local name of the predicate is the component.
_BOUNDS = ("minInclusive", "maxInclusive", "minExclusive", "maxExclusive")
_COUNTS = ("minCount", "maxCount")
_VALUES = ("datatype", "class", "nodeKind", "minLength", "maxLength", "pattern")
_PAIRS = ("equals", "disjoint", "lessThan", "lessThanOrEquals")
_SHAPES = ("node", "property", "not")
_SHAPE_LISTS = ("and", "or", "xone")
_TERM_LISTS = ("languageIn", "in")
_SINGLE = (*_BOUNDS, *_COUNTS, *_VALUES, *_PAIRS, *_SHAPES, "hasValue", "uniqueLang", "closed")
# Predicates of shapes that are read along with others, or say nothing about validity.
_BESIDE = ("path", "flags", "severity", "message", "deactivated", "ignoredProperties", "qualifiedValueShape",
           "qualifiedMinCount", "qualifiedMaxCount", "qualifiedValueShapesDisjoint")
_SILENT = ("name", "description", "order", "group", "defaultValue")
_TYPES = (SH + "NodeShape", SH + "PropertyShape")
_CLASSES = (RDFS + "Class", OWL + "Class")


def _names(*components: str) -> list[str]:
    return [SH + c for c in components]


# -- writing ---------------------------------------------------------------

def _node(*parts: str) -> str:
    return SKOLEM_BASE + hashlib.sha256("\x1f".join(parts).encode()).hexdigest()


def _written(s: Shape) -> tuple[list, list, list]:
    """(p, o, kind, dt, lang) of a shape's own quads, (subject, p, members) of its lists, and the
    property shapes that a closed shape needs for the predicates it allows."""
    out: list[tuple] = []
    lists: list[tuple] = []
    allowed: list[str] = []

    def iri(p: str, o: str) -> None:
        out.append((p, o, IRI, "", ""))

    def text(p: str, o: str, dt: str = XSD_STRING) -> None:
        out.append((p, o, LITERAL, dt, ""))

    iri(RDF_TYPE, _TYPES[1] if s.path else _TYPES[0])
    for kind, target in s.targets:
        if kind == "implicit":
            iri(RDF_TYPE, _CLASSES[0])
        else:
            iri(_TARGETS[kind], target)
    if s.predicate:
        iri(SH + "path", s.predicate)
    elif s.path:
        iri(SH + "path", _node("path", s.id))
    iri(SH + "severity", s.severity)
    if s.message is not None:
        text(SH + "message", s.message)
    if s.deactivated:
        text(SH + "deactivated", "true", XSD_BOOLEAN)
    for n, (c, p) in enumerate(s.constraints):
        shapes = [x for x in p.get("shapes", "").split("\n") if x]
        if c in _BOUNDS:
            text(SH + c, p["value"], p.get("dt", XSD_STRING))
        elif c in _COUNTS:
            text(SH + c, p["count"], XSD_INTEGER)
        elif c in ("minLength", "maxLength"):
            text(SH + c, p["value"], XSD_INTEGER)
        elif c == "pattern":
            text(SH + c, p["value"])
            if p.get("flags"):
                text(SH + "flags", p["flags"])
        elif c in ("datatype", "class"):
            iri(SH + c, p["value"])
        elif c == "nodeKind":
            iri(SH + c, SH + p["value"])
        elif c in _PAIRS:
            iri(SH + c, p["predicate"])
        elif c in _SHAPES:
            for inner in shapes:
                iri(SH + c, inner)
        elif c == "hasValue":
            out.append((SH + c, p["value"], p.get("kind", IRI), p.get("dt", ""), p.get("lang", "")))
        elif c == "uniqueLang":
            text(SH + c, p.get("value", "true"), XSD_BOOLEAN)
        elif c in _SHAPE_LISTS:
            lists.append((str(n), SH + c, [(x, IRI, "", "") for x in shapes]))
        elif c == "languageIn":
            lists.append((str(n), SH + c, [(x, LITERAL, XSD_STRING, "") for x in p["values"].split("\n") if x]))
        elif c == "in":
            entries = [x.split(" ", 3) for x in p["values"].split("\n") if x]
            lists.append((str(n), SH + c, [(value, kind, dt, lang) for kind, dt, lang, value in entries]))
        elif c == "closed":
            text(SH + c, "true", XSD_BOOLEAN)
            allowed += [x for x in p.get("allowed", "").split("\n") if x]
            ignored = [x for x in p.get("ignored", "").split("\n") if x]
            lists.append((str(n), SH + "ignoredProperties", [(x, IRI, "", "") for x in ignored]))
        elif c == "qualified" and not p.get("disjoint"):
            iri(SH + "qualifiedValueShape", p["shapes"])
            for limit, name in (("min", "qualifiedMinCount"), ("max", "qualifiedMaxCount")):
                if limit in p:
                    text(SH + name, p[limit], XSD_INTEGER)
        else:
            raise ValueError(f"{s.id}: {c} has no core predicates of its own")
    return out, lists, allowed


def shape_quads(spark: SparkSession, shapes: Iterable[Shape], graph: str, most: int = MAX_LOCAL_ROWS) -> DataFrame:
    """The quads of a shapes graph. A closed shape names the predicates it allows by property
    shapes without constraints. Spark conditions and qualified shapes with named siblings have
    no core predicates: an error. ``most`` bounds the rows of metadata of each kind."""
    rows, members, paths = [], [], []
    for s in shapes:
        own, lists, allowed = _written(s)
        rows += [(graph, s.id, IRI, *row) for row in own]
        for number, p, found in lists:
            head = _node("list", s.id, number) if found else RDF_NIL
            rows.append((graph, s.id, IRI, p, head, IRI, "", ""))
            members += [(graph, head, place, *x) for place, x in enumerate(found)]
        for predicate in allowed:
            node = _node("allowed", s.id, predicate)
            rows += [(graph, s.id, IRI, SH + "property", node, IRI, "", ""),
                     (graph, node, IRI, SH + "path", predicate, IRI, "", "")]
        if s.path and not s.predicate:
            paths.append((graph, _node("path", s.id), s.path_text))
    lists = local_frame(spark, members, "g string, head string, place bigint, o string, o_kind string, o_dt string, o_lang string", most)
    structure = path_quads(local_frame(spark, paths, "g string, node string, path string", most))
    return local_frame(spark, rows, QUAD_SCHEMA, most).unionByName(list_quads(lists)).unionByName(structure).distinct()


# -- reading ---------------------------------------------------------------

def _params(**entries: Column) -> Column:
    """A map of the entries that are not null."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in entries.items()])
    return F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull()))


def _lines(values: Column) -> Column:
    """Entries one per line, in the order of their places; a line break inside one is an error."""
    one = F.transform(F.array_sort(F.collect_list(F.struct("place", values.alias("entry")))), lambda x: x["entry"])
    broken = F.exists(one, lambda x: F.contains(x, F.lit("\n")))
    return F.when(broken, F.raise_error(F.lit("a list entry of a shape holds a line break"))).otherwise(F.array_join(one, "\n"))


def _one(quads: DataFrame, name: str, alias: str) -> DataFrame:
    """(g, s, alias): the least object of a predicate that should have one."""
    return quads.where(F.col("p") == SH + name).groupBy("g", "s").agg(F.min("o").alias(alias))


def _is_true(col: Column) -> Column:
    return F.coalesce(col.isin("true", "1"), F.lit(False))


def _lists(quads: DataFrame, members: DataFrame, *names: str) -> DataFrame:
    """(g, s, p, head, place, o...): members of the lists that the predicates name."""
    links = quads.where(F.col("p").isin(_names(*names))).select("g", "s", "p", F.col("o").alias("head"), F.col("o_kind").alias("head_kind"))
    return links.join(members, ["g", "head", "head_kind"])


def _single(quads: DataFrame) -> DataFrame:
    """Constraints that are one quad each, but for flags."""
    name = F.substring_index("p", "#", -1)
    o, none = F.col("o"), F.lit(None).cast("string")
    found = quads.where(F.col("p").isin(_names(*(c for c in _SINGLE if c != "closed")))).join(
        _one(quads, "flags", "flags"), ["g", "s"], "left")
    literal = F.col("o_kind") == LITERAL
    entries = _params(
        value=F.when(name == "nodeKind", F.substring_index(o, "#", -1)).when(name.isin(*_BOUNDS, *_VALUES, "hasValue"), o),
        dt=F.when(name.isin(*_BOUNDS) | ((name == "hasValue") & literal), F.col("o_dt")),
        kind=F.when((name == "hasValue") & literal, F.col("o_kind")),
        lang=F.when((name == "hasValue") & literal & (F.col("o_lang") != ""), F.col("o_lang")),
        count=F.when(name.isin(*_COUNTS), o), predicate=F.when(name.isin(*_PAIRS), o),
        shapes=F.when(name.isin(*_SHAPES), o), flags=F.when(name == "pattern", F.col("flags")).otherwise(none))
    return found.where((name != "uniqueLang") | _is_true(o)).select("s", name.alias("component"), entries.alias("params"))


def _listed(quads: DataFrame, members: DataFrame) -> DataFrame:
    """Constraints whose parameter is a list; the empty list is a list too."""
    name = F.substring_index("p", "#", -1)
    entry = F.when(name == "in", F.concat_ws(" ", "o_kind", "o_dt", "o_lang", "o")).otherwise(F.col("o"))
    found = _lists(quads, members, *_SHAPE_LISTS, *_TERM_LISTS).groupBy("g", "s", "p", "head").agg(_lines(entry).alias("lines"))
    empty = quads.where(F.col("p").isin(_names(*_SHAPE_LISTS, *_TERM_LISTS)) & (F.col("o") == RDF_NIL)).select(
        "g", "s", "p", F.col("o").alias("head"), F.lit("").alias("lines"))
    shapes = name.isin(*_SHAPE_LISTS)
    return found.unionByName(empty).select("s", name.alias("component"), _params(
        shapes=F.when(shapes, F.col("lines")), values=F.when(~shapes, F.col("lines"))).alias("params"))


def _closed(quads: DataFrame, members: DataFrame) -> DataFrame:
    """A closed shape allows the predicates that its property shapes have as paths."""
    closed = quads.where((F.col("p") == SH + "closed") & _is_true(F.col("o"))).select("g", "s").distinct()
    inner = quads.where(F.col("p") == SH + "property").select("g", "s", F.col("o").alias("inner"))
    paths = quads.where((F.col("p") == SH + "path") & (F.col("o_kind") == IRI)).select("g", F.col("s").alias("inner"), F.col("o").alias("path"))
    complex_ = quads.where(F.col("p").isin(INVERSE, SH + "alternativePath", *REPEATS.values())).select("g", F.col("s").alias("path"))
    heads = members.select("g", F.col("head").alias("path"))
    allowed = (closed.join(inner, ["g", "s"]).join(paths, ["g", "inner"]).join(complex_, ["g", "path"], "left_anti")
               .join(heads, ["g", "path"], "left_anti").groupBy("g", "s")
               .agg(F.array_join(F.array_sort(F.collect_set("path")), "\n").alias("allowed")))
    ignored = _lists(quads, members, "ignoredProperties").groupBy("g", "s", "head").agg(_lines(F.col("o")).alias("ignored"))
    return closed.join(allowed, ["g", "s"], "left").join(ignored, ["g", "s"], "left").select(
        "s", F.lit("closed").alias("component"), _params(allowed=F.col("allowed"), ignored=F.col("ignored")).alias("params"))


def _qualified(quads: DataFrame) -> DataFrame:
    """Qualified counts; the siblings of a disjoint one are the qualified shapes of the other
    property shapes below the same parent."""
    own = quads.where(F.col("p") == SH + "qualifiedValueShape").select("g", "s", F.col("o").alias("shapes"))
    apart = quads.where((F.col("p") == SH + "qualifiedValueShapesDisjoint") & _is_true(F.col("o"))).select("g", "s")
    child = quads.where(F.col("p") == SH + "property").select("g", F.col("s").alias("parent"), F.col("o").alias("s"))
    below = child.join(own, ["g", "s"])
    other = below.select("g", "parent", F.col("s").alias("sibling"), F.col("shapes").alias("theirs"))
    siblings = (below.join(apart, ["g", "s"], "left_semi").join(other, ["g", "parent"]).where("s <> sibling AND theirs <> shapes")
                .groupBy("g", "s", "shapes").agg(F.array_join(F.array_sort(F.collect_set("theirs")), "\n").alias("disjoint")))
    found = own.join(siblings, ["g", "s", "shapes"], "left")
    for name, alias in (("qualifiedMinCount", "min"), ("qualifiedMaxCount", "max")):
        found = found.join(_one(quads, name, alias), ["g", "s"], "left")
    return found.select("s", F.lit("qualified").alias("component"), _params(
        shapes=F.col("shapes"), disjoint=F.col("disjoint"), min=F.col("min"), max=F.col("max")).alias("params"))


def _paths(quads: DataFrame, members: DataFrame) -> DataFrame:
    """(s, path): the steps of each shape's path; a path that steps cannot say is an error."""
    links = quads.where(F.col("p") == SH + "path").select("g", "s", F.col("o").alias("node"), F.col("o_kind").alias("node_kind"))
    named = links.join(path_texts(quads, members), ["g", "node", "node_kind"], "left")
    # A blank node that says no path is no predicate either.
    blank = F.startswith("node", F.lit(SKOLEM_BASE))
    text = F.coalesce("path", F.when(blank, F.col("node")).otherwise(F.concat(F.lit("<"), "node", F.lit(">"))))
    steps = F.transform(F.regexp_extract_all("text", F.lit(STEP_TEXT), 1), lambda x: F.struct(
        F.concat(F.regexp_extract(x, r"^(\^?)", 1), F.regexp_extract(x, r"([?+*]?)$", 1)).alias("op"),
        F.regexp_replace(x, r"^\^?\(?<|>\)?[?+*]?$|(?<=\|)<|>(?=\|)", "").alias("iri")))
    unsaid = F.raise_error(F.concat(F.lit("a path that is not a sequence of steps: "), "text"))
    return named.groupBy("s").agg(F.min(text).alias("text")).select(
        "s", F.when(F.col("text").rlike(f"^{STEP_TEXT}(?:/{STEP_TEXT})*$"), steps).otherwise(unsaid).alias("path"))


def _shape_ids(quads: DataFrame, members: DataFrame) -> DataFrame:
    """(s): what is typed as a shape, has a target, a path or a constraint, or is named as an inner shape."""
    marks = [*_TARGETS.values(), *_names(*_SINGLE, *_SHAPE_LISTS, *_TERM_LISTS, "path", "qualifiedValueShape")]
    typed = (F.col("p") == RDF_TYPE) & F.col("o").isin(*_TYPES)
    named = quads.where(F.col("p").isin(_names(*_SHAPES, "qualifiedValueShape"))).select(F.col("o").alias("s"))
    listed = _lists(quads, members, *_SHAPE_LISTS).select(F.col("o").alias("s"))
    return quads.where(typed | F.col("p").isin(marks)).select("s").unionByName(named).unionByName(listed).distinct()


def shapes_from_quads(quads: DataFrame) -> DataFrame:
    """The table of shapes (see ``shapes.to_frame``) that the quads of shapes graphs describe.

    A shape without a severity is a violation; of several messages the least is taken. The
    flags of a shape go to all its patterns. A graph without shapes gives no rows.
    """
    quads = cut(skolemize(quads).distinct())
    members = cut(list_members(quads))
    targets = [quads.where(F.col("p") == p).select("s", F.lit(kind).alias("target_kind"), F.col("o").alias("target"))
               for kind, p in _TARGETS.items()]
    ids = cut(_shape_ids(quads, members))
    implicit = quads.where((F.col("p") == RDF_TYPE) & F.col("o").isin(*_CLASSES)).select("s").distinct().join(ids, "s").select(
        "s", F.lit("implicit").alias("target_kind"), F.lit("").alias("target"))
    target = reduce(DataFrame.unionByName, [*targets, implicit]).distinct()
    constraints = reduce(DataFrame.unionByName, [
        _single(quads), _listed(quads, members), _closed(quads, members), _qualified(quads)])
    about = quads.where(F.col("p").isin(_names("severity", "message", "deactivated"))).groupBy("s").agg(
        F.min(F.when(F.col("p") == SH + "severity", F.col("o"))).alias("severity"),
        F.min(F.when(F.col("p") == SH + "message", F.col("o"))).alias("message"),
        F.max(F.when(F.col("p") == SH + "deactivated", _is_true(F.col("o")))).alias("deactivated"))
    shapes = ids
    for frame in (target, _paths(quads, members), constraints, about):
        shapes = shapes.join(frame, "s", "left")
    empty = F.array().cast("array<struct<op:string,iri:string>>")
    found = shapes.select(
        F.col("s").alias("shape_id"), "target_kind", "target", F.coalesce("path", empty).alias("path"), "component", "params",
        F.coalesce("severity", F.lit(SH + "Violation")).alias("severity"), "message",
        F.coalesce("deactivated", F.lit(False)).alias("deactivated"))
    return cut(found).to(local_frame(quads.sparkSession, [], FRAME_SCHEMA).schema)


def unread(quads: DataFrame) -> DataFrame:
    """The quads about shapes that ``shapes_from_quads`` does not read: custom components, SPARQL, rules.

    Names, descriptions, order and groups say nothing about validity and are left out.
    """
    quads = skolemize(quads)
    read = [*_TARGETS.values(), *_names(*_SINGLE, *_SHAPE_LISTS, *_TERM_LISTS, *_BESIDE, *_SILENT),
            INVERSE, SH + "alternativePath", *REPEATS.values()]
    return quads.where(F.startswith("p", F.lit(SH)) & ~F.col("p").isin(read))
