"""Validation of quads against shapes, one set-oriented plan per constraint family.

Frames used inside, all keyed by the number of the shape:

* focus (shape, g, f..., reported): nodes to check; ``reported`` is false where
  only the conformance of the node is asked for by an outer shape
* values (focus columns, v...): the value nodes of each focus node, each once
* findings (shape, rule, g, f..., v..., via, reported): the violations

Shapes are metadata: their few rows are the only frames with a broadcast hint.
Nested shapes are evaluated level by level, so the driver loops over the depth
of nesting, never over shapes, graphs or nodes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.functions.lexical import compare_class, compare_key, is_valid
from quadlake.functions.terms import mint, packed, unpacked
from quadlake.operators.closure import closure, edges_of
from quadlake.operators.joins import star
from quadlake.operators.records import insert, link, struct_of, text
from quadlake.operators.scan import match
from quadlake.plans.coverage import bit_places, subject_bits
from quadlake.plans.shapes import NESTED, VALUE_TESTS, Shape, from_frame
from quadlake.quads import OBJECT, QUAD, SUBJECT, of_type
from quadlake.session import cut, local_frame
from quadlake.vocab import (
    BNODE, IRI, LITERAL, RDF_TYPE, SH, SKOLEM_BASE, SUBCLASS_OF, XSD_BOOLEAN, XSD_STRING,
)

_F = ["f", "f_kind", "f_dt", "f_lang"]
_V = ["v", "v_kind", "v_dt", "v_lang"]
_FOCUS = ["shape", "g", *_F, "reported"]
_FINDING = ["shape", "rule", "g", *_F, *_V, "via", "reported"]

# Local names of the constraint components.
COMPONENT_NAMES = {
    "datatype": "Datatype", "nodeKind": "NodeKind", "minInclusive": "MinInclusive",
    "maxInclusive": "MaxInclusive", "minExclusive": "MinExclusive", "maxExclusive": "MaxExclusive",
    "minLength": "MinLength", "maxLength": "MaxLength", "pattern": "Pattern",
    "languageIn": "LanguageIn", "in": "In", "sql": "SPARQL", "node": "Node",
    "property": "PropertyShape", "not": "Not", "and": "And", "or": "Or", "xone": "Xone",
    "minCount": "MinCount", "maxCount": "MaxCount", "class": "Class", "uniqueLang": "UniqueLang",
    "equals": "Equals", "disjoint": "Disjoint", "lessThan": "LessThan",
    "lessThanOrEquals": "LessThanOrEquals", "closed": "Closed", "hasValue": "HasValue",
    "qualified_min": "QualifiedMinCount", "qualified_max": "QualifiedMaxCount",
}
# Node kinds and the kinds of term they allow.
NODE_KINDS = {
    "IRI": (IRI,), "BlankNode": (BNODE,), "Literal": (LITERAL,),
    "BlankNodeOrIRI": (BNODE, IRI), "BlankNodeOrLiteral": (BNODE, LITERAL),
    "IRIOrLiteral": (IRI, LITERAL),
}


# Columns that the table of value tests brings along.
_RULE_COLUMNS = ("rule", "component", "arg", "arg_dt", "arg_int", "args", "bound", "bound_class")


def component_iri(component: str) -> str:
    return f"{SH}{COMPONENT_NAMES[component]}ConstraintComponent"


def _listed(params, name: str) -> list[str]:
    """A list parameter, one entry per line."""
    return [x for x in params.get(name, "").split("\n") if x]


class _Rules:
    """Numbers of shapes and constraints, and the order of nested shapes."""

    def __init__(self, shapes: list[Shape]):
        self.shapes = shapes
        self.number = {s.id: i for i, s in enumerate(shapes)}
        if len(self.number) != len(shapes):
            raise ValueError("two shapes share an id")
        self.rules = [
            (i, c.component, c.params)
            for i, s in enumerate(shapes) if not s.deactivated for c in s.constraints
        ]
        self.inner: dict[int, set[int]] = {i: set() for i in range(len(shapes))}
        for i, component, params in self.rules:
            if component in NESTED or component == "qualified":
                self.inner[i] |= {self.number[x] for x in self.members(params)}
        self.level = self._levels()
        self._below: list[DataFrame | None] = []

    def classes(self) -> list[str]:
        """Every class that a target or a class constraint names."""
        named = {s.id if kind == "implicit" else target for s in self.shapes if not s.deactivated
                 for kind, target in s.targets if kind in ("class", "implicit")}
        return sorted(named | {p["value"] for _, c, p in self.rules if c == "class"})

    def below(self, quads: DataFrame) -> DataFrame | None:
        """Subclasses of all those classes, searched for once."""
        if not self._below:
            self._below.append(subclasses(quads, self.classes()))
        return self._below[0]

    def members(self, params) -> list[str]:
        return _listed(params, "shapes") + _listed(params, "disjoint")

    def _levels(self) -> list[int]:
        """Longest way from an outermost shape; a shape inside itself is refused."""
        level = [0] * len(self.shapes)
        for round_ in range(len(self.shapes) + 1):
            changed = False
            for i, inner in self.inner.items():
                for j in inner:
                    if level[j] <= level[i]:
                        level[j], changed = level[i] + 1, True
            if not changed:
                return level
        raise ValueError("a shape refers to itself")

    def of(self, level: int, *components: str) -> list[tuple[int, int, str, dict]]:
        """(rule, shape, component, params) of the active constraints on a level."""
        return [(r, s, c, p) for r, (s, c, p) in enumerate(self.rules)
                if self.level[s] == level and c in components]


def _union(frames: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, frames) if frames else None


def _focus_from(df: DataFrame, g, value, kind, dt, lang) -> DataFrame:
    return df.select("shape", g, value.alias("f"), kind.alias("f_kind"), dt.alias("f_dt"),
                     lang.alias("f_lang"), F.lit(True).alias("reported"))


# -- classes and targets ---------------------------------------------------

def subclasses(quads: DataFrame, classes: list[str]) -> DataFrame | None:
    """(g, class, sub) below each class in the data, or None where there are none."""
    edges = edges_of(quads, [SUBCLASS_OF], inverse=True).where((F.col("a_kind") == IRI) & (F.col("b_kind") == IRI))
    if not classes or edges.isEmpty():
        return None
    seeds = edges.where(F.col("a").isin(*classes))
    found = closure(edges, seeds).select("g", F.col("a").alias("class"), F.col("b").alias("sub"))
    found = cut(found.where(F.col("class") != F.col("sub")))
    return None if found.isEmpty() else found


def members(quads: DataFrame, classes: list[str], below: DataFrame | None) -> DataFrame:
    """(g, s, s_kind, class): instances, also through the given subclasses, each once."""
    direct = of_type(quads, *classes)
    if below is None:
        return direct
    wanted = below.where(F.col("class").isin(*classes))
    through = of_type(quads).withColumnRenamed("class", "sub").join(wanted, ["g", "sub"]).drop("sub")
    return direct.unionByName(through).distinct()


def _targets(quads: DataFrame, rules: _Rules, numbers: Iterable[int]) -> DataFrame | None:
    """Focus nodes of the numbered shapes by their own targets."""
    spark = quads.sparkSession
    wanted: dict[str, list[tuple[int, str]]] = {}
    per_shape = [0] * len(rules.shapes)
    for i in sorted(numbers):
        s = rules.shapes[i]
        for kind, target in s.targets if not s.deactivated else ():
            key = "class" if kind == "implicit" else kind
            wanted.setdefault(key, []).append((i, s.id if kind == "implicit" else target))
            per_shape[i] += 1

    def table(kind: str, name: str) -> DataFrame:
        return F.broadcast(local_frame(spark, wanted[kind], f"shape int, {name} string"))

    none = F.lit("")
    frames = []
    if "class" in wanted:
        classes = sorted({c for _, c in wanted["class"]})
        found = members(quads, classes, rules.below(quads)).join(table("class", "class"), "class")
        frames.append(_focus_from(found, "g", F.col("s"), F.col("s_kind"), none, none))
    if "node" in wanted:
        graphs = quads.select("g").distinct()
        nodes = F.array(*[F.struct(F.lit(i).alias("shape"), F.lit(n).alias("f")) for i, n in wanted["node"]])
        found = graphs.select("g", F.inline(nodes))
        frames.append(_focus_from(found, "g", F.col("f"), F.lit(IRI), none, none))
    for kind, term in (("subjectsOf", [F.col("s"), F.col("s_kind"), none, none]),
                       ("objectsOf", [F.col(c) for c in OBJECT])):
        if kind in wanted:
            found = (quads.where(F.col("p").isin(*sorted({p for _, p in wanted[kind]})))
                     .join(table(kind, "p"), "p"))
            frames.append(_focus_from(found, "g", *term).distinct())
    focus = _union(frames)
    return focus.distinct() if focus is not None and max(per_shape) > 1 else focus


def targets(quads: DataFrame, shapes: Iterable[Shape] | DataFrame) -> DataFrame:
    """(g, shape, focus, focus_kind): the focus nodes of each targeted shape."""
    rules = _Rules(_as_shapes(shapes))
    focus = _targets(quads, rules, range(len(rules.shapes)))
    return _named(focus, rules).select("g", F.col("shape_id").alias("shape"), F.col("f").alias("focus"),
                                       F.col("f_kind").alias("focus_kind"))


# -- paths -----------------------------------------------------------------

def _step(found: DataFrame, quads: DataFrame, step) -> DataFrame:
    """One step on from the value nodes."""
    edges = edges_of(quads, step.predicates, step.inverse)
    keys = ["g", *_V]
    if step.repeat:
        seeds = found.select("g", *[F.col(v).alias(a) for v, a in zip(_V, ("a", "a_kind", "a_dt", "a_lang"))])
        if step.repeat == "?":
            same = seeds.distinct().select("*", *[F.col(a).alias(b) for a, b in zip(
                ("a", "a_kind", "a_dt", "a_lang"), ("b", "b_kind", "b_dt", "b_lang"))])
            edges = edges.unionByName(same).distinct()
        else:
            edges = closure(edges, seeds, reflexive=step.repeat == "*")
    edges = edges.withColumnsRenamed({"a": "v", "a_kind": "v_kind", "a_dt": "v_dt", "a_lang": "v_lang"})
    following = found.join(edges, keys).drop(*_V).withColumnsRenamed(
        {"b": "v", "b_kind": "v_kind", "b_dt": "v_dt", "b_lang": "v_lang"})
    return following.select(*_FOCUS, *_V)


def _values(focus: DataFrame, quads: DataFrame, rules: _Rules, numbers: Iterable[int]) -> DataFrame:
    """The value nodes of each focus node of the numbered shapes, each once."""
    spark = quads.sparkSession
    here = [(i, rules.shapes[i]) for i in sorted(numbers)]
    own = [i for i, s in here if not s.path]
    simple = [(i, s.predicate) for i, s in here if s.predicate]
    by_path: dict[tuple, list[int]] = {}
    for i, s in here:
        if s.path and not s.predicate:
            by_path.setdefault(s.path, []).append(i)
    frames = []
    itself = [F.col(f).alias(v) for f, v in zip(_F, _V)]
    if own:
        frames.append(focus.where(F.col("shape").isin(*own)).select(*_FOCUS, *itself))
    if simple:
        table = F.broadcast(local_frame(spark, simple, "shape int, p string"))
        facts = quads.where(F.col("p").isin(*sorted({p for _, p in simple}))).select(
            "g", F.col("s").alias("f"), F.col("s_kind").alias("f_kind"), "p",
            *[F.col(o).alias(v) for o, v in zip(OBJECT, _V)])
        frames.append(focus.join(table, "shape").join(facts, ["g", "f", "f_kind", "p"]).select(*_FOCUS, *_V))
    for path, numbers in by_path.items():
        found = focus.where(F.col("shape").isin(*numbers)).select(*_FOCUS, *itself)
        for step in path:
            found = _step(found, quads, step)
        frames.append(found.distinct())
    return _union(frames)


def _facts(quads: DataFrame, rows: list, columns: str) -> DataFrame:
    """(columns, g, f, f_kind, v...): the quads of the predicate p of each row, whoever their subject is.

    Constraints on the values of one predicate are tested here, and only what fails meets its
    focus nodes (``_at_focus``).
    """
    table = _rule_table(quads.sparkSession, rows, columns)
    facts = quads.where(F.col("p").isin(*sorted({r[-1] for r in rows}))).select(
        "g", F.col("s").alias("f"), F.col("s_kind").alias("f_kind"), "p", *[F.col(o).alias(v) for o, v in zip(OBJECT, _V)])
    return facts.join(table, "p").drop("p")


def _at_focus(failed: DataFrame, focus: DataFrame) -> DataFrame:
    """The failed facts whose subject is a focus node of their shape."""
    return failed.join(focus.select(*_FOCUS), ["shape", "g", "f", "f_kind"])


def path_values(quads: DataFrame, shapes: Iterable[Shape] | DataFrame) -> DataFrame:
    """(g, shape, focus, focus_kind, value, value_kind, value_dt, value_lang) of targeted shapes."""
    rules = _Rules(_as_shapes(shapes))
    numbers = [i for i, s in enumerate(rules.shapes) if s.targets and not s.deactivated]
    found = _named(_values(_targets(quads, rules, numbers), quads, rules, numbers), rules)
    return found.select(
        "g", F.col("shape_id").alias("shape"), F.col("f").alias("focus"), F.col("f_kind").alias("focus_kind"),
        *[F.col(v).alias(v.replace("v", "value", 1)) for v in _V])


# -- constraint families ---------------------------------------------------

def _finding(df: DataFrame, has_value: bool = True, via: str | None = None) -> DataFrame:
    blank = [] if has_value else [F.lit(None).cast("string").alias(v) for v in _V]
    kept = [c for c in _FINDING if c not in ("via", *([] if has_value else _V))]
    via_col = F.col(via) if via else F.lit(None).cast("string")
    return df.select(*kept, *blank, via_col.alias("via")).select(*_FINDING)


def _rule_table(spark, rows, columns: str) -> DataFrame:
    return F.broadcast(local_frame(spark, rows, columns))


def _failed_values(values: DataFrame, found: list) -> DataFrame:
    """The values that fail, of all constraints on single values, in one pass over the values."""
    rows = []
    for r, s, c, p in found:
        words = _listed(p, "values")
        if c == "nodeKind":
            words = list(NODE_KINDS[p["value"]])
        elif c == "languageIn":
            words = [w.lower() for w in words]
        number = int(p["value"]) if c in ("minLength", "maxLength") else None
        rows.append((r, s, c, p.get("value"), p.get("dt", XSD_STRING), number, words))
    table = local_frame(values.sparkSession, rows,
                        "rule int, shape int, component string, arg string, arg_dt string, "
                        "arg_int int, args array<string>")
    value, kind, dt, lang = (F.col(v) for v in _V)
    components = {c for _, _, c, _ in found}
    ranged = components & {"minInclusive", "maxInclusive", "minExclusive", "maxExclusive"}
    if ranged:
        arg, arg_dt = F.col("arg"), F.col("arg_dt")
        table = table.withColumn("bound_class", compare_class(arg, F.lit(LITERAL), arg_dt)).withColumn(
            "bound", compare_key(arg, arg_dt))
    joined = values.join(F.broadcast(table), "shape")
    tests: dict[str, Column] = {
        "datatype": (kind == LITERAL) & (dt == F.col("arg")) & is_valid(value, dt),
        "nodeKind": F.array_contains("args", kind),
        "minLength": (kind != BNODE) & (F.length(value) >= F.col("arg_int")),
        "maxLength": (kind != BNODE) & (F.length(value) <= F.col("arg_int")),
        "languageIn": (lang != "") & F.exists(
            "args", lambda a: (lang == a) | F.startswith(lang, F.concat(a, F.lit("-")))),
        "in": F.array_contains("args", term_text(value, kind, dt, lang)),
    }
    if ranged:
        same = compare_class(value, kind, dt) == F.col("bound_class")
        mine, bound = compare_key(value, dt), F.col("bound")
        tests["minInclusive"] = same & (mine >= bound)
        tests["maxInclusive"] = same & (mine <= bound)
        tests["minExclusive"] = same & (mine > bound)
        tests["maxExclusive"] = same & (mine < bound)
    for c in components & {"pattern", "sql"}:
        # Patterns and expressions stay literals, so each is compiled once.
        chosen = None
        for r, _, name, p in found:
            if name == c:
                one = _pattern(value, kind, p) if c == "pattern" else _expression(p["expr"])
                chosen = F.when(F.col("rule") == r, one) if chosen is None else chosen.when(F.col("rule") == r, one)
        tests[c] = chosen
    result = None
    for c in sorted(components):
        is_c = F.col("component") == c
        result = F.when(is_c, tests[c]) if result is None else result.when(is_c, tests[c])
    ok = F.coalesce(result, F.lit(False))
    return joined.where(~ok)


def term_text(value: Column, kind: Column, dt: Column, lang: Column) -> Column:
    """A term as one text, for membership in lists: kind, datatype, language, value."""
    return F.concat_ws(" ", kind, dt, lang, value)


def term_entry(term) -> str:
    """The entry of an ``in`` list for a Term."""
    return " ".join([term.kind, term.dt, term.lang, term.value])


def _pattern(value: Column, kind: Column, p) -> Column:
    flags, pattern = p.get("flags", ""), p["value"]
    if "q" in flags:
        pattern, flags = "\\Q" + pattern + "\\E", flags.replace("q", "")
    return (kind != BNODE) & value.rlike(f"(?{flags}){pattern}" if flags else pattern)


def _expression(expr: str) -> Column:
    """A Spark SQL condition over value, value_kind, value_dt, value_lang, focus, g, and the named fields."""
    return F.expr(expr)


def _only_class(s: Shape) -> str | None:
    """The class of a shape whose one target is a class."""
    if len(s.targets) != 1 or s.targets[0][0] not in ("class", "implicit"):
        return None
    return s.id if s.targets[0][0] == "implicit" else s.targets[0][1]


def _is_one_step(s: Shape) -> bool:
    """Whether the path is one step that is not repeated."""
    return len(s.path) == 1 and not s.path[0].repeat


def _is_presence(s: Shape, found: tuple) -> bool:
    _, _, component, params = found
    return (component == "minCount" and int(params["count"]) == 1 and s.predicate not in (None, RDF_TYPE)
            and _only_class(s) is not None)


def _presence(quads: DataFrame, rules: _Rules, found: list) -> DataFrame:
    """minCount 1 on one predicate of a class: the missing bits of each subject.

    An instance of a subclass has the bits of the classes above it. As in the coverage analysis, one shuffle on the subject serves all shapes,
    and no focus node is repeated per shape before it.
    """
    classes = sorted({_only_class(rules.shapes[s]) for _, s, _, _ in found})
    properties = sorted({rules.shapes[s].predicate for _, s, _, _ in found})
    at_class, at_property = bit_places(classes), bit_places(properties, len(classes))
    bits = subject_bits(quads, classes, properties, rules.below(quads))
    words = F.array(*[c for c in bits.columns if c.startswith("w")])
    asked = F.array(*[
        F.struct(*[F.lit(x).alias(n) for x, n in zip(
            (s, r, *at_class[_only_class(rules.shapes[s])], *at_property[rules.shapes[s].predicate]),
            ("shape", "rule", "class_word", "class_bit", "word", "bit"))])
        for r, s, _, _ in found])

    def is_set(x: Column, word: str, bit: str) -> Column:
        return F.expr("1L").bitwiseAND(F.call_function("shiftright", F.get(words, x[word]), x[bit])) == 1

    missed = F.filter(asked, lambda x: is_set(x, "class_word", "class_bit") & ~is_set(x, "word", "bit"))
    rows = bits.select("g", F.col("s").alias("f"), F.col("s_kind").alias("f_kind"), F.lit("").alias("f_dt"),
                       F.lit("").alias("f_lang"), F.lit(True).alias("reported"), F.inline(missed))
    return _finding(rows, has_value=False)


def _counts(focus: DataFrame, values: DataFrame | None, quads: DataFrame, rules: _Rules, found: list) -> DataFrame:
    """minCount and maxCount: values are counted before they meet the focus nodes, along one step
    of any predicates and direction from its edges."""
    spark = quads.sparkSession
    rows = [(r, s, rules.shapes[s].predicate or "", int(p["count"]) if c == "minCount" else None,
             int(p["count"]) if c == "maxCount" else None) for r, s, c, p in found]
    schema = "rule int, shape int, p string, low int, high int"
    simple = [x for x in rows if x[2]]
    other = [x for x in rows if not x[2] and not _is_one_step(rules.shapes[x[1]])]
    steps: dict[tuple, list] = {}
    for x in rows:
        if not x[2] and _is_one_step(rules.shapes[x[1]]):
            steps.setdefault(rules.shapes[x[1]].path, []).append(x)
    low, high = F.col("n") < F.col("low"), F.col("n") > F.col("high")
    wrong = F.coalesce(low, F.lit(False)) | F.coalesce(high, F.lit(False))
    n = F.coalesce("n", F.lit(0))
    frames = []
    if simple:
        counts = (quads.where(F.col("p").isin(*sorted({x[2] for x in simple})))
                  .groupBy("g", F.col("s").alias("f"), F.col("s_kind").alias("f_kind"), "p")
                  .agg(F.count(F.lit(1)).alias("n")))
        asked = focus.join(_rule_table(spark, simple, schema), "shape")
        frames.append(asked.join(counts, ["g", "f", "f_kind", "p"], "left").withColumn("n", n).where(wrong))
    for (step,), here in steps.items():
        edges = edges_of(quads, step.predicates, step.inverse)
        # Along several predicates a node may have the same value more than once.
        edges = edges.distinct() if len(step.predicates) > 1 else edges
        counts = (edges.groupBy("g", *[F.col(a).alias(f) for a, f in zip(("a", "a_kind", "a_dt", "a_lang"), _F)])
                  .agg(F.count(F.lit(1)).alias("n")))
        asked = focus.join(_rule_table(spark, here, schema), "shape")
        frames.append(asked.join(counts, ["g", *_F], "left").withColumn("n", n).where(wrong))
    if other:
        keys = ["shape", "g", *_F]
        counts = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        asked = focus.join(_rule_table(spark, other, schema), "shape")
        frames.append(asked.join(counts, keys, "left").withColumn("n", n).where(wrong))
    return _finding(_union(frames), has_value=False)


def _classes(values: DataFrame, quads: DataFrame, rules: _Rules, found: list) -> DataFrame:
    rows = [(r, s, p["value"]) for r, s, _, p in found]
    asked = values.join(_rule_table(values.sparkSession, rows, "rule int, shape int, class string"), "shape")
    known = members(quads, sorted({x[2] for x in rows}), rules.below(quads)).select(
        "g", "class", F.col("s").alias("v"), F.col("s_kind").alias("v_kind"))
    # Literals have neither type nor the kind of a subject, so they stay.
    return _finding(asked.join(known, ["g", "class", "v", "v_kind"], "left_anti"))


def _has_value(focus: DataFrame, values: DataFrame, found: list) -> DataFrame:
    rows = [(r, s, p["value"], p.get("kind", IRI), p.get("dt", ""), p.get("lang", "")) for r, s, _, p in found]
    schema = "rule int, shape int, v string, v_kind string, v_dt string, v_lang string"
    table = _rule_table(values.sparkSession, rows, schema)
    met = values.join(table, ["shape", *_V]).select("rule", "g", *_F)
    asked = focus.join(_rule_table(values.sparkSession, [x[:2] for x in rows], "rule int, shape int"), "shape")
    return _finding(asked.join(met, ["rule", "g", *_F], "left_anti"), has_value=False)


def _unique_lang(values: DataFrame, found: list) -> DataFrame:
    rows = [(r, s) for r, s, _, p in found if p.get("value", "true") == "true"]
    table = _rule_table(values.sparkSession, rows, "rule int, shape int")
    keys = ["shape", "g", *_F, "reported", "v_lang"]
    twice = values.where(F.col("v_lang") != "").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.join(table, "shape").select(
        "shape", "rule", "g", *_F, *[F.lit(None).cast("string").alias(v) for v in _V],
        F.col("v_lang").alias("via"), "reported")


def _other_values(focus: DataFrame, quads: DataFrame, rows: list) -> DataFrame:
    """(shape, rule, component, g, f..., o..., reported): values of the compared predicate."""
    table = _rule_table(quads.sparkSession, rows, "rule int, shape int, component string, p string")
    facts = quads.where(F.col("p").isin(*sorted({x[3] for x in rows}))).select(
        "g", F.col("s").alias("f"), F.col("s_kind").alias("f_kind"), "p", *OBJECT)
    return focus.join(table, "shape").join(facts, ["g", "f", "f_kind", "p"]).drop("p")


def _pairs(focus: DataFrame, values: DataFrame, quads: DataFrame, found: list) -> DataFrame:
    """equals and disjoint: both sides hold each value once, so the joins are key to key."""
    spark = quads.sparkSession
    rows = [(r, s, c, p["predicate"]) for r, s, c, p in found]
    mine = values.join(_rule_table(spark, [x[:3] for x in rows], "rule int, shape int, component string"), "shape")
    other = _other_values(focus, quads, rows).withColumnsRenamed(dict(zip(OBJECT, _V)))
    keys = ["rule", "g", *_F, *_V]
    frames = []
    equal = F.col("component") == "equals"
    if any(x[2] == "equals" for x in rows):
        frames.append(_finding(mine.where(equal).join(other.select(*keys), keys, "left_anti")))
        frames.append(_finding(other.where(equal).join(mine.select(*keys), keys, "left_anti")))
    if any(x[2] == "disjoint" for x in rows):
        frames.append(_finding(mine.where(~equal).join(other.select(*keys), keys, "left_semi")))
    return _union(frames)


def _bounds(others: DataFrame, keys: list[str]) -> DataFrame:
    """The other values of each key shrunk to the class of all of them and the smallest key."""
    kind = F.coalesce(compare_class(F.col("o"), F.col("o_kind"), F.col("o_dt")), F.lit("none"))
    return others.select(*keys, kind.alias("cls"), compare_key(F.col("o"), F.col("o_dt")).alias("key")).groupBy(*keys).agg(
        F.min("cls").alias("cls"), F.max("cls").alias("last"), F.min("key").alias("bound"))


def _not_below(mine: DataFrame) -> DataFrame:
    same = (F.col("cls") == F.col("last")) & (
        compare_class(F.col("v"), F.col("v_kind"), F.col("v_dt")) == F.col("cls"))
    key = compare_key(F.col("v"), F.col("v_dt"))
    below = F.when(F.col("component") == "lessThan", key < F.col("bound")).otherwise(key <= F.col("bound"))
    return mine.where(~F.coalesce(same & below, F.lit(False)))


def _less_than(at: _Level, found: list) -> DataFrame:
    """lessThan and lessThanOrEquals: a value must lie below every other value.

    The other values shrink to one bound per subject before the join: their
    smallest key, and whether they all can be compared with each other. No pair
    of values is formed. Along one predicate the facts are compared first, and
    only those that fail meet their focus nodes.
    """
    quads, rules = at.quads, at.rules
    simple, other = _by_path(rules, found)
    frames = []
    if simple:
        subject = ["g", "f", "f_kind"]
        mine = _facts(quads, [(r, s, c, p["predicate"], rules.shapes[s].predicate) for r, s, c, p in simple],
                      "rule int, shape int, component string, other string, p string")
        others = quads.where(F.col("p").isin(*sorted({p["predicate"] for _, _, _, p in simple}))).select(
            "g", F.col("s").alias("f"), F.col("s_kind").alias("f_kind"), F.col("p").alias("other"), *OBJECT)
        failed = _not_below(mine.join(_bounds(others, [*subject, "other"]), [*subject, "other"]))
        frames.append(_finding(_at_focus(failed, at.focus(simple))))
    if other:
        rows = [(r, s, c, p["predicate"]) for r, s, c, p in other]
        bounds = _bounds(_other_values(at.focus(other), quads, rows), ["rule", "shape", "component", "g", *_F])
        frames.append(_finding(_not_below(at.values(other).join(bounds, ["shape", "g", *_F]))))
    return _union(frames)


def _closed(focus: DataFrame, quads: DataFrame, rules: _Rules, found: list) -> DataFrame:
    """Triples of focus nodes whose predicate the shape does not allow."""
    rows = [(r, s, _listed(p, "allowed") + _listed(p, "ignored")) for r, s, _, p in found]
    table = _rule_table(quads.sparkSession, rows, "rule int, shape int, allowed array<string>")
    asked = focus.join(table, "shape")
    # A predicate that every closed shape allows needs no look at its focus nodes.
    everywhere = set.intersection(*[set(x[2]) for x in rows])
    facts = quads.where(~F.col("p").isin(*sorted(everywhere))) if everywhere else quads
    facts = facts.select("g", F.col("s").alias("f"), F.col("s_kind").alias("f_kind"), "p",
                         *[F.col(o).alias(v) for o, v in zip(OBJECT, _V)])
    extra = asked.join(facts, ["g", "f", "f_kind"]).where(~F.array_contains("allowed", F.col("p")))
    return _finding(extra, via="p")


# -- nested shapes ---------------------------------------------------------

def _member_rows(rules: _Rules, found: list) -> list[tuple]:
    """(rule, shape, component, member, counts): counts is false for disjoint siblings."""
    rows = []
    for r, s, c, p in found:
        rows += [(r, s, c, rules.number[x], True) for x in _listed(p, "shapes")]
        rows += [(r, s, c, rules.number[x], False) for x in _listed(p, "disjoint")]
    return rows


_MEMBER = "rule int, shape int, component string, member int, counts boolean"


def _by_path(rules: _Rules, found: list) -> tuple[list, list]:
    """The constraints of shapes with a path of one predicate, and the others."""
    simple = [x for x in found if rules.shapes[x[1]].predicate]
    return simple, [x for x in found if not rules.shapes[x[1]].predicate]


def _nested_focus(values: DataFrame, rules: _Rules, found: list) -> DataFrame:
    """Value nodes that inner shapes have to check."""
    table = _rule_table(values.sparkSession, _member_rows(rules, found), _MEMBER)
    inner = values.join(table, "shape").select(
        F.col("member").alias("shape"), "g", *[F.col(v).alias(f) for v, f in zip(_V, _F)],
        (F.col("reported") & (F.col("component") == "property")).alias("reported"))
    return inner.groupBy("shape", "g", *_F).agg(F.max("reported").alias("reported"))


def _nested(focus: DataFrame, values: DataFrame, bad: DataFrame, rules: _Rules, found: list) -> DataFrame:
    """Logic, node, property and qualified counts from the conformance of the value nodes.

    ``bad`` has (shape, g, f...) of the nodes that do not conform, each once.
    """
    spark = values.sparkSession
    member_rows = _member_rows(rules, found)
    sizes: dict[tuple, list[int]] = {}
    for r, i, component, _, counts in member_rows:
        size = sizes.setdefault((r, i, component), [0, 0])
        size[0 if counts else 1] += 1
    asked_rules = _rule_table(spark, [(*k, own + sibling, own, sibling) for k, (own, sibling) in sizes.items()],
                              "rule int, shape int, component string, n bigint, own bigint, sibling bigint")
    # What does not conform is counted for each rule before it meets the value nodes, each of which is one row.
    failed = (bad.withColumnRenamed("shape", "member")
              .join(_rule_table(spark, [(r, m, counts) for r, _, _, m, counts in member_rows], "rule int, member int, counts boolean"), "member")
              .groupBy("rule", "g", *[F.col(f).alias(v) for f, v in zip(_F, _V)])
              .agg(F.count_if("counts").alias("bad_own"), F.count_if(~F.col("counts")).alias("bad_sibling")))
    bad_own, bad_sibling = (F.coalesce(x, F.lit(0)) for x in ("bad_own", "bad_sibling"))
    keys = ["rule", "shape", "component", "g", *_F, *_V, "reported"]
    per_value = values.join(asked_rules, "shape").join(failed, ["rule", "g", *_V], "left").select(
        *keys, "n", (F.col("n") - bad_own - bad_sibling).alias("n_ok"), (F.col("own") - bad_own).alias("n_own"),
        (F.col("sibling") - bad_sibling).alias("n_sibling"))
    frames = []
    c = F.col("component")
    if any(x[2] in NESTED for x in found):
        wrong = (
            F.when(c == "not", F.col("n_ok") > 0).when(c == "or", F.col("n_ok") == 0)
            .when(c == "xone", F.col("n_ok") != 1)
            .when(c.isin("and", "node", "property"), F.col("n_ok") < F.col("n")))
        frames.append(_finding(per_value.where(wrong)))
    qualified = [x for x in found if x[2] == "qualified"]
    if qualified:
        limits = [(r, s, int(p["min"]) if "min" in p else None, int(p["max"]) if "max" in p else None)
                  for r, s, _, p in qualified]
        counted = (per_value.where((c == "qualified") & (F.col("n_own") > 0) & (F.col("n_sibling") == 0))
                   .groupBy("rule", "g", *_F).agg(F.count(F.lit(1)).alias("n")))
        asked = focus.join(_rule_table(spark, limits, "rule int, shape int, low int, high int"), "shape")
        n = F.coalesce("n", F.lit(0))
        tally = asked.join(counted, ["rule", "g", *_F], "left").withColumn("n", n)
        for name, wrong in (("qualified_min", F.col("n") < F.col("low")), ("qualified_max", F.col("n") > F.col("high"))):
            frames.append(_finding(tally.where(wrong).withColumn("via", F.lit(name)), has_value=False, via="via"))
    return _union(frames)


# -- evaluation ------------------------------------------------------------

def _as_shapes(shapes: Iterable[Shape] | DataFrame) -> list[Shape]:
    return from_frame(shapes) if isinstance(shapes, DataFrame) else list(shapes)


class _Level:
    """The focus nodes and values of one level of nesting.

    All families share one table of focus nodes and one of value nodes: targets are found
    and facts joined once, however many families look at them. Where a level has a single
    rule family the frames are used as they are.
    """

    def __init__(self, quads: DataFrame, rules: _Rules, level: int, asked: list[DataFrame]):
        self.quads, self.rules = quads, rules
        self.numbers = [i for i, at in enumerate(rules.level)
                        if at == level and not rules.shapes[i].deactivated]
        self.asked = None
        if asked:
            own = _targets(quads, rules, self.numbers)
            # What one outer level asks for has each node once already.
            self.asked = cut(asked[0] if own is None and len(asked) == 1 else _union(asked + ([] if own is None else [own]))
                             .groupBy("shape", "g", *_F).agg(F.max("reported").alias("reported")))
        # The shapes that have rules beside presence, and those whose values are looked at.
        self.checked: set[int] = set()
        self.valued: set[int] = set()
        families: set[str] = set()
        for rule in rules.of(level, *_ALL):
            _, s, component, _ = rule
            if self.asked is None and (not rules.shapes[s].targets or _is_presence(rules.shapes[s], rule)):
                continue
            self.checked.add(s)
            families.add(_family_of(component))
            counted = component in ("minCount", "maxCount") and _is_one_step(rules.shapes[s])
            if component != "closed" and not counted and not (rules.shapes[s].predicate and component in _BY_FACTS):
                self.valued.add(s)
        self.shared = len(families) > 1
        self._focus: DataFrame | None = None
        self._values: DataFrame | None = None

    def focus(self, found: list) -> DataFrame | None:
        numbers = sorted({s for _, s, _, _ in found})
        if self.asked is not None:
            return self.asked.where(F.col("shape").isin(*numbers))
        if not self.shared:
            return _targets(self.quads, self.rules, numbers)
        if self._focus is None:
            self._focus = cut(_targets(self.quads, self.rules, self.checked))
        return self._focus.where(F.col("shape").isin(*numbers))

    def values(self, found: list) -> DataFrame | None:
        numbers = sorted({s for _, s, _, _ in found})
        focus = self.focus(found)
        if focus is None or not self.shared:
            return None if focus is None else _values(focus, self.quads, self.rules, numbers)
        if self._values is None:
            everything = self.focus([(0, s, "", {}) for s in self.valued])
            self._values = cut(_values(everything, self.quads, self.rules, self.valued))
        return self._values.where(F.col("shape").isin(*numbers))


# The rule families: constraints that are evaluated by one plan.
_FAMILIES = (VALUE_TESTS, ("minCount", "maxCount"), ("class",), ("hasValue",), ("uniqueLang",), ("equals", "disjoint"),
             ("lessThan", "lessThanOrEquals"), ("closed",), (*NESTED, "qualified"))
_ALL = [c for family in _FAMILIES for c in family]
# Constraints that need no table of values where the path is one predicate. Custom conditions
# are not among them: they may fail on values that belong to no focus node.
_BY_FACTS = ("minCount", "maxCount", "lessThan", "lessThanOrEquals", *[c for c in VALUE_TESTS if c != "sql"])


def _family_of(component: str) -> str:
    return next(family[0] for family in _FAMILIES if component in family)


def _level_findings(at: _Level, bad: DataFrame | None, level: int) -> DataFrame | None:
    quads, rules = at.quads, at.rules
    frames = []

    def family(components: tuple[str, ...], plan) -> None:
        found = rules.of(level, *components)
        # Shapes that nothing targets and no outer shape asks for have no focus nodes.
        found = [x for x in found if at.asked is not None or rules.shapes[x[1]].targets]
        if found:
            frames.append(plan(found))

    def counts(found: list) -> DataFrame:
        plain, other = [], []
        for x in found:
            (plain if at.asked is None and _is_presence(rules.shapes[x[1]], x) else other).append(x)
        complex_ = [x for x in other if not rules.shapes[x[1]].predicate and not _is_one_step(rules.shapes[x[1]])]
        parts = [_presence(quads, rules, plain)] if plain else []
        if other:
            parts.append(_counts(at.focus(other), at.values(complex_) if complex_ else None, quads, rules, other))
        return _union(parts)

    def value_tests(found: list) -> DataFrame:
        by_facts, _ = _by_path(rules, [x for x in found if x[2] in _BY_FACTS])
        over_record = [x for x in found if x[3].get("fields")]
        plain = [x for x in found if x not in over_record and x not in by_facts]
        parts = []
        if by_facts:
            rows = sorted({(s, rules.shapes[s].predicate) for _, s, _, _ in by_facts})
            failed = _failed_values(_facts(quads, rows, "shape int, p string"), by_facts)
            parts.append(_finding(_at_focus(failed, at.focus(by_facts))))
        if plain:
            parts.append(_finding(_failed_values(_sql_names(at.values(plain)), plain)))
        if over_record:
            named = _with_fields(_sql_names(at.values(over_record)), quads, over_record)
            parts.append(_finding(_failed_values(named, over_record)))
        return _union(parts)

    family(VALUE_TESTS, value_tests)
    family(("minCount", "maxCount"), counts)
    family(("class",), lambda x: _classes(at.values(x), quads, rules, x))
    family(("hasValue",), lambda x: _has_value(at.focus(x), at.values(x), x))
    family(("uniqueLang",), lambda x: _unique_lang(at.values(x), x))
    family(("equals", "disjoint"), lambda x: _pairs(at.focus(x), at.values(x), quads, x))
    family(("lessThan", "lessThanOrEquals"), lambda x: _less_than(at, x))
    family(("closed",), lambda x: _closed(at.focus(x), quads, rules, x))
    family((*NESTED, "qualified"), lambda x: _nested(at.focus(x), at.values(x), bad, rules, x))
    return _union(frames)


def _sql_names(values: DataFrame) -> DataFrame:
    """Readable names beside the short ones, for custom conditions."""
    return values.withColumns({
        "value": F.col("v"), "value_kind": F.col("v_kind"), "value_dt": F.col("v_dt"),
        "value_lang": F.col("v_lang"), "focus": F.col("f"), "focus_kind": F.col("f_kind")})


def _with_fields(values: DataFrame, quads: DataFrame, found: list) -> DataFrame:
    """The values with a column for each named predicate of the focus node.

    Custom conditions name predicates in ``fields``, a name and a predicate per line. The
    column is a struct: least and most, the first and last of the focus's objects as
    texts, and n, how many there are. Only the named predicates are read, and a focus with
    very many objects stays one small row.
    """
    named: dict[str, str] = {}
    for _, _, _, p in found:
        for line in _listed(p, "fields"):
            name, _, predicate = line.partition(" ")
            if not re.fullmatch("[a-z][a-z0-9_]*", name) or not predicate:
                raise ValueError(f"a field is a name and a predicate: {line}")
            if name in (*values.columns, *_RULE_COLUMNS):
                raise ValueError(f"the name {name} has a meaning of its own")
            if named.setdefault(name, predicate) != predicate:
                raise ValueError(f"{name} stands for two predicates")
    here = quads.where(F.col("p").isin(*sorted(set(named.values()))))
    fields = []
    for name, predicate in named.items():
        it = F.when(F.col("p") == predicate, F.col("o"))
        fields.append(F.struct(F.min(it).alias("least"), F.max(it).alias("most"), F.count(it).alias("n")).alias(name))
    record = here.groupBy("g", F.col("s").alias("f"), F.col("s_kind").alias("f_kind")).agg(*fields)
    none = F.struct(F.lit(None).cast("string").alias("least"), F.lit(None).cast("string").alias("most"),
                    F.lit(0).cast("bigint").alias("n"))
    return values.join(record, ["g", "f", "f_kind"], "left").withColumns({x: F.coalesce(x, none) for x in named})


def _findings(quads: DataFrame, rules: _Rules) -> DataFrame | None:
    depth = max(rules.level, default=0)
    levels: list[_Level] = []
    inner: dict[int, list[DataFrame]] = {}
    for level in range(depth + 1):
        at = _Level(quads, rules, level, inner.get(level, []))
        levels.append(at)
        asks = [x for x in rules.of(level, *NESTED, "qualified") if at.asked is not None or rules.shapes[x[1]].targets]
        if asks:
            nested = _nested_focus(at.values(asks), rules, asks)
            for below in range(level + 1, depth + 1):
                numbers = [i for i, n in enumerate(rules.level) if n == below]
                inner.setdefault(below, []).append(nested.where(F.col("shape").isin(*numbers)))
    results: list[DataFrame] = []
    bad = local_frame(quads.sparkSession, [], "shape int, g string, f string, f_kind string, f_dt string, f_lang string")
    for level in range(depth, -1, -1):
        found = _level_findings(levels[level], bad, level)
        if found is None:
            continue
        if level > 0:
            found = cut(found)
            bad = bad.unionByName(found.select("shape", "g", *_F).distinct())
        results.append(found)
    return _union(results)


def _named(df: DataFrame, rules: _Rules) -> DataFrame:
    rows = [(i, s.id, s.path_text, s.severity, s.message) for i, s in enumerate(rules.shapes)]
    table = local_frame(df.sparkSession, rows,
                        "shape int, shape_id string, path string, severity string, message string")
    return df.join(F.broadcast(table), "shape")


def _default_message(component: str, params) -> str:
    shown = ", ".join(f"{k}={v}".replace("\n", " ") for k, v in sorted(params.items()))
    return f"{component}({shown})"


def validate(quads: DataFrame, shapes: Iterable[Shape] | DataFrame) -> DataFrame:
    """One row per violation.

    Columns g, result_id, shape, focus, focus_kind, path, value, value_kind,
    value_dt, value_lang, component, severity, message. ``result_id`` follows
    from the other columns, so a rerun gives the same ids.
    """
    rules = _Rules(_as_shapes(shapes))
    spark = quads.sparkSession
    found = _findings(quads, rules)
    if found is None:
        return local_frame(spark, [], RESULT_SCHEMA)
    texts = [(r, component_iri(c) if c != "qualified" else None, c, _default_message(c, p))
             for r, (_, c, p) in enumerate(rules.rules)]
    table = local_frame(spark, texts, "rule int, component string, kind string, text string")
    named = _named(found.where("reported"), rules).join(F.broadcast(table), "rule").where(F.col("kind") != "property")
    component = (F.when(F.col("via") == "qualified_min", component_iri("qualified_min"))
                 .when(F.col("via") == "qualified_max", component_iri("qualified_max"))
                 .otherwise(F.col("component")))
    path = F.when(F.col("kind") == "closed", F.col("via")).otherwise(F.col("path"))
    key = ["g", "shape_id", "text", *_F, "via", *_V]
    return named.select(
        "g", mint(SKOLEM_BASE, *key).alias("result_id"), F.col("shape_id").alias("shape"),
        F.col("f").alias("focus"), F.col("f_kind").alias("focus_kind"), path.alias("path"),
        F.col("v").alias("value"), F.col("v_kind").alias("value_kind"), F.col("v_dt").alias("value_dt"),
        F.col("v_lang").alias("value_lang"), component.alias("component"), "severity",
        F.coalesce("message", "text").alias("message"))


RESULT_SCHEMA = (
    "g string, result_id string, shape string, focus string, focus_kind string, path string, "
    "value string, value_kind string, value_dt string, value_lang string, component string, "
    "severity string, message string"
)


def result_quads(results: DataFrame, graph: Column | str) -> DataFrame:
    """The results as quads of a result graph.

    Paths that are more than one predicate have no IRI; they get a minted one.
    """
    uri = F.col("result_id")
    simple = ~F.col("path").rlike("[<^]")
    path = F.when(simple, F.col("path")).otherwise(mint(SKOLEM_BASE, "path"))
    no_path = F.col("path").isNull()
    template = [
        link(uri, RDF_TYPE, SH + "ValidationResult"),
        link(uri, SH + "resultSeverity", F.col("severity")),
        link(uri, SH + "resultPath", F.when(~no_path, path)),
        link(uri, SH + "sourceShape", F.col("shape")),
        link(uri, SH + "sourceConstraintComponent", F.col("component")),
        text(uri, SH + "resultMessage", F.col("message")),
    ]
    # Focus and value keep the kind, datatype and language of their term.
    none = F.lit("")
    terms = [
        F.struct(uri.alias("s"), F.lit(IRI).alias("s_kind"), F.lit(SH + name).alias("p"), F.col(term).alias("o"),
                 F.col(f"{term}_kind").alias("o_kind"), dt.alias("o_dt"), lang.alias("o_lang"))
        for name, term, dt, lang in (("focusNode", "focus", none, none),
                                     ("value", "value", F.col("value_dt"), F.col("value_lang")))]
    # All quads of a result come from one row, so they lie together and its IRI takes room once.
    g = F.lit(graph) if isinstance(graph, str) else graph
    rows = results.select(g.alias("g"), F.inline(F.array(*map(struct_of, template), *terms)))
    bound = F.col("g").isNotNull() & F.col("s").isNotNull()
    return rows.where(F.col("o").isNotNull() & (bound | F.col("p").isin(SH + "focusNode", SH + "value"))).select(*QUAD)


def report_quads(results: DataFrame, verdicts: DataFrame, graph: Column | str) -> DataFrame:
    """The report node of each graph of the verdicts (see ``conforms``): its type, its
    conformance, and a quad to each of its results. A clean graph has a report too.

    graph names the result graph by columns that both frames have.
    """
    g = F.lit(graph) if isinstance(graph, str) else graph
    node = mint(SKOLEM_BASE, F.lit("report"), "g", g)
    heads = insert(verdicts, graph, [
        link(node, RDF_TYPE, SH + "ValidationReport"),
        text(node, SH + "conforms", F.col("conforms").cast("string"), XSD_BOOLEAN)])
    return heads.unionByName(insert(results, graph, [link(node, SH + "result", F.col("result_id"))]))


def reports_from_quads(quads: DataFrame) -> DataFrame:
    """(g, report, conforms, results) of stored result graphs; g is the result graph.

    conforms is what the report says, results how many it names.
    """
    reports = star(quads, {"conforms": SH + "conforms"}, SH + "ValidationReport")
    named = match(quads, p=SH + "result").groupBy("g", *SUBJECT).agg(F.count(F.lit(1)).alias("results"))
    return reports.join(named, ["g", *SUBJECT], "left").select(
        "g", F.col("s").alias("report"), (F.col("conforms") == "true").alias("conforms"),
        F.coalesce("results", F.lit(0).cast("bigint")).alias("results"))


def results_from_quads(quads: DataFrame) -> DataFrame:
    """(g, result_id, focus, focus_kind, path, shape, severity) of stored result graphs.

    g is the result graph. A result must have a severity and a focus node; path
    and shape may be missing. Several values give several rows.
    """
    named = [SH + "resultSeverity", SH + "focusNode", SH + "resultPath", SH + "sourceShape"]
    p = F.col("p")
    typed = (p == RDF_TYPE) & (F.col("o") == SH + "ValidationResult") & (F.col("o_kind") == IRI)
    here = quads.where((p.isin(*named) | typed) & F.col("g").isNotNull() & F.col("s").isNotNull() & F.col("s_kind").isNotNull())
    place = F.coalesce(*[F.when(p == name, F.lit(i)) for i, name in enumerate(named)], F.lit(len(named))).cast("byte")
    # The quads of one result are one row: they meet in one shuffle, and where they are written together, before it.
    found = here.groupBy("g", packed(F.col("s")).alias("key"), "s_kind").agg(F.collect_list(F.struct(
        place.alias("place"), F.when(~typed, F.col("o")).alias("o"), F.when(p == SH + "focusNode", F.col("o_kind")).alias("kind"))).alias("quads"))

    def each(i: int) -> Column:
        return F.filter("quads", lambda x: x["place"] == i)

    rest = ["g", "key", "quads"]
    found = found.select(*rest, F.explode(each(len(named)))).select(*rest, F.explode(each(0)["o"]).alias("severity"))
    found = found.select(*rest, "severity", F.explode(each(1)).alias("focus"))
    found = found.select(*rest, "severity", "focus", F.explode_outer(each(2)["o"]).alias("path"))
    found = found.select(*rest, "severity", "focus", "path", F.explode_outer(each(3)["o"]).alias("shape"))
    return found.select("g", unpacked(F.col("key")).alias("result_id"), F.col("focus.o").alias("focus"),
                        F.col("focus.kind").alias("focus_kind"), "path", "shape", "severity")


def conforms(quads: DataFrame, results: DataFrame) -> DataFrame:
    """(g, conforms, results) for every graph, clean ones too."""
    counts = results.groupBy("g").agg(F.count(F.lit(1)).alias("results"))
    graphs = quads.select("g").distinct().select("g", F.lit(0).cast("bigint").alias("results"))
    total = counts.unionByName(graphs).groupBy("g").agg(F.sum("results").alias("results"))
    return total.select("g", (F.col("results") == 0).alias("conforms"), "results")
