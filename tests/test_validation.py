import pytest
from conftest import rows
from pyspark.sql import functions as F

from quadlake.operators.closure import closure, edges_of
from quadlake.plans import report
from quadlake.plans.shapes import from_frame, shape, to_frame
from quadlake.plans.validation import (
    conforms, path_values, result_quads, results_from_quads, targets, term_entry, validate,
)
from quadlake.quads import Term, bnode, literal
from quadlake.sources.sample_shapes import FAMILIES
from quadlake.spec import CLASSES
from quadlake.vocab import BNODE, DCAT, RDF_TYPE, SUBCLASS_OF, XSD, XSD_INTEGER

C = [("class", "C")]
INT = XSD_INTEGER


def number(x):
    return literal(str(x), INT)


def violations(make, data, *shapes, columns=("focus", "value")):
    q = make(*[("g", *d) for d in data])
    return rows(validate(q, list(shapes)), *columns)


# (name, constraint, objects that conform, objects that violate): one value each, path p.
SINGLE = [
    ("datatype", ("datatype", {"value": INT}), [number(1), number("-07")], [number("x"), literal("1"), "iri"]),
    ("nodeKind", ("nodeKind", {"value": "BlankNodeOrIRI"}), ["iri", bnode("b")], [literal("x")]),
    ("minInclusive", ("minInclusive", {"value": "5", "dt": INT}), [number(5), literal("5.5", XSD + "decimal")],
     [number(4), literal("9"), "iri", literal("NaN", XSD + "double")]),
    ("maxInclusive", ("maxInclusive", {"value": "5", "dt": INT}), [number(5)], [number(6)]),
    ("minExclusive", ("minExclusive", {"value": "5", "dt": INT}), [number(6)], [number(5)]),
    ("maxExclusive", ("maxExclusive", {"value": "9007199254740993", "dt": INT}), [number(9007199254740992)],
     [number(9007199254740993)]),
    ("dates", ("minInclusive", {"value": "2024-01-01", "dt": XSD + "date"}), [literal("2024-01-01", XSD + "date")],
     [literal("2023-12-31", XSD + "date"), literal("2025-01-01T00:00:00", XSD + "dateTime")]),
    ("minLength", ("minLength", {"value": "2"}), [literal("ab"), "ab"], [literal("a"), bnode("abc")]),
    ("maxLength", ("maxLength", {"value": "2"}), [literal("ab")], [literal("abc"), bnode("a")]),
    ("pattern", ("pattern", {"value": "^A.c$", "flags": "is"}), [literal("a\nC"), "abc"], [literal("abd"), bnode("abc")]),
    ("quoted", ("pattern", {"value": "a.c", "flags": "q"}), [literal("xa.cx")], [literal("abc")]),
    ("languageIn", ("languageIn", {"values": "en\nDE"}), [literal("x", lang="en-GB"), literal("x", lang="de")],
     [literal("x", lang="end"), literal("x"), literal("x", lang="fr")]),
    ("in", ("in", {"values": "\n".join([term_entry(literal("a")), term_entry(Term("iri", "b"))])}),
     [literal("a"), "b"], [literal("b"), "a", literal("a", lang="en")]),
    ("class", ("class", {"value": "D"}), ["typed", "sub"], ["iri", literal("typed")]),
    ("sql", ("sql", {"expr": "value_kind = 'literal' AND value > 'm'"}), [literal("n")], [literal("a"), "n"]),
]


@pytest.mark.parametrize("name,constraint,good,bad", SINGLE, ids=[s[0] for s in SINGLE])
def test_value_constraints(make, name, constraint, good, bad):
    data = [("typed", RDF_TYPE, "D"), ("sub", RDF_TYPE, "E"), ("E", SUBCLASS_OF, "D"), ("D", SUBCLASS_OF, "E")]
    for i, o in enumerate(good + bad):
        data += [(f"n{i:02d}", RDF_TYPE, "C"), (f"n{i:02d}", "p", o)]
    got = violations(make, data, shape("s", constraint, targets=C, path="p"), columns=("focus",))
    assert got == [(f"n{i:02d}",) for i in range(len(good), len(good) + len(bad))]


def test_counts(make):
    data = [("none", RDF_TYPE, "C"), ("one", RDF_TYPE, "C"), ("one", "p", "a"), ("two", RDF_TYPE, "C"),
            ("two", "p", literal("1")), ("two", "p", number(1))]
    got = violations(make, data, shape("s", ("minCount", {"count": "1"}), ("maxCount", {"count": "1"}), targets=C, path="p"),
                     columns=("focus", "component"))
    assert [(f, c.split("#")[1]) for f, c in got] == [("none", "MinCountConstraintComponent"), ("two", "MaxCountConstraintComponent")]
    by_path = violations(make, data, shape("s", ("minCount", {"count": "1"}), targets=C, path=[("", "p|q")]), columns=("focus",))
    assert by_path == [("none",)]


def test_unique_lang(make):
    data = [("a", RDF_TYPE, "C"), ("a", "p", literal("x", lang="en")), ("a", "p", literal("y", lang="en")),
            ("a", "p", literal("z", lang="de")), ("b", RDF_TYPE, "C"), ("b", "p", literal("x")), ("b", "p", literal("y"))]
    assert violations(make, data, shape("s", ("uniqueLang", {}), targets=C, path="p"), columns=("focus",)) == [("a",)]


def test_equals_and_disjoint(make):
    data = [("a", RDF_TYPE, "C"), ("a", "p", "x"), ("a", "p", "y"), ("a", "q", "y"), ("a", "q", literal("x")),
            ("b", RDF_TYPE, "C"), ("b", "p", "z"), ("b", "q", "z"), ("c", RDF_TYPE, "C"), ("c", "q", "only")]
    assert violations(make, data, shape("s", ("equals", {"predicate": "q"}), targets=C, path="p")) == [
        ("a", "x"), ("a", "x"), ("c", "only")]
    assert violations(make, data, shape("s", ("disjoint", {"predicate": "q"}), targets=C, path="p")) == [
        ("a", "y"), ("b", "z")]


def test_less_than(make):
    data = [(n, RDF_TYPE, "C") for n in "abcde"] + [
        ("a", "p", number(1)), ("a", "p", number(5)), ("a", "q", number(5)), ("a", "q", number(9)),
        ("b", "p", number(1)), ("b", "q", literal("x")), ("c", "p", number(1)),
        ("d", "p", number(1)), ("d", "q", number(2)), ("d", "q", literal("2")),
        ("e", "p", literal("a")), ("e", "q", literal("b"))]
    assert violations(make, data, shape("s", ("lessThan", {"predicate": "q"}), targets=C, path="p")) == [
        ("a", "5"), ("b", "1"), ("d", "1")]
    assert violations(make, data, shape("s", ("lessThanOrEquals", {"predicate": "q"}), targets=C, path="p")) == [
        ("b", "1"), ("d", "1")]


def test_logic_against_truth_table(make):
    data = []
    for i in range(4):
        data += [(f"n{i}", RDF_TYPE, "C")] + [(f"n{i}", p, "x") for p, on in (("p", i & 1), ("q", i & 2)) if on]
    p, q = (shape(x, ("minCount", {"count": "1"}), path=x) for x in ("p", "q"))
    expect = {"and": lambda a, b: a and b, "or": lambda a, b: a or b, "xone": lambda a, b: a != b}
    for name, rule in expect.items():
        got = violations(make, data, p, q, shape("s", (name, {"shapes": "p\nq"}), targets=C), columns=("focus",))
        assert got == [(f"n{i}",) for i in range(4) if not rule(bool(i & 1), bool(i & 2))]
    assert violations(make, data, p, shape("s", ("not", {"shapes": "p"}), targets=C), columns=("focus",)) == [("n1",), ("n3",)]


def test_nested_shapes_report_where_they_should(make):
    data = [("a", RDF_TYPE, "C"), ("a", "part", "x"), ("a", "part", "y"), ("x", "p", "1"), ("b", RDF_TYPE, "C"), ("b", "part", "x")]
    inner = shape("inner", ("minCount", {"count": "1"}), path="p")
    by_node = violations(make, data, inner, shape("s", ("node", {"shapes": "inner"}), targets=C, path="part"),
                         columns=("shape", "focus", "value"))
    assert by_node == [("s", "a", "y")]
    by_property = violations(make, data, inner, shape("s", ("property", {"shapes": "inner"}), targets=C, path="part"),
                             columns=("shape", "focus", "value"))
    assert by_property == [("inner", "y", None)]
    # A shape that fails only through a property still does not conform.
    outer = shape("middle", ("property", {"shapes": "inner"}), path="part")
    got = violations(make, data, inner, outer, shape("s", ("node", {"shapes": "middle"}), targets=C), columns=("shape", "focus"))
    assert got == [("s", "a")]


def test_qualified(make):
    data = [("a", RDF_TYPE, "C"), ("b", RDF_TYPE, "C"), ("a", "part", "x"), ("a", "part", "y"), ("a", "part", "z"),
            ("x", "p", "1"), ("y", "p", "1"), ("y", "q", "1")]
    p, q = (shape(x, ("minCount", {"count": "1"}), path=x) for x in ("p", "q"))
    def at(**params):
        return violations(make, data, p, q, shape("s", ("qualified", {"shapes": "p", **params}), targets=C, path="part"),
                          columns=("focus",))
    assert at(min="1") == [("b",)]
    assert at(min="0", max="1") == [("a",)]
    assert at(min="2", disjoint="q") == [("a",), ("b",)]


def test_closed_and_has_value(make):
    data = [("a", RDF_TYPE, "C"), ("a", "p", "x"), ("a", "q", literal("x")), ("b", RDF_TYPE, "C"), ("b", "p", "y")]
    got = violations(make, data, shape("s", ("closed", {"allowed": "p", "ignored": RDF_TYPE}), targets=C), columns=("focus", "path"))
    assert got == [("a", "q")]
    got = violations(make, data, shape("s", ("hasValue", {"value": "x", "kind": "literal", "dt": XSD + "string"}), targets=C, path="q"),
                     columns=("focus",))
    assert got == [("b",)]


def test_targets(make):
    q = make(("g", "a", RDF_TYPE, "D"), ("g", "D", SUBCLASS_OF, "C"), ("g", "C", SUBCLASS_OF, "D"), ("h", "b", RDF_TYPE, "D"),
             ("g", "a", "p", literal("x")), ("g", "_:n", "p", "z"))
    got = rows(targets(q, [shape("C", targets=[("implicit", "")]), shape("n", targets=[("node", "a")]),
                           shape("s", targets=[("subjectsOf", "p")]), shape("o", targets=[("objectsOf", "p")]),
                           shape("off", targets=C, deactivated=True)]))
    assert got == [("g", "C", "a", "iri"), ("g", "n", "a", "iri"), ("g", "o", "x", "literal"), ("g", "o", "z", "iri"),
                   ("g", "s", "a", "iri"), ("g", "s", "n", BNODE), ("h", "n", "a", "iri")]


def test_paths_with_cycles(make):
    q = make(("g", "a", RDF_TYPE, "C"), ("g", "a", "n", "b"), ("g", "b", "n", "c"), ("g", "c", "n", "a"), ("g", "c", "n", literal("end")),
             ("h", "b", "n", "elsewhere"))
    def ends(op, iri="n"):
        return [r[0] for r in rows(path_values(q, [shape("s", targets=C, path=[(op, iri)])]), "value")]
    assert ends("+") == ["a", "b", "c", "end"] and ends("*") == ["a", "b", "c", "end"]
    assert ends("?") == ["a", "b"] and ends("^") == ["c"] and ends("^+") == ["a", "b", "c"]


def test_closure_against_brute_force(make, spark):
    pairs = {(f"n{i}", f"n{(i * i + 3 * i) % 23}") for i in range(23)} | {(f"n{i}", f"n{i + 1}") for i in range(0, 20, 4)}
    q = make(*[("g", a, "p", b) for a, b in sorted(pairs)])
    edges = edges_of(q, ["p"])
    got = set(rows(closure(edges, edges.select("g", "a", "a_kind", "a_dt", "a_lang")), "a", "b"))
    want = set(pairs)
    while True:
        more = want | {(a, d) for a, b in want for c, d in pairs if b == c}
        if more == want:
            break
        want = more
    assert got == want


def test_refused_shapes():
    loop = [shape("a", ("node", {"shapes": "b"}), targets=C), shape("b", ("not", {"shapes": "a"}))]
    with pytest.raises(ValueError, match="itself"):
        validate(None, loop)
    with pytest.raises(ValueError):
        shape("a", ("noSuch", {}))


def test_deactivated_and_no_results(make):
    q = make(("g", "a", RDF_TYPE, "C"), ("h", "z", "p", "o"))
    off = shape("s", ("minCount", {"count": "1"}), targets=C, path="p", deactivated=True)
    assert validate(q, [off]).count() == 0
    on = shape("s", ("minCount", {"count": "1"}), targets=C, path="p", message="no p", severity="sev")
    results = validate(q, [on])
    assert rows(results, "message", "severity") == [("no p", "sev")]
    assert rows(conforms(q, results)) == [("g", False, 1), ("h", True, 0)]


def test_order_and_partitions_do_not_matter(make):
    q = make(*[("g", f"s{i}", RDF_TYPE, "C") for i in range(30)], *[("g", f"s{i % 30}", "p", number(i)) for i in range(50)])
    shapes = [shape("a", ("maxCount", {"count": "1"}), targets=C, path="p"),
              shape("b", ("minInclusive", {"value": "25", "dt": INT}), targets=C, path="p")]
    assert rows(validate(q, shapes)) == rows(validate(q.repartition(9).orderBy(F.desc("o")), shapes[::-1]))


def test_shapes_as_a_table(spark, make):
    shapes = [s for family in FAMILIES.values() for s in family]
    once = list({s.id: s for s in shapes}.values())
    back = from_frame(to_frame(spark, once))
    assert [s.id for s in back] == sorted(s.id for s in once)
    by_id = {s.id: s for s in once}
    for s in back:
        want = by_id[s.id]
        assert (s.path, s.severity, set(s.targets)) == (want.path, want.severity, set(want.targets))
        assert sorted((c, tuple(sorted(p.items()))) for c, p in s.constraints) == sorted(
            (c, tuple(sorted(p.items()))) for c, p in want.constraints)


def test_rollup(make, spark):
    """A focus of two classes counts twice, one of none is dropped, empty path and shape are groups."""
    cat, ds = CLASSES[:2]
    q = make(("g", "a", RDF_TYPE, cat), ("g", "a", RDF_TYPE, ds), ("g", "b", RDF_TYPE, ds), ("h", "c", RDF_TYPE, ds))
    results = spark.createDataFrame(
        [("g", "r1", "a", "iri", "p", "s", "sev"), ("g", "r2", "b", "iri", "p", "s", "sev"), ("g", "r3", "b", "iri", None, None, "sev"),
         ("g", "r4", "c", "iri", "p", "s", "sev"), ("g", "r5", "b", "iri", "p", "s", None)],
        "g string, result_id string, focus string, focus_kind string, path string, shape string, severity string")
    want = [("g", cat, "p", "s", "sev", 1), ("g", ds, "p", "s", "sev", 2), ("g", ds, None, None, "sev", 1)]
    assert rows(report.rollup(results, q)) == sorted(want, key=repr)
    assert rows(report.rollup(results, q, keyed=False)) == sorted(want, key=repr)
    assert rows(report.rollup_total(report.rollup(results, q))) == [("g", 4)]
    assert rows(report.distinct_results(results, q)) == [("g", 5, 2)]
    nested = report.rollup_nested(report.rollup(results, q)).where(F.col("class") == ds).first()
    assert [r["count"] for r in nested["rows"]] == [1, 2]
    summary = report.validation_summary(report.rollup(results, q), q, "run")
    assert summary.where(F.col("p").endswith("hasRule")).count() == 2
    assert summary.where(F.col("p").endswith("hasTargetClassSummary")).count() == 2
    totals = rows(summary.where(F.col("p").endswith("totalViolations")), "o")
    assert totals == [("0",), ("4",)]


def test_results_as_quads_and_back(make):
    q = make(*[("g", f"s{i}", RDF_TYPE, DCAT + "Dataset") for i in range(4)], ("g", "s0", "p", "x"))
    results = validate(q, [shape("s", ("minCount", {"count": "1"}), targets=[("class", DCAT + "Dataset")], path="p")])
    back = results_from_quads(result_quads(results, "res"))
    columns = ["result_id", "focus", "focus_kind", "path", "shape", "severity"]
    assert rows(back, *columns) == rows(results, *columns)
    rolled = report.rollup(back.withColumn("g", F.lit("g")), q, keyed=False)
    assert rows(rolled, "count") == [(3,)]
