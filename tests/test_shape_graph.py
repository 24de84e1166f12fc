"""Shapes as quads of a shapes graph and back."""

import pytest

from conftest import rows
from quadlake.plans.paths import INVERSE
from quadlake.plans.shape_graph import shape_quads, shapes_from_quads, unread
from quadlake.plans.shapes import from_frame, shape
from quadlake.plans.validation import term_entry, validate
from quadlake.quads import literal
from quadlake.sources.nquads import format_lines, parse_lines
from quadlake.sources.sample_shapes import FAMILIES
from quadlake.vocab import RDF_FIRST, RDF_NIL, RDF_REST, RDF_TYPE, RDFS, SH, XSD_BOOLEAN, XSD_INTEGER, XSD_STRING

# Closed shapes name property shapes; these conditions and siblings have no core predicates.
APART = ("closed", "sql", "record")


def flat(s):
    return (s.id, s.path, s.severity, s.message, s.deactivated, tuple(sorted(s.targets)),
            tuple(sorted((c, tuple(sorted(p.items()))) for c, p in s.constraints)))


def test_all_shapes_come_back(spark):
    """Through N-Quads lines, so as they would be read from files."""
    shapes = {s.id: s for name, found in FAMILIES.items() if name not in APART for s in found
              if s.id != "urn:x:shape:disjoint-rights"}
    more = [
        shape("urn:all", ("pattern", {"value": "a\nb\"", "flags": "i"}), ("hasValue", {"value": "x", "kind": "literal", "dt": XSD_STRING}),
              ("class", {"value": "urn:C"}), ("class", {"value": "urn:D"}), ("in", {"values": "\n".join(
                  map(term_entry, (literal("a b", lang="de"), literal("", XSD_STRING), literal("7", XSD_INTEGER))))}),
              targets=[("class", "urn:C"), ("node", "urn:n"), ("objectsOf", "urn:p")], message="why", deactivated=True,
              path=[("^", "urn:p"), ("", "urn:q|urn:r"), ("^*", "urn:s|urn:t"), ("+", "urn:u")]),
        shape("urn:empty", ("in", {"values": ""}), path="urn:p"), shape("urn:nothing")]
    shapes |= {s.id: s for s in more}
    lines = format_lines(shape_quads(spark, shapes.values(), "urn:shapes"))
    back = from_frame(shapes_from_quads(parse_lines(lines)))
    assert {s.id: flat(s) for s in back} == {k: flat(s) for k, s in shapes.items()}


def test_what_has_no_core_predicates(spark):
    for name in ("sql", "record"):
        with pytest.raises(ValueError):
            shape_quads(spark, FAMILIES[name], "g")
    with pytest.raises(ValueError):
        shape_quads(spark, FAMILIES["qualified"], "g")


def test_blank_shapes_closed_and_siblings(make):
    """As people write them: blank property shapes, closed by their paths, disjoint siblings, a class as a shape."""
    p, q, r = "urn:p", "urn:q", "urn:r"

    def yes():
        return literal("true", XSD_BOOLEAN)

    def n(k):
        return literal(str(k), XSD_INTEGER)
    c = "urn:C"
    quads = make(
        ("s", c, RDF_TYPE, RDFS + "Class"), ("s", c, RDF_TYPE, SH + "NodeShape"), ("s", c, SH + "closed", yes()),
        ("s", c, SH + "ignoredProperties", "_:l"), ("s", "_:l", RDF_FIRST, RDF_TYPE), ("s", "_:l", RDF_REST, RDF_NIL),
        ("s", c, SH + "property", "_:one"), ("s", "_:one", SH + "path", p), ("s", "_:one", SH + "minCount", n(1)),
        ("s", "_:one", SH + "message", literal("one p")), ("s", "_:one", SH + "name", literal("p")),
        ("s", c, SH + "property", "_:two"), ("s", "_:two", SH + "path", q), ("s", "_:two", SH + "qualifiedValueShape", "_:A"),
        ("s", "_:two", SH + "qualifiedMinCount", n(1)), ("s", "_:two", SH + "qualifiedValueShapesDisjoint", yes()),
        ("s", "_:A", RDF_TYPE, SH + "NodeShape"),
        ("s", c, SH + "property", "_:three"), ("s", "_:three", SH + "path", q), ("s", "_:three", SH + "qualifiedValueShape", "_:B"),
        ("s", "_:three", SH + "qualifiedMaxCount", n(5)), ("s", "_:B", SH + "property", "_:four"),
        ("s", "_:four", SH + "path", "_:back"), ("s", "_:back", INVERSE, r), ("s", "_:four", SH + "minCount", n(1)),
        ("s", "_:off", SH + "targetClass", c), ("s", "_:off", SH + "deactivated", yes()), ("s", "_:off", SH + "sparql", "_:x"),
        ("s", "_:off", SH + "uniqueLang", literal("false", XSD_BOOLEAN)))
    found = {s.id.rsplit("-", 1)[-1]: s for s in from_frame(shapes_from_quads(quads))}
    assert set(found) == {c, "one", "two", "three", "four", "A", "B", "off"}
    closed = {x.component: dict(x.params) for x in found[c].constraints}["closed"]
    assert closed == {"allowed": f"{p}\n{q}", "ignored": RDF_TYPE}
    qualified = dict(found["two"].constraints[0].params)
    assert qualified == {"shapes": found["A"].id, "disjoint": found["B"].id, "min": "1"}
    assert dict(found["three"].constraints[0].params) == {"shapes": found["B"].id, "max": "5"}
    assert found["four"].path == (("^", r),) and found["off"].deactivated and not found["off"].constraints
    assert rows(unread(quads), "p") == [(SH + "sparql",)]

    data = make(("g", "a", RDF_TYPE, c), ("g", "a", p, "x"), ("g", "a", q, "v"), ("g", "a", "urn:other", "y"),
                ("g", "b", RDF_TYPE, c), ("g", "b", q, "w"), ("g", "z", r, "w"))
    got = rows(validate(data, shapes_from_quads(quads)), "focus", "component", "path", "message")
    # w meets both shapes, so it does not count for the disjoint one.
    assert [(f, x.rsplit("#")[1], y) for f, x, y, _ in got] == [
        ("a", "ClosedConstraintComponent", "urn:other"), ("b", "MinCountConstraintComponent", p),
        ("b", "QualifiedMinCountConstraintComponent", q)]
    assert "one p" in {m for *_, m in got}


def test_closed_shapes_mean_the_same(spark, make):
    data = make(("g", "a", RDF_TYPE, "C"), ("g", "a", "p", "x"), ("g", "a", "q", "y"))
    closed = [shape("urn:s", ("closed", {"allowed": "p", "ignored": RDF_TYPE}), targets=[("class", "C")])]
    back = shapes_from_quads(shape_quads(spark, closed, "s"))
    want = rows(validate(data, closed), "focus", "path", "component", "value")
    assert rows(validate(data, back), "focus", "path", "component", "value") == want and len(want) == 1


def test_odd_shapes_graphs(make):
    assert shapes_from_quads(make(("g", "s", "p", "o"))).count() == 0
    broken = make(("g", "s", SH + "path", "_:a"), ("g", "_:a", INVERSE, "_:b"), ("g", "_:b", RDF_FIRST, "p"),
                  ("g", "_:b", RDF_REST, "_:c"), ("g", "_:c", RDF_FIRST, "q"), ("g", "_:c", RDF_REST, RDF_NIL))
    two = make(("g", "s", SH + "path", "_:a"), ("g", "_:a", INVERSE, "p"), ("g", "_:a", INVERSE, "q"))
    for quads in (broken, two):
        with pytest.raises(Exception, match="not a sequence of steps"):
            shapes_from_quads(quads)
