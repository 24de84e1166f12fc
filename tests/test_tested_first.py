"""Values along one predicate are tested before they meet focus nodes; the results stay the same."""

import pytest
from conftest import rows

from quadlake.plans import validation
from quadlake.plans.shapes import shape
from quadlake.quads import literal
from quadlake.vocab import RDF_TYPE, XSD_INTEGER

KIND = ("nodeKind", {"value": "IRI"})
LESS = ("lessThan", {"predicate": "high"})


def number(x):
    return literal(str(x), XSD_INTEGER)


@pytest.fixture(scope="module")
def q(make):
    return make(
        ("g", "a", RDF_TYPE, "C"), ("g", "a", "low", number(1)), ("g", "a", "low", number(7)), ("g", "a", "high", number(5)),
        ("g", "a", "high", number(9)), ("g", "b", RDF_TYPE, "C"), ("g", "b", "low", "x"), ("g", "b", "part", "d"),
        ("g", "b", "part", literal("d")), ("g", "other", "low", number(7)), ("g", "other", "high", number(5)),
        ("h", "a", "low", number(9)), ("h", "a", "high", number(2)), ("g", "d", "low", number(8)), ("g", "d", "high", number(8)))


@pytest.mark.parametrize("constraint", [KIND, LESS])
def test_tests_lie_below_the_focus_join(q, constraint):
    rules = validation._Rules([shape("urn:s", constraint, targets=[("class", "C")], path="low")])
    plan = validation._findings(q, rules)._jdf.queryExecution().analyzed().toString()
    tested = next(i for i, line in enumerate(plan.splitlines()) if "Filter" in line and "NOT" in line)
    assert min(i for i, line in enumerate(plan.splitlines()) if "Join Inner" in line) < tested


def test_only_focus_nodes_are_reported(q):
    shapes = [shape("urn:kind", KIND, targets=[("class", "C")], path="low"),
              shape("urn:less", LESS, targets=[("class", "C")], path="low"),
              # A literal is a focus node, but the subject of nothing.
              shape("urn:deep", LESS, targets=[("objectsOf", "part")], path="low"),
              shape("urn:inner", LESS, path="low"),
              shape("urn:outer", ("node", {"shapes": "urn:inner"}), targets=[("class", "C")], path="part")]
    found = validation.validate(q, shapes)
    assert rows(found, "g", "shape", "focus", "value") == sorted([
        ("g", "urn:kind", "a", "1"), ("g", "urn:kind", "a", "7"), ("g", "urn:less", "a", "7"),
        ("g", "urn:deep", "d", "8"), ("g", "urn:outer", "b", "d")], key=repr)
