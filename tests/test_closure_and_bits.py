"""Closure in doubling rounds, class bits over subclasses, and shared frames of a level."""

import pytest
from conftest import rows

from quadlake.operators import closure as module
from quadlake.operators.closure import closure, edges_of
from quadlake.plans import validation
from quadlake.plans.shapes import shape
from quadlake.vocab import RDF_TYPE, SUBCLASS_OF

A = ["g", "a", "a_kind", "a_dt", "a_lang"]


@pytest.fixture
def rounds(monkeypatch):
    """How often pairs were put together."""
    seen = []
    then = module._then
    monkeypatch.setattr(module, "_then", lambda *a: seen.append(1) or then(*a))
    return seen


def test_a_long_chain_takes_few_rounds(make, spark, rounds):
    q = make(*[("g", f"n{i}", "p", f"n{i + 1}") for i in range(1000)])
    edges = edges_of(q, ["p"])
    found = closure(edges, edges.where("a = 'n0'").select(*A))
    assert found.count() == 1000 and found.where("b = 'n1000'").count() == 1
    assert len(rounds) <= 2 * 12
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation") <= 4


def test_cycles_and_loops(make):
    q = make(("g", "a", "p", "b"), ("g", "b", "p", "c"), ("g", "c", "p", "a"), ("g", "c", "p", "d"), ("g", "e", "p", "e"),
             ("h", "a", "p", "z"), ("g", "x", "p", "a"))
    edges = edges_of(q, ["p"])

    def reach(seed, reflexive=False):
        return [r[0] for r in rows(closure(edges, edges.where(f"a = '{seed}' AND g = 'g'").select(*A), reflexive), "b")]

    assert reach("a") == ["a", "b", "c", "d"]
    assert reach("x") == ["a", "b", "c", "d"]
    assert reach("x", True) == ["a", "b", "c", "d", "x"]
    assert reach("e") == ["e"]
    assert reach("none") == []


def presence(make, *more):
    shapes = [shape("urn:s1", ("minCount", {"count": "1"}), targets=[("class", "C")], path="p"),
              shape("urn:s2", ("minCount", {"count": "1"}), targets=[("class", "D")], path="q")]
    q = make(("g", "a", RDF_TYPE, "C"), ("g", "a", "p", "x"), ("g", "b", RDF_TYPE, "C"), ("g", "c", RDF_TYPE, "Sub"), ("g", "d", RDF_TYPE, "Low"),
             ("g", "d", "p", "x"), ("g", "e", RDF_TYPE, "Low"), ("g", "e", RDF_TYPE, "D"), ("h", "f", RDF_TYPE, "Sub"), *more)
    results = validation.validate(q, shapes)
    return rows(results, "g", "shape", "focus"), results


def test_presence_follows_subclasses(make):
    chain = [("g", "Sub", SUBCLASS_OF, "C"), ("g", "Low", SUBCLASS_OF, "Sub"), ("g", "Low", SUBCLASS_OF, "D")]
    found, _ = presence(make, *chain)
    assert found == [("g", "urn:s1", "b"), ("g", "urn:s1", "c"), ("g", "urn:s1", "e"), ("g", "urn:s2", "d"), ("g", "urn:s2", "e")]
    cycle, _ = presence(make, *chain, ("g", "C", SUBCLASS_OF, "Low"))
    assert cycle == sorted([*found, ("g", "urn:s2", "a"), ("g", "urn:s2", "b"), ("g", "urn:s2", "c")])


def test_an_unrelated_subclass_changes_no_plan(make):
    def exchanges(results):
        return results._jdf.queryExecution().executedPlan().toString().count("Exchange")

    found, plain = presence(make)
    also, other = presence(make, ("g", "U", SUBCLASS_OF, "V"))
    assert found == also and exchanges(plain) == exchanges(other)


def test_families_share_focus_and_values(make, monkeypatch):
    """Targets and facts are joined once for a level, whatever the number of families."""
    calls = []
    for name in ("_targets", "_values"):
        f = getattr(validation, name)
        monkeypatch.setattr(validation, name, lambda *a, f=f, name=name: calls.append(name) or f(*a))
    target = [("class", "C")]
    shapes = [
        shape("urn:a", ("datatype", {"value": "http://www.w3.org/2001/XMLSchema#string"}), ("class", {"value": "K"}), targets=target, path="p"),
        shape("urn:b", ("hasValue", {"value": "x", "kind": "iri"}), targets=target, path="p"),
        shape("urn:c", ("maxCount", {"count": "1"}), ("equals", {"predicate": "q"}), targets=target, path="p"),
        shape("urn:d", ("closed", {"allowed": "p", "ignored": RDF_TYPE}), targets=target)]
    q = make(("g", "a", RDF_TYPE, "C"), ("g", "a", "p", "x"), ("g", "a", "p", "y"), ("g", "a", "q", "x"))
    try:
        together = rows(validation.validate(q, shapes), "shape", "focus", "value", "component")
    finally:
        n = calls.count("_targets"), calls.count("_values")
    assert n == (1, 1)
    alone = [r for s in shapes for r in rows(validation.validate(q, [s]), "shape", "focus", "value", "component")]
    assert together == sorted(alone, key=repr)
