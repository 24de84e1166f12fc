"""What does not conform is counted for each rule before it meets the value nodes."""

from conftest import rows

from quadlake.plans import validation
from quadlake.plans.shapes import shape
from quadlake.vocab import RDF_TYPE

C = [("class", "C")]
P, Q = (shape(f"urn:has-{x}", ("minCount", {"count": "1"}), path=x) for x in "pq")


def logic(component, *members):
    return shape(f"urn:{component}{len(members)}", (component, {"shapes": "\n".join(m.id for m in members)}), targets=C)


def test_logic_of_members(make):
    q = make(*[("g", s, RDF_TYPE, "C") for s in ("none", "p", "q", "both")], ("g", "p", "p", "x"), ("g", "q", "q", "x"),
             ("g", "both", "p", "x"), ("g", "both", "q", "x"), ("h", "none", "p", "x"))
    shapes = [P, Q, logic("and", P, Q), logic("or", P, Q), logic("xone", P, Q), logic("not", P), logic("node", P, P, Q)]
    assert rows(validation.validate(q, shapes), "shape", "focus") == sorted([
        ("urn:and2", "none"), ("urn:and2", "p"), ("urn:and2", "q"), ("urn:or2", "none"), ("urn:xone2", "none"),
        ("urn:xone2", "both"), ("urn:not1", "p"), ("urn:not1", "both"), ("urn:node3", "none"), ("urn:node3", "p"),
        ("urn:node3", "q")], key=repr)
    plan = validation._findings(q, validation._Rules([P, Q, logic("or", P, Q)]))._jdf.queryExecution().analyzed().toString().splitlines()
    assert next(i for i, x in enumerate(plan) if "Join LeftOuter" in x) < next(i for i, x in enumerate(plan) if "Aggregate" in x)


def test_qualified_with_siblings(make):
    q = make(("g", "a", RDF_TYPE, "C"), ("g", "b", RDF_TYPE, "C"),
             *[("g", "a", "part", x) for x in ("x", "y", "z")], ("g", "b", "part", "x"), ("g", "b", "part", "both"),
             ("g", "x", "p", "1"), ("g", "y", "p", "1"), ("g", "z", "q", "1"), ("g", "both", "p", "1"), ("g", "both", "q", "1"))
    # x and y count for a, only x for b: what has q too is a sibling's.
    apart = shape("urn:apart", ("qualified", {"shapes": P.id, "disjoint": Q.id, "min": "2", "max": "2"}), targets=C, path="part")
    plain = shape("urn:plain", ("qualified", {"shapes": P.id, "min": "1", "max": "1"}), targets=C, path="part")
    found = validation.validate(q, [P, Q, apart, plain])
    assert rows(found, "shape", "focus") == [("urn:apart", "b"), ("urn:plain", "a"), ("urn:plain", "b")]
