"""Values along one step are counted from its edges, and the paths of results are looked for once."""

from conftest import rows

from quadlake.plans import paths, validation
from quadlake.plans.shapes import shape
from quadlake.quads import literal
from quadlake.vocab import RDF_TYPE

C = [("class", "C")]


def test_one_step_is_counted_before_it_meets_focus_nodes(make):
    q = make(
        ("g", "a", RDF_TYPE, "C"), ("g", "b", RDF_TYPE, "C"), ("g", "c", RDF_TYPE, "C"), ("h", "a", RDF_TYPE, "C"),
        # The same value along two predicates is one; a literal and an IRI of one text are two.
        ("g", "a", "p", "x"), ("g", "a", "q", "x"), ("g", "b", "p", "x"), ("g", "b", "q", literal("x")), ("g", "other", "p", "y"),
        ("g", "x", "in", "a"), ("g", "y", "in", "a"), ("g", "x", "out", "b"), ("g", "x", "in", "b"))
    shapes = [shape("urn:two", ("minCount", {"count": "2"}), targets=C, path=[("", "p|q")]),
              shape("urn:none", ("maxCount", {"count": "0"}), targets=C, path=[("^", "in")]),
              shape("urn:one", ("maxCount", {"count": "1"}), targets=C, path=[("^", "in|out")]),
              # Literals are focus nodes too, and along an inverse step they have values.
              shape("urn:text", ("maxCount", {"count": "0"}), targets=[("objectsOf", "q")], path=[("^", "q|p")])]
    found = validation.validate(q, shapes)
    assert rows(found, "g", "shape", "focus", "focus_kind") == sorted([
        ("g", "urn:two", "a", "iri"), ("g", "urn:two", "c", "iri"), ("h", "urn:two", "a", "iri"), ("g", "urn:none", "a", "iri"),
        ("g", "urn:none", "b", "iri"), ("g", "urn:one", "a", "iri"), ("g", "urn:text", "x", "iri"), ("g", "urn:text", "x", "literal")],
        key=repr)
    for s in shapes[:3]:
        plan = validation._findings(q, validation._Rules([s]))._jdf.queryExecution().analyzed().toString().splitlines()
        # The focus nodes meet counts, and no values.
        outer = next(i for i, line in enumerate(plan) if "Join LeftOuter" in line)
        counted = next(i for i, line in enumerate(plan) if "Aggregate" in line)
        assert outer < counted and not any("Join" in line for line in plan[counted:])


def test_result_paths_are_read_once(spark):
    given = [("urn:g", "<p>/<q>")] * 3 + [("urn:g", "(<p>|<q>)"), ("urn:g", "http://x/p"), ("urn:h", "^<p>"), ("urn:h", None)]
    results = spark.createDataFrame(given, "g string, path string")
    quads = paths.result_path_quads(results, "urn:result")
    plan = quads._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan and "ExternalRDD" not in plan
    texts = paths.path_texts(quads)
    assert {r.path for r in texts.collect()} >= {"<p>/<q>", "(<p>|<q>)", "^<p>"}
    assert quads.count() == quads.distinct().count()
