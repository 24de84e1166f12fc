"""Coverage kept from changes, and custom conditions over the record of a focus node."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_validation import C, violations

from quadlake.plans.coverage import coverage
from quadlake.plans.shapes import shape
from quadlake.plans.validation import conforms, report_quads, reports_from_quads, result_quads, results_from_quads, validate
from quadlake.quads import literal
from quadlake.sources.buckets import create_buckets, read_buckets
from quadlake.spec import RULES
from quadlake.streaming.standing import StandingCoverage, change_store
from quadlake.vocab import RDF_TYPE


def some_quads(rng, n):
    classes, properties = sorted({r.cls for r in RULES}), sorted({r.property for r in RULES})
    out = set()
    while len(out) < n:
        g, s = f"g{rng.randrange(3)}", f"s{rng.randrange(12)}"
        kind = rng.randrange(4)
        out.add((g, s, RDF_TYPE, rng.choice(classes)) if kind == 0 else
                (g, s, rng.choice(properties), f"o{rng.randrange(3)}") if kind < 3 else (g, s, "other", "x"))
    return sorted(out)


def test_standing_coverage_follows_the_changes(make, spark, tmp_path):
    rng = random.Random(5)
    path = str(tmp_path / "store")
    first = some_quads(rng, 60)
    create_buckets(make(*first, ("gone", "z", "other", "x")), path, 4)
    standing = StandingCoverage(spark, str(tmp_path / "standing"), every=2)
    standing.change(0, read_buckets(spark, path))
    assert rows(standing.coverage()) == rows(coverage(read_buckets(spark, path)))
    for batch in (1, 2, 3):
        there = [tuple(r) for r in read_buckets(spark, path).select("g", "s", "p", "o").collect()]
        less = rng.sample(there, 15) + [("gone", "z", "other", "x")] + some_quads(rng, 5)
        more = some_quads(rng, 20) + rng.sample(there, 5) + less[:2]
        change_store(standing, path, batch, make(*less), make(*more, *more[:3]))
        want = rows(coverage(read_buckets(spark, path)))
        assert rows(standing.coverage()) == want
        # A repeat changes nothing.
        change_store(standing, path, batch, make(*less), make(*more))
        assert rows(standing.coverage()) == want
    assert not any(r.g == "gone" for r in standing.coverage().collect())
    assert standing.coverage(1).count() == 4 * len(RULES)


def test_condition_over_two_properties_of_the_focus(make):
    data = []
    for name, a, b in (("fine", ["2"], ["3"]), ("late", ["5"], ["3"]), ("several", ["1", "2"], ["2", "9"]), ("bad", ["1", "4"], ["3"]),
                       ("none", [], ["3"]), ("nothing", [], [])):
        data += [(name, RDF_TYPE, "C"), (name, "p", literal("v"))]
        data += [(name, "start", literal(x)) for x in a] + [(name, "end", literal(x)) for x in b]
    rule = ("sql", {"expr": "value = 'v' AND (beginning.n = 0 OR beginning.most <= ending.least)", "fields": "beginning start\nending end"})
    plain = ("sql", {"expr": "value <> 'v' OR focus <> 'fine'"})
    got = violations(make, data, shape("s", rule, targets=C, path="p"), shape("t", plain, targets=C, path="p"), columns=("shape", "focus"))
    assert got == [("s", "bad"), ("s", "late"), ("t", "fine")]


@pytest.mark.parametrize("fields", ["value p", "two", "a p\na q", "Big p", "focus p", "rule p"])
def test_names_of_fields(make, fields):
    rule = ("sql", {"expr": "true", "fields": fields})
    with pytest.raises(ValueError):
        violations(make, [("a", RDF_TYPE, "C"), ("a", "p", literal("v"))], shape("s", rule, targets=C, path="p"), columns=("focus",))


def test_report_nodes(make):
    q = make(("g1", "a", RDF_TYPE, "C"), ("g1", "b", RDF_TYPE, "C"), ("g2", "c", RDF_TYPE, "C"), ("g2", "c", "p", "x"))
    results = validate(q, [shape("s", ("minCount", {"count": "1"}), targets=C, path="p")])
    graph = F.concat(F.lit("urn:r:"), "g")
    written = report_quads(results, conforms(q, results), graph).unionByName(result_quads(results, graph))
    assert rows(reports_from_quads(written), "g", "conforms", "results") == [("urn:r:g1", False, 2), ("urn:r:g2", True, 0)]
    ids = {r.result_id for r in results.collect()}
    assert {r.o for r in written.where(F.col("p").endswith("#result")).collect()} == ids
    # Stored results are read as before.
    assert results_from_quads(written).count() == 2
