from conftest import rows
from pyspark.sql import functions as F

from quadlake.operators import checks, counts
from quadlake.operators.scan import in_graph
from quadlake.plans.coverage import coverage, coverage_nested, coverage_total
from quadlake.plans.shapes import mandatory_shapes
from quadlake.plans.validation import validate
from quadlake.quads import literal
from quadlake.queries import quads_of
from quadlake.spec import CLASSES, RULES, SEVERITY, Rule
from quadlake.vocab import DCAT, DCT, RDF_TYPE

CATALOG, DATASET = DCAT + "Catalog", DCAT + "Dataset"
TITLE = DCT + "title"


def sample(make):
    return make(
        ("g1", "a", RDF_TYPE, CATALOG), ("g1", "a", TITLE, literal("x")), ("g1", "a", TITLE, literal("y")),
        ("g1", "b", RDF_TYPE, CATALOG), ("g1", "b", RDF_TYPE, DATASET), ("g1", "c", TITLE, literal("no type")),
        ("g2", "a", RDF_TYPE, CATALOG), ("g2", "d", RDF_TYPE, literal(CATALOG)), ("g3", "z", "other", "z"),
    )


def test_rule_set():
    assert len(RULES) == 67 and len({r.property for r in RULES}) == 52
    sizes = {}
    for r in RULES:
        sizes[(r.cls.rsplit("#")[1], r.requirement)] = sizes.get((r.cls.rsplit("#")[1], r.requirement), 0) + 1
    assert sizes == {
        ("Catalog", "mandatory"): 6, ("Catalog", "recommended"): 5, ("Catalog", "optional"): 4,
        ("Dataset", "mandatory"): 7, ("Dataset", "recommended"): 9, ("Dataset", "optional"): 15,
        ("Distribution", "mandatory"): 4, ("Distribution", "recommended"): 3, ("Distribution", "optional"): 8,
        ("CatalogRecord", "mandatory"): 4, ("CatalogRecord", "optional"): 2}


def test_counts_per_graph(make):
    got = coverage(sample(make))
    assert got.count() == 3 * 67
    def at(g, cls, p):
        r = got.where((F.col("g") == g) & (F.col("class") == cls) & (F.col("property") == p)).first()
        return r.total_entities, r.entities_with_property, r.violation_count, r.severity
    violation = SEVERITY["mandatory"]
    assert at("g1", CATALOG, TITLE) == (2, 1, 1, violation)
    assert at("g1", DATASET, TITLE) == (1, 0, 1, violation)
    assert at("g2", CATALOG, TITLE) == (1, 0, 1, violation)
    assert at("g3", CATALOG, TITLE) == (0, 0, 0, violation)
    assert dict(rows(coverage_total(got))) == {"g1": 2 * 15 - 1 + 31, "g2": 15, "g3": 0}


def test_repeats_and_order_do_not_matter(make):
    q = sample(make)
    assert rows(coverage(q.unionByName(q).repartition(7))) == rows(coverage(q))


def test_own_rules(make, spark):
    q = sample(make)
    spec = spark.createDataFrame([(CATALOG, "mandatory", RDF_TYPE), (CATALOG, "optional", TITLE)],
                                 "class string, requirement string, property string")
    got = rows(coverage(in_graph(q, "g1"), spec), "requirement", "total_entities", "entities_with_property")
    assert got == [("mandatory", 2, 2), ("optional", 2, 1)]


def test_more_properties_than_bits(make):
    q = make(*[("g", f"s{i}", RDF_TYPE, "C") for i in range(5)],
             *[("g", f"s{i % 5}", f"p{i}", "o") for i in range(0, 200, 3)])
    spec = [Rule("C", "optional", f"p{i}") for i in range(200)]
    got = {r.property: r.entities_with_property for r in coverage(q, spec).collect()}
    assert got == {f"p{i}": int(i % 3 == 0) for i in range(200)}


def test_nested(make):
    r = coverage_nested(coverage(sample(make))).where("g = 'g1'").first()
    assert [c.class_uri for c in r.class_coverages] == sorted(CLASSES)
    assert sum(v.violation_count for c in r.class_coverages for v in c.rule_violations) == r.total_violations


def test_counts_agree_with_coverage(make):
    q = sample(make)
    assert rows(counts.count_entities(q, CLASSES)) == [("g1", CATALOG, 2), ("g1", DATASET, 1), ("g2", CATALOG, 1)]
    assert rows(counts.count_with_property(q, CLASSES, [TITLE])) == [("g1", CATALOG, TITLE, 1)]
    empty = counts.count_with_property(q, CLASSES, [])
    assert empty.count() == 0 and empty.columns == ["g", "class", "property", "entities"]


def test_coverage_equals_min_count_results(spark):
    """Two independent ways to one number, over whole tables."""
    q = quads_of(spark, "/root/testdata/sf0.001")
    missing = coverage(q).where("requirement = 'mandatory'").agg(F.sum("violation_count")).first()[0]
    assert missing == validate(q, mandatory_shapes()).count() == 3063


def test_reuse_and_typos(make):
    q = sample(make).unionByName(make(
        ("g1", "t", DCAT + "Dataset", "x"), ("g1", "t", DCAT + "Dataset", "y"), ("g2", "t", DCAT + "dataset", "x")))
    assert rows(checks.uri_reuse(q)) == [("g1", "b", [CATALOG, DATASET])]
    assert rows(checks.capitalization_typos(q)) == [("g1", DCAT + "Dataset", DCAT + "dataset", 2)]
    assert ("g1", "b", f"{CATALOG},{DATASET}") in rows(checks.type_lists(q))
