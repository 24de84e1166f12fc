import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_buckets import rows_read

from quadlake.operators import scan
from quadlake.quads import as_set, bnode, iri, literal
from quadlake.vocab import RDF_TYPE, SKOLEM_BASE, XSD_INTEGER


@pytest.fixture(scope="module")
def q(make):
    return make(
        ("g1", "a", "p", "b"), ("g1", "a", "p", literal("b")), ("g1", "a", "q", literal("1")),
        ("g1", "a", "q", literal("1", XSD_INTEGER)), ("g2", "a", "p", "b"), ("g1", "_:x", "p", "_:y"),
        ("g1", "c", RDF_TYPE, "C"), ("g2", "c", "p", literal("hi", lang="EN")),
    )


def test_literal_is_not_iri(q):
    assert rows(scan.pattern(q, "g1", p="p", o="b"), "s") == [("a",)]
    assert rows(scan.pattern(q, "g1", p="p", o=literal("b")), "s") == [("a",)]
    assert scan.pattern(q, "g1", o=literal("1")).count() == 1
    assert scan.pattern(q, "g1", o=literal("1", XSD_INTEGER)).count() == 1


def test_each_combination(q):
    assert scan.pattern(q, "g1").count() == 6
    assert scan.pattern(q, "g1", s="a").columns == ["p", "o", "o_kind", "o_dt", "o_lang"]
    assert scan.pattern(q, "g1", s="a", p="p").count() == 2
    assert rows(scan.pattern(q, "g1", s="a", o="b")) == [("p",)]
    assert scan.pattern(q, "g1", s=bnode("x")).count() == 1
    assert scan.pattern(q, "nothing").count() == 0
    assert rows(scan.pattern(q, "g2", s="c"), "o_lang") == [("en",)]


def test_default_graph_counts_a_triple_once(q):
    assert scan.pattern(q, s="a", p="p").count() == 2
    assert scan.default_size(q).first().triples == 7
    assert rows(scan.graph_size(q)) == [("g1", 6), ("g2", 2)]
    assert scan.match(q, s="a", p="p").count() == 3


def test_ask(q):
    assert scan.ask(q, "a", "p", "b").first().found
    assert not scan.ask(q, "a", "p", "z", "g1").first().found
    assert not scan.ask(q, "a", "p", literal("b"), "g2").first().found
    with pytest.raises(ValueError):
        scan.pattern(q, "g1", "a", "p", "b")
    with pytest.raises(ValueError):
        scan.pattern(q, "g1", s="a", order_by="s")


def test_order_of_terms(q):
    got = [tuple(r) for r in scan.pattern(q, "g1", order_by="o").select("o_kind", "o").collect()]
    assert [k for k, _ in got] == ["bnode", "iri", "iri", "literal", "literal", "literal"]
    assert got[1:3] == [("iri", "C"), ("iri", "b")]


@pytest.fixture(scope="module")
def many(spark):
    return spark.range(1000).select(
        F.format_string("s%04d", "id").alias("s"), F.lit("iri").alias("s_kind"), (F.col("id") % 7).alias("x"))


def test_pages_are_slices_of_the_order(many):
    order = scan.term_order(many, "s")
    everything = [r.s for r in many.orderBy(*order).collect()]
    for limit, offset in ((10, 0), (10, 35), (None, 990), (7, 998), (0, 3), (5, 5000)):
        got = [r.s for r in scan.page(many, order, limit, offset).collect()]
        assert got == everything[offset:][:limit]


def test_kept_pages_open_only_their_parts(many, spark):
    pages = scan.Pages(many, scan.term_order(many, "s"), parts=8)
    parts = len(pages._parts)
    assert pages.total == 1000 and parts > 1
    plans = set()
    for offset in range(0, 1000, 100):
        page = pages.page(100, offset)
        assert [r.s for r in page.collect()] == [f"s{i:04d}" for i in range(offset, offset + 100)]
        opened = pages.files(100, offset)
        assert opened < parts
        # Only the rows of the opened parts are read.
        assert rows_read(page) <= sum(end - first for _, first, end in pages._near(offset, offset + 100)) + opened
        plans.add(tuple(line.strip("+-: |").split("(")[0] for line in page._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    # Deep pages are planned like the first one.
    assert len({tuple(word.split(" ")[0] for word in p) for p in plans}) == 1
    assert pages.files() == parts and pages.files(0, 5000) == 0


def test_pages_of_nothing(many):
    pages = scan.Pages(many.where("false"), scan.term_order(many, "s"))
    assert pages.total == 0 and pages.page(10, 0).count() == 0


def test_numbered(many):
    got = rows(scan.numbered(many.repartition(13), scan.term_order(many, "s")), "row", "s")
    assert sorted(got) == [(i, f"s{i:04d}") for i in range(1000)]


def test_key_set_paging_walks_everything(many):
    seen, last = [], None
    while True:
        page = (scan.page(many, scan.term_order(many, "s"), 300) if last is None
                else scan.after(many, "s", last, 300)).collect()
        if not page:
            break
        seen += [r.s for r in page]
        last = page[-1].asDict()
    assert seen == [f"s{i:04d}" for i in range(1000)]


def test_empty_value_list(q):
    assert scan.with_values(q, "p", []).count() == 0
    assert scan.with_values(q, "p", ["p", "q"]).count() == 7


def test_skolemize_scopes_labels_by_graph(make):
    got = scan.skolemize(make(("g1", "_:x", "p", "_:y"), ("g2", "_:x", "p", literal("x"))))
    found = got.select("g", "s", "s_kind", "o", "o_kind").orderBy("g").collect()
    assert all(r.s_kind == "iri" and r.s.startswith(SKOLEM_BASE) for r in found)
    assert found[0].s != found[1].s and found[0].o_kind == "iri" and found[1].o_kind == "literal"


def test_unbound(spark):
    df = spark.createDataFrame([("a", None)], "s string, o string")
    assert rows(scan.fill_unbound(df, "s", "o")) == [("a", "urn:undef:o")]


def test_as_set(q):
    assert as_set(q.unionByName(q)).count() == q.count()
    assert iri("a") != literal("a")
