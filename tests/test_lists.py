"""RDF lists: round trips, shared tails, rings and broken cells."""

from pyspark.sql import functions as F

from conftest import rows
from quadlake.operators.lists import list_members, list_quads
from quadlake.quads import literal
from quadlake.vocab import RDF_FIRST, RDF_NIL, RDF_REST

MEMBERS = "g string, head string, place bigint, o string, o_kind string, o_dt string, o_lang string"


def cells(g, *names, end=RDF_NIL):
    """Cells that hold the number of their place."""
    for place, (name, to) in enumerate(zip(names, [*names[1:], end])):
        yield g, name, RDF_FIRST, literal(str(place))
        yield g, name, RDF_REST, to


def read(quads):
    found: dict = {}
    for r in list_members(quads).collect():
        found.setdefault((r.g, r.head), {})[r.place] = r.o
    assert all(sorted(x) == list(range(len(x))) for x in found.values())
    return {k: [x[i] for i in range(len(x))] for k, x in found.items()}


def test_lists_come_back(spark):
    lengths = {("a", "x"): 1, ("a", "y"): 2, ("a", "z"): 37, ("b", "x"): 5}
    data = [(g, h, i, f"{h}{i % 3}", "literal", "", "") for (g, h), n in lengths.items() for i in range(n)]
    members = spark.createDataFrame(data, MEMBERS)
    quads = list_quads(members.repartition(3))
    assert quads.count() == 2 * len(data)
    assert rows(list_members(quads), *members.columns) == rows(members)


def test_a_long_list_takes_few_rounds(spark):
    members = spark.range(1000).select(
        F.lit("g").alias("g"), F.lit("h").alias("head"), F.col("id").alias("place"), F.col("id").cast("string").alias("o"),
        F.lit("literal").alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang"))
    found = list_members(list_quads(members))
    assert rows(found, "place", "o") == rows(members, "place", "o")
    # One file set per round: heads, then reaches of 1, 2, 4 and so on.
    assert len({f.rsplit("/", 2)[1] for f in found.inputFiles() if "/lists-" in f}) == 11


def test_shared_tails_rings_and_broken_cells(make):
    quads = make(
        *cells("g", "_:a", "_:b", "_:c"),                       # _:b is named on its own below
        ("g", "s", "p", "_:b"),
        *cells("g", "_:d", "_:e", end="_:c"),                   # a second way into _:c
        *cells("g", "_:r", "_:q", end="_:r"), ("g", "s", "p", "_:r"),   # a ring
        *cells("g", "_:l", "_:m", end="_:q"),                   # a list that runs into the ring
        *cells("g", "_:open", end="_:gone"),                    # ends in nothing
        *cells("g", "_:two"), ("g", "_:two", RDF_REST, "_:c"),  # two rests
        ("g", "_:bare", RDF_REST, RDF_NIL),                     # no member
        *cells("h", "_:a"),                                     # the same label in another graph
        ("g", "s", "p", RDF_NIL))
    assert read(quads) == {
        ("g", "a"): ["0", "1", "2"], ("g", "b"): ["1", "2"], ("g", "d"): ["0", "1", "2"], ("h", "a"): ["0"]}


def test_lists_of_lists(make):
    quads = make(*cells("g", "_:in", "_:in2"), ("g", "_:out", RDF_FIRST, "_:in"), ("g", "_:out", RDF_REST, RDF_NIL))
    assert read(quads) == {("g", "out"): ["in"], ("g", "in"): ["0", "1"]}


def test_no_lists(make):
    assert read(make(("g", "s", "p", "o"))) == {}
