"""Paths as quads and back."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from quadlake.plans.paths import ALTERNATIVE, INVERSE, REPEATS, path_quads, path_texts
from quadlake.quads import literal
from quadlake.vocab import RDF_FIRST, RDF_NIL, RDF_REST

PATHS = [
    "^<p>", "<p>/<q>", "(<p>|<q>)", "<p>*", "<p>+", "<p>?", "^(<p>|<q>)", "(<p>|<q>)+", "^<p>*", "^(<p>|<q>|<r>)?",
    "<p>/^<q>/(<r>|<s>)/^(<p>|<q>)*/<t>+", "<p>/<p>/<p>", "<http://x/a/b(c)|d*>/^<http://x/^e+>",
]


def test_paths_come_back(spark):
    data = [(g, f"{g}:{i}", path) for g in ("a", "b") for i, path in enumerate(PATHS)]
    given = spark.createDataFrame(data + data[:3] + [("a", "simple", "http://x/p")], "g string, node string, path string")
    quads = path_quads(given)
    assert quads.count() == quads.distinct().count()
    back = path_texts(quads).where(F.col("node").rlike("^[ab]:"))
    assert rows(back, "g", "node", "path") == sorted(data, key=repr)


def test_expressions_that_no_step_says(make):
    def listed(head, *members):
        for i, m in enumerate(members):
            yield "g", f"{head}{i}" if i else head, RDF_FIRST, m
            yield "g", f"{head}{i}" if i else head, RDF_REST, f"{head}{i + 1}" if i + 1 < len(members) else RDF_NIL
    star = REPEATS["*"]
    quads = make(
        *listed("_:seq", "p", "q"), ("g", "_:inv", INVERSE, "_:seq"), ("g", "_:star", star, "_:seq"),
        ("g", "_:starstar", star, "_:star"), ("g", "_:back", INVERSE, "_:back1"), ("g", "_:back1", INVERSE, "p"),
        *listed("_:alts", "_:seq", "r"), ("g", "_:alt", ALTERNATIVE, "_:alts"),
        ("g", "_:far", INVERSE, "_:ps"), ("g", "_:ps", star, "p"),
        # No paths: a literal, itself, two expressions, a blank node that says nothing.
        ("g", "_:no1", INVERSE, literal("x")), ("g", "_:no2", star, "_:no2"), ("g", "_:no3", INVERSE, "p"),
        ("g", "_:no3", star, "p"), ("g", "_:no4", INVERSE, "_:none"), *listed("_:words", literal("x"), "p"),
        ("g", "_:no5", INVERSE, "p"), ("g", "_:no5", INVERSE, "q"))
    found = {r.node: r.path for r in path_texts(quads).collect()}
    assert found == {
        "seq": "<p>/<q>", "inv": "^(<p>/<q>)", "star": "(<p>/<q>)*", "starstar": "((<p>/<q>)*)*", "back": "^(^<p>)",
        "back1": "^<p>", "alts": "<p>/<q>/<r>", "alt": "(<p>/<q>|<r>)", "far": "^<p>*", "ps": "<p>*"}


@pytest.mark.parametrize("given", [[], [("g", "n", "http://x/p"), ("g", "n", None)]])
def test_no_paths(spark, given):
    quads = path_quads(spark.createDataFrame(given, "g string, node string, path string"))
    assert quads.count() == 0
    assert path_texts(quads).count() == 0
