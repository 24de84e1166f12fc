import pytest
from conftest import rows
from pyspark.sql import functions as F

from quadlake.quads import QUAD, literal
from quadlake.sources import store


def sample(make, n=60):
    return make(*[(f"g:{i % 3}/x", f"s{i}", f"p{i % 4}", literal(str(i % 5))) for i in range(n)])


def test_append_keeps_a_set(make, spark, tmp_path):
    path = str(tmp_path / "store")
    q = sample(make)
    store.create_store(q.unionByName(q), path)
    assert rows(store.read_store(spark, path), *QUAD) == rows(q, *QUAD)
    more = q.unionByName(make(("g:9", "new", "p", "o"), ("g:9", "new", "p", "o")))
    for _ in range(2):
        store.append_quads(more, path)
        assert store.read_store(spark, path).count() == 61
    store.store_graph(q.where("g = 'g:1/x'").drop("g"), "g:copy", path)
    assert store.read_store(spark, path).where("g = 'g:copy'").count() == 20


def test_numeric_graph_names_stay_text(make, spark, tmp_path):
    path = str(tmp_path / "store")
    store.create_store(make(("007", "s", "p", "o")), path)
    assert rows(store.read_store(spark, path), "g") == [("007",)]


def test_batches(make):
    got = store.batch_ids(sample(make), 4)
    sizes = got.groupBy("g", "batch").agg(F.count("*").alias("n"), F.min("complete").alias("c"),
                                                    F.max("complete").alias("d")).collect()
    assert sum(r.n for r in sizes) == 60
    assert all(r.c == r.d == (r.n == 4) and r.n <= 4 for r in sizes)
    last = {}
    for r in sizes:
        last[r.g] = max(last.get(r.g, 0), r.batch)
    assert all(r.n == 4 or r.batch == last[r.g] for r in sizes)


def test_batch_size_must_be_positive(make):
    with pytest.raises(ValueError):
        store.batch_ids(sample(make), 0)
