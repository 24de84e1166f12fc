"""The store of buckets: layout, pruning, changes that rewrite only what they touch."""

import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from quadlake.operators.scan import in_graph, pattern
from quadlake.plans import jobs
from quadlake.quads import QUAD, literal
from quadlake.sources import buckets
from quadlake.vocab import BUSY, MODIFIED, RDF_TYPE, SCHEDULED, STATUS, TASK_CLASS


def many(make, n=300):
    """Many graphs, one of which holds a third of all quads."""
    return make(*[(f"urn:g:{i % 100 if i % 3 else 'hot'}", f"s{i}", f"p{i % 4}", literal(f"v{i % 50}")) for i in range(n)])


def folders(path):
    return sorted(os.listdir(f"{path}/{[f for f in os.listdir(path) if f.startswith('buckets=')][0]}"))


def files(path):
    return {os.path.join(at, f): os.path.getmtime(os.path.join(at, f)) for at, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def rows_read(df):
    """Rows that the file scans of a plan gave."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return total


def test_no_more_folders_than_buckets(make, spark, tmp_path):
    path = str(tmp_path / "s")
    q = spark.range(10_000).selectExpr(
        "concat('urn:g:', id) AS g", "concat('s', id) AS s", "'iri' AS s_kind", "'p' AS p", "'x' AS o", "'iri' AS o_kind", "'' AS o_dt", "'' AS o_lang")
    buckets.create_buckets(q.unionByName(q), path, 16)
    assert len(folders(path)) == 16 and len(files(path)) < 200
    assert buckets.n_buckets(spark, path) == 16
    assert buckets.read_buckets(spark, path).count() == 10_000
    assert rows(buckets.read_buckets(spark, path, ["urn:g:77", "urn:g:none"]), "s") == [("s77",)]
    assert buckets.read_buckets(spark, path, []).count() == 0
    with pytest.raises(ValueError):
        buckets.create_buckets(q, str(tmp_path / "t"), 0)


def test_scans_open_few_rows(make, spark, tmp_path):
    path = str(tmp_path / "s")
    q = many(make, 3000)
    buckets.create_buckets(q, path, 8)
    stored = buckets.read_buckets(spark, path)
    assert rows(stored, *QUAD) == rows(q, *QUAD)
    assert rows_read(stored) == 3000
    one = buckets.read_buckets(spark, path, ["urn:g:7"])
    assert 0 < rows_read(one) < 1000 and rows(one, *QUAD) == rows(in_graph(q, "urn:g:7"), *QUAD)
    for part in (pattern(stored, s="s77"), pattern(stored, o=literal("v7"))):
        assert part.count() > 0
    # Each subject is in one file: its Bloom filter leaves the others out.
    assert rows_read(stored.where("s = 's77'")) < 1500
    assert rows_read(stored.where("s = 'no such subject'")) < 300


def test_changes_rewrite_their_buckets_only(make, spark, tmp_path):
    path = str(tmp_path / "s")
    q = many(make)
    buckets.create_buckets(q, path, 8)
    before = files(path)
    gone = q.where("g = 'urn:g:7'").limit(1)
    new = make(("urn:g:7", "new", "p", "o"), ("urn:g:7", "new", "p", "o"))
    assert buckets.apply_changes(spark, path, gone, new) == 1
    want = rows(q.exceptAll(gone).unionByName(new.distinct()), *QUAD)
    assert rows(buckets.read_buckets(spark, path), *QUAD) == want
    kept = {f for f, t in files(path).items() if before.get(f) == t}
    assert 0 < len(before) - len(kept) < len(before)
    # A repeat changes nothing, and neither does what is not stored.
    now = files(path)
    assert buckets.apply_changes(spark, path, gone, new) == 0
    assert buckets.apply_changes(spark, path, make(("urn:g:9", "not", "there", "x")), q.where("false")) == 0
    assert files(path) == now
    # What is taken out and put in stays.
    assert buckets.apply_changes(spark, path, new, new) == 0
    assert rows(buckets.read_buckets(spark, path), *QUAD) == want


def test_an_emptied_bucket_has_no_rows(make, spark, tmp_path):
    path = str(tmp_path / "s")
    q = make(("g1", "a", "p", "o"), ("g2", "b", "p", "o"), ("g3", "c", "p", "o"))
    buckets.create_buckets(q, path, 64)
    assert buckets.apply_changes(spark, path, q.where("g = 'g2'"), q.where("false")) == 1
    assert rows(buckets.read_buckets(spark, path), "g") == [("g1",), ("g3",)]
    assert len(folders(path)) == 2


def test_status_changes_are_written(make, spark, tmp_path):
    path = str(tmp_path / "s")
    tasks = [(f"urn:g:{k}", f"t{k}", p, o) for k in range(20) for p, o in (
        (RDF_TYPE, TASK_CLASS), (STATUS, SCHEDULED), (MODIFIED, literal("2024-01-01T00:00:00")), ("p", literal(str(k))))]
    q = make(*tasks, ("urn:g:3", "no task", STATUS, SCHEDULED))
    buckets.create_buckets(q, path, 8)
    changes = spark.createDataFrame([("t3", BUSY, 1), ("t3", SCHEDULED, 0), ("no task", BUSY, 1), ("t99", BUSY, 1)], "task string, status string, at int") \
        .select("task", "status", (F.to_timestamp(F.lit("2024-02-01 00:00:00")) + F.make_dt_interval(hours="at")).alias("time"))
    want = rows(jobs.update_status(q, changes), *QUAD)
    before = files(path)
    assert jobs.store_status(spark, path, changes) == 1
    assert rows(buckets.read_buckets(spark, path), *QUAD) == want
    assert len(set(before) & set(files(path))) >= len(before) - 4
    now = files(path)
    assert jobs.store_status(spark, path, changes) == 0 and files(path) == now
