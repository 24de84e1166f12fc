import datetime as dt
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_jobs import task

from quadlake.plans import jobs
from quadlake.plans.shapes import shape
from quadlake.quads import literal
from quadlake.sources import store
from quadlake.streaming import change_feed, drain
from quadlake.vocab import (
    BUSY, CONTENT, COVERAGE_OPERATION, DATA_GRAPH_OF, DCAT, FAILED, INPUT_CONTAINER, IS_PART_OF, JOB_CLASS,
    JOBS_GRAPH, PUBLIC_GRAPH, RDF_TYPE, REQUEST_CLASS, SCHEDULED, SHV, STATUS, SUCCESS, VALIDATION_OPERATION,
)

def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def message(*inserts):
    def triple(s, p, o):
        return {k: {"type": "uri", "value": v} for k, v in (("subject", s), ("predicate", p), ("object", o))}
    return json.dumps([{"inserts": [triple(*t)], "deletes": [triple("x", STATUS, SCHEDULED)]} for t in inserts])


def test_messages(spark):
    bodies = [message(("t", STATUS, SCHEDULED), ("u", "p", "o")), message(("t", STATUS, BUSY)), "[]", "no json",
              json.dumps([{"deletes": []}]), message(("t", "p", SCHEDULED))]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "message_id int, body string")
    assert rows(change_feed.inserted(df)) == [
        (0, "t", STATUS, SCHEDULED), (0, "u", "p", "o"), (1, "t", STATUS, BUSY), (5, "t", "p", SCHEDULED)]
    assert rows(change_feed.accepted(df), "message_id") == [(0,)]
    assert change_feed.refused(df).count() == 5
    assert rows(change_feed.scheduled(df)) == [("t",)]


@pytest.fixture(scope="module")
def world(make, spark, tmp_path_factory):
    """A store of catalogues and one of jobs: two coverage tasks, a validation and one without input."""
    root = tmp_path_factory.mktemp("world")
    ds = DCAT + "Dataset"
    store.create_store(make(("d1", "a", RDF_TYPE, ds), ("d1", "b", RDF_TYPE, ds), ("d2", "c", RDF_TYPE, ds),
                            ("d1", "a", "p", literal("x")), ("d3", "z", RDF_TYPE, ds)), str(root / "quads"))
    linked = []
    for name, request, operation in (("t1", "r1", COVERAGE_OPERATION), ("t2", "r2", COVERAGE_OPERATION),
                                     ("t3", "r1", VALIDATION_OPERATION), ("t4", "none", COVERAGE_OPERATION)):
        linked += task(name, operation=operation)
        linked += [(JOBS_GRAPH, name, INPUT_CONTAINER, "c" + name), (JOBS_GRAPH, "c" + name, CONTENT, request),
                   (JOBS_GRAPH, name, IS_PART_OF, "j" + name), (JOBS_GRAPH, "j" + name, RDF_TYPE, JOB_CLASS)]
    for i in (1, 2):
        linked += [(PUBLIC_GRAPH, f"r{i}", RDF_TYPE, REQUEST_CLASS), (PUBLIC_GRAPH, f"r{i}", DATA_GRAPH_OF, f"d{i}")]
    store.create_store(make(*linked), str(root / "jobs"))
    return root


SHAPES = [shape("s", ("minCount", {"count": "1"}), targets=[("class", DCAT + "Dataset")], path="p")]


def feed(world, spark, root):
    query = drain.run_feed(spark, str(root / "feed"), str(world / "jobs"), str(world / "quads"), SHAPES,
                           str(root / "out"), str(root / "checkpoint"), now())
    query.awaitTermination(600)
    assert query.exception() is None


def test_feed_drains_all_scheduled_tasks_once(world, spark, tmp_path):
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "m1.json").write_text(message(("t1", STATUS, BUSY)))
    feed(world, spark, tmp_path)
    assert not (tmp_path / "out").exists()
    (tmp_path / "feed" / "m2.json").write_text(message(("t1", STATUS, SCHEDULED)))
    feed(world, spark, tmp_path)
    out = str(tmp_path / "out")
    log = spark.read.parquet(out + "/statuses")
    assert rows(jobs.latest_status(log), "task", "status") == [
        ("t1", SUCCESS), ("t2", SUCCESS), ("t3", SUCCESS), ("t4", FAILED)]
    reports = spark.read.parquet(out + "/reports")
    totals = reports.where(F.col("p") == SHV + "totalViolations")
    assert rows(totals, "o") == [("1",), ("31",), ("62",)]
    assert rows(spark.read.parquet(out + "/results").where(F.col("p").endswith("focusNode")), "o") == [("b",)]
    links = spark.read.parquet(out + "/jobs")
    assert links.where(F.col("p").endswith("Report")).count() == 3
    assert rows(links.where(F.col("p") == CONTENT)) and links.where(F.col("p") == CONTENT).count() == 3
    # A later message finds nothing left to do.
    before = {n: rows(spark.read.parquet(f"{out}/{n}").drop("batch")) for n in ("reports", "results", "jobs", "statuses")}
    (tmp_path / "feed" / "m3.json").write_text(message(("t9", STATUS, SCHEDULED)))
    feed(world, spark, tmp_path)
    assert {n: rows(spark.read.parquet(f"{out}/{n}").drop("batch")) for n in before} == before


def test_repeated_batch_changes_nothing(world, spark, tmp_path):
    messages = spark.createDataFrame([("m", message(("t1", STATUS, SCHEDULED)))], "message_id string, body string")
    out = str(tmp_path / "out")
    args = (0, str(world / "jobs"), str(world / "quads"), SHAPES, out, now())
    assert drain.run_batch(messages, *args)
    first = {n: rows(spark.read.parquet(f"{out}/{n}")) for n in ("reports", "jobs", "statuses")}
    assert drain.run_batch(messages, *args)
    assert {n: rows(spark.read.parquet(f"{out}/{n}")) for n in first} == first


def test_status_stream_equals_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    names = [SCHEDULED, BUSY, SUCCESS]
    schema = "task string, status string, ts timestamp, id bigint"
    data = [(f"t{i % 4}", names[i % 3], start + dt.timedelta(minutes=i), i) for i in range(40)]
    for i in range(4):
        part = data[i * 10:(i + 1) * 10] + data[:3]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (jobs.latest_status(stream).writeStream.outputMode("complete").format("memory").queryName("latest")
             .trigger(availableNow=True).start())
    query.awaitTermination(300)
    batch = spark.createDataFrame(data, schema)
    assert rows(spark.table("latest"), "task", "status") == rows(jobs.latest_status(batch), "task", "status")
    query = (drain.once(stream, "2 days").writeStream.outputMode("append").format("memory").queryName("once")
             .trigger(availableNow=True).start())
    query.awaitTermination(300)
    assert sorted(r.id for r in spark.table("once").collect()) == list(range(40))


def test_illegal_against_stored_state(spark):
    schema = "task string, status string, ts timestamp, id bigint"
    at = dt.datetime(2024, 1, 1)
    batch = spark.createDataFrame([("a", BUSY, at, 1), ("b", BUSY, at, 2), ("c", SCHEDULED, at, 3), ("d", SUCCESS, at, 4),
                                   ("a", SCHEDULED, at, 5), ("a", SUCCESS, at, 6)], schema)
    stored = spark.createDataFrame([("a", SCHEDULED), ("b", SUCCESS)], "task string, status string")
    assert rows(drain.illegal_against(batch, stored)) == [
        ("a", BUSY, SCHEDULED), ("a", SCHEDULED, SUCCESS), ("b", SUCCESS, BUSY), ("d", None, SUCCESS)]
