"""Batches that read what earlier ones wrote, commit records, snapshots, and states on a running stream."""

import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_jobs import task
from test_streaming import SHAPES, message, now, world  # noqa: F401

from quadlake.plans import jobs
from quadlake.sources import store
from quadlake.streaming import drain
from quadlake.streaming.journal import Journal
from quadlake.vocab import (
    BUSY, CONTENT, COVERAGE_OPERATION, DATA_GRAPH_OF, EXT, FAILED, INPUT_CONTAINER, IS_PART_OF, JOB_CLASS, JOBS_GRAPH,
    PUBLIC_GRAPH, RDF_TYPE, REQUEST_CLASS, RESULT_CLASS, SCHEDULED, STATUS, SUCCESS, VALIDATION_OPERATION,
)


def linked_task(name, given, operation):
    return [*task(name, operation=operation), (JOBS_GRAPH, name, INPUT_CONTAINER, "c" + name),
            (JOBS_GRAPH, "c" + name, CONTENT, given), (JOBS_GRAPH, name, IS_PART_OF, "j" + name),
            (JOBS_GRAPH, "j" + name, RDF_TYPE, JOB_CLASS)]


def messages(spark):
    return spark.createDataFrame([("m", message(("t", STATUS, SCHEDULED)))], "message_id string, body string")


def test_second_task_takes_the_result_of_the_first(world, make, spark, tmp_path):  # noqa: F811
    jobs_path, out = str(tmp_path / "jobs"), str(tmp_path / "out")
    store.create_store(store.read_store(spark, str(world / "jobs")), jobs_path)
    args = (jobs_path, str(world / "quads"), SHAPES, out, now())
    assert drain.run_batch(messages(spark), 0, *args)
    journal = drain.feed_journal(spark, out)
    reports = spark.read.parquet(out + "/reports")
    result = reports.where((F.col("p") == RDF_TYPE) & (F.col("o") == RESULT_CLASS)).first().s
    graph = reports.where(F.col("p") == EXT + "resultGraph").first().o
    # One task starts from the result; another checks the result graph itself; a third knows nothing.
    store.append_quads(make(*linked_task("t5", result, COVERAGE_OPERATION), *linked_task("t6", "r9", COVERAGE_OPERATION),
                            *linked_task("t7", "nowhere", VALIDATION_OPERATION), (PUBLIC_GRAPH, "r9", RDF_TYPE, REQUEST_CLASS),
                            (PUBLIC_GRAPH, "r9", DATA_GRAPH_OF, graph)), jobs_path)
    assert drain.run_batch(messages(spark), 3, *args)
    second = spark.read.parquet(out + "/statuses").where("batch = 3")
    assert rows(jobs.latest_status(second), "task", "status") == [("t5", SUCCESS), ("t6", SUCCESS), ("t7", FAILED)]
    totals = spark.read.parquet(out + "/reports").where(F.col("p").endswith("totalViolations"))
    # d1 as in the first batch; the result graph has no entity of any class.
    assert rows(totals.where("batch = 3"), "o") == [("0",), ("62",)]
    assert rows(journal.state("statuses", 3).where("task = 't5'")) == []
    # A batch cut off before its commit record is not seen, and is written anew when repeated.
    second.drop("batch").withColumn("task", F.lit("ghost")).write.parquet(out + "/statuses/batch=4")
    assert journal.state("statuses", 5).where("task = 'ghost'").isEmpty()
    assert drain.run_batch(messages(spark), 4, *args)
    assert spark.read.parquet(out + "/statuses").where("batch = 4").isEmpty()


def test_snapshots_stand_for_the_batches_before(spark, tmp_path):
    schema = "task string, status string, ts timestamp, id bigint"
    at = dt.datetime(2024, 1, 1)
    journal = Journal(spark, str(tmp_path), {"log": (schema, drain.last_changes)}, every=3)
    assert journal.state("log", 0).isEmpty() and not journal.done(0)
    seen = {}
    for n in range(0, 16, 2):
        part = [(f"t{(n + k) % 5}", f"s{n}", at + dt.timedelta(minutes=n), 10 * n + k) for k in range(2)]
        seen.update({r[0]: r for r in part})
        journal.write(n, {"log": spark.createDataFrame(part, schema)})
        # Some batches are cut off later, or written twice.
        assert [tuple(r) for r in journal.state("log", n + 1).orderBy("task").collect()] == [seen[t] for t in sorted(seen)]
        assert journal.done(n) and not journal.done(n + 1)
    last, since = journal._since(16)
    assert last == 10 and since == [12, 14]
    # A repeated batch reads the snapshot before it.
    assert journal._since(10) == (4, [6, 8])
    # The folded state does not need the old batches.
    assert journal.changes("log", 16).count() < 16


def changes_of(seed, n=400, tasks=25):
    rng, start = random.Random(seed), dt.datetime(2024, 1, 1)
    names = [SCHEDULED, BUSY, SUCCESS, FAILED]
    return [(f"t{rng.randrange(tasks)}", rng.choice(names), start + dt.timedelta(seconds=37 * k), k) for k in range(n)]


SCHEMA = "task string, status string, ts timestamp, id bigint"


def feed(spark, folder, parts):
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, root, every=2):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    query = drain.run_states(stream, f"{root}/out", f"{root}/checkpoint", "1 hour", every)
    query.awaitTermination(600)
    assert query.exception() is None


def test_states_on_a_stream_equal_the_batch(spark, tmp_path):
    data = changes_of(1)
    rng = random.Random(2)
    # Changes come up to 20 minutes late, and many come twice.
    order = sorted(data, key=lambda r: r[2] + dt.timedelta(seconds=rng.randrange(1200)))
    parts = [order[k:k + 60] + order[max(0, k - 30):k] for k in range(0, len(order), 60)]
    whole = spark.createDataFrame(data, SCHEMA)
    want = rows(jobs.illegal_moves(whole).select("task", "id", "ts", "previous", "status"))
    feed(spark, f"{tmp_path}/in", parts[:4])
    run(spark, tmp_path)
    settled = spark.read.parquet(f"{tmp_path}/out/illegal").count()
    assert 0 < settled < len(want)
    # The query starts again from its checkpoint.
    feed(spark, f"{tmp_path}/in", parts[4:])
    run(spark, tmp_path)
    assert rows(drain.illegal_so_far(spark, f"{tmp_path}/out").select("task", "id", "ts", "previous", "status")) == want


def test_repeated_and_cut_off_batches_of_states(spark, tmp_path):
    data = changes_of(3, 120, 6)
    out = str(tmp_path / "out")
    whole = spark.createDataFrame(data, SCHEMA)
    parts = [spark.createDataFrame(data[k:k + 40], SCHEMA) for k in (0, 40, 80)]
    drain.run_states_batch(parts[0], 0, out, "5 minutes")
    drain.run_states_batch(parts[1], 1, out, "5 minutes")
    # Written, not committed.
    whole.limit(1).select("task", "status", "ts", "id").write.parquet(out + "/settled/batch=2")
    before = rows(drain.illegal_so_far(spark, out))
    drain.run_states_batch(parts[1], 1, out, "5 minutes")
    assert rows(drain.illegal_so_far(spark, out)) == before
    drain.run_states_batch(parts[2], 2, out, "5 minutes")
    drain.run_states_batch(parts[2].where("false"), 3, out, "5 minutes")
    got = drain.illegal_so_far(spark, out)
    assert rows(got.select("task", "id", "previous", "status")) == rows(
        jobs.illegal_moves(whole).select("task", "id", "previous", "status"))


def test_a_journal_needs_a_period(spark, tmp_path):
    with pytest.raises(ValueError):
        Journal(spark, str(tmp_path), {}, 0)
