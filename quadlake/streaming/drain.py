"""From accepted change-feed messages to reports and new task states.

One micro-batch works on all scheduled tasks at once: their data graphs are
resolved, each graph is analysed once, and every output goes to a folder named
by the batch, under one commit record. The next batch sees all of it: reports and records
of runs among the jobs, result graphs among the quads, and the states of tasks.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.functions.terms import key_hash
from quadlake.operators.joins import union_of
from quadlake.plans.coverage import coverage
from quadlake.plans.jobs import (
    actionable_tasks, attach_results, data_graphs, link_report, record_quads,
    status_moves, task_endpoints, task_jobs, update_status,
)
from quadlake.plans.paths import result_path_quads
from quadlake.plans.report import (
    coverage_summary, report_text, rollup, summary_iri, validation_summary,
)
from quadlake.plans.shapes import Shape
from quadlake.plans.validation import conforms, report_quads, result_quads, validate
from quadlake.quads import QUAD_SCHEMA
from quadlake.session import cut
from quadlake.sources.store import read_store
from quadlake.streaming.change_feed import accepted, read_messages, scheduled
from quadlake.streaming.journal import EVERY, Journal
from quadlake.vocab import (
    BUSY, COVERAGE_OPERATION, COVERAGE_REPORT, FAILED, JOBS_GRAPH, LEGAL_MOVES, PUBLIC_GRAPH,
    RESULT_GRAPH_PREFIX, RESULT_PREFIX, SCHEDULED, SHACL_REPORT, SUCCESS, VALIDATION_OPERATION,
)

CHANGE_SCHEMA = "task string, status string, ts timestamp, id bigint"


def due_tasks(jobs: DataFrame, operations: Iterable[str]) -> DataFrame:
    """(task, operation, input, data_graph): scheduled tasks, data_graph NULL where unknown."""
    found = actionable_tasks(jobs.where(F.col("g") == JOBS_GRAPH), list(operations))
    once = found.groupBy(F.col("uri").alias("task")).agg(
        F.min(F.struct("created", "operation", "input")).alias("x")).select("task", "x.operation", "x.input")
    graphs = data_graphs(jobs.where(F.col("g") == PUBLIC_GRAPH)).select("input", "data_graph")
    return once.join(graphs, "input", "left").select("task", "operation", "input", "data_graph")


def only_graphs(quads: DataFrame, due: DataFrame) -> DataFrame:
    """The quads of the requested graphs; other partitions are pruned at run time."""
    wanted = due.where("data_graph IS NOT NULL").select(F.col("data_graph").alias("g")).distinct()
    return quads.join(wanted, "g", "left_semi")


def coverage_of_scheduled(messages: DataFrame, jobs: DataFrame, quads: DataFrame) -> DataFrame:
    """Coverage of every graph that a task scheduled by the messages asks for."""
    due = due_tasks(jobs, [COVERAGE_OPERATION]).join(scheduled(messages), "task", "left_semi")
    return coverage(only_graphs(quads, due))


def _changes(due: DataFrame, status: str | Column, at: Column, step: int) -> DataFrame:
    status = F.lit(status) if isinstance(status, str) else status
    return due.select("task", status.alias("status"), at.alias("ts"), F.lit(step).cast("bigint").alias("id"))


def drain(jobs: DataFrame, quads: DataFrame, shapes: list[Shape], run: str, now: Column) -> dict[str, DataFrame]:
    """All work of one run: quads to write and the status changes of its tasks.

    A task whose input names no data graph fails. Coverage and validation are
    computed once per graph and shared by its tasks.
    """
    due = cut(due_tasks(jobs, [COVERAGE_OPERATION, VALIDATION_OPERATION]))
    runnable = due.where("data_graph IS NOT NULL")
    to_cover = runnable.where(F.col("operation") == COVERAGE_OPERATION).select("task", F.col("data_graph").alias("g"))
    to_check = runnable.where(F.col("operation") == VALIDATION_OPERATION)

    covered = cut(coverage(only_graphs(quads, runnable.where(F.col("operation") == COVERAGE_OPERATION))))
    per_task = covered.join(to_cover, "g")
    endpoints = task_endpoints(jobs.where(F.col("g") == JOBS_GRAPH)).select("task", "url")
    coverage_quads = coverage_summary(per_task, run, endpoints, by="task")

    checked = only_graphs(quads, to_check)
    results = cut(validate(checked, shapes))
    verdicts = conforms(checked, results)
    result_graph = F.concat(F.lit(RESULT_GRAPH_PREFIX), key_hash(F.lit(run), "g"))
    # Only paths of more than one predicate have a structure to write.
    structure = [result_path_quads(results, result_graph)] if any(s.path and not s.predicate for s in shapes) else []
    texts = verdicts.join(report_text(results, verdicts), "g").select(
        F.col("g").alias("data_graph"), F.col("conforms").alias("success"), "text",
        result_graph.alias("result_graph"))
    runs = (
        to_check.join(texts, "data_graph").join(task_jobs(jobs).select("task", "job"), "task", "left")
        .select("task", key_hash(F.lit(run), "task").alias("id"), "input", "job", "success", "result_graph",
                F.col("text").alias("result_text")))
    summaries = validation_summary(rollup(results, checked), checked, run)

    reports = union_of(
        link_report(jobs, to_cover.select("task", summary_iri(run, "task").alias("report")), COVERAGE_REPORT),
        link_report(jobs, to_check.select("task", F.col("data_graph").alias("g")).select(
            "task", summary_iri(run).alias("report")), SHACL_REPORT))
    outcomes = union_of(
        to_cover.select("task", summary_iri(run, "task").alias("result")),
        runs.select("task", F.concat(F.lit(RESULT_PREFIX), "id").alias("result")))
    final = F.when(F.col("data_graph").isNull(), FAILED).otherwise(SUCCESS)
    return {
        "reports": union_of(coverage_quads, record_quads(runs), summaries),
        "results": union_of(result_quads(results, result_graph), *structure, report_quads(results, verdicts, result_graph)),
        "jobs": union_of(reports, attach_results(jobs, outcomes, run)),
        "statuses": union_of(_changes(due, BUSY, now, 1), _changes(due, final, now, 2)),
    }


def last_changes(log: DataFrame) -> DataFrame:
    """The last change of each task."""
    return log.groupBy("task").agg(F.max(F.struct("ts", "id", "status")).alias("x")).select(
        "task", "x.status", "x.ts", "x.id")


def current_jobs(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """The jobs after the status changes of the log."""
    return update_status(jobs, last_changes(log).select("task", "status", F.col("ts").alias("time")))


def feed_journal(spark: SparkSession, out: str, every: int = EVERY) -> Journal:
    return Journal(spark, out, {"statuses": (CHANGE_SCHEMA, last_changes)}, every)


def jobs_before(journal: Journal, jobs: DataFrame, batch: int) -> DataFrame:
    """The stored jobs with what earlier batches wrote: links, records of runs, states."""
    written = [journal.output(name, QUAD_SCHEMA, batch) for name in ("jobs", "reports")]
    return current_jobs(union_of(jobs, *written), journal.state("statuses", batch))


def quads_before(journal: Journal, quads: DataFrame, batch: int) -> DataFrame:
    """The stored quads with the result graphs and reports of earlier batches."""
    return union_of(quads, *[journal.output(name, QUAD_SCHEMA, batch) for name in ("results", "reports")])


def run_batch(messages: DataFrame, batch: int, jobs_path: str, quads_path: str, shapes: list[Shape],
              out: str, now: Column | None = None, every: int = EVERY) -> bool:
    """Handle one micro-batch; True if it had an accepted message.

    A task is taken once. A batch that was committed is not run again; one that was cut off
    sees what it saw before and writes the same.
    """
    spark = messages.sparkSession
    if accepted(messages).isEmpty():
        return False
    journal = feed_journal(spark, out, every)
    if not journal.done(batch):
        jobs = cut(jobs_before(journal, read_store(spark, jobs_path), batch))
        quads = quads_before(journal, read_store(spark, quads_path), batch)
        journal.write(batch, drain(jobs, quads, shapes, f"batch-{batch}", F.current_timestamp() if now is None else now))
    return True


def run_feed(spark: SparkSession, feed: str, jobs_path: str, quads_path: str, shapes: list[Shape],
             out: str, checkpoint: str, now: Column | None = None):
    """Start the stream that drains scheduled tasks; returns the streaming query."""
    return (
        read_messages(spark, feed).writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda df, batch: run_batch(df, batch, jobs_path, quads_path, shapes, out, now))
        .start()
    )


# -- states ----------------------------------------------------------------

def once(changes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of status changes without the repeats that arrive within the delay."""
    return changes.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])


def _moves_against(batch: DataFrame, stored: DataFrame) -> DataFrame:
    moves = status_moves(batch).join(stored.select("task", F.col("status").alias("stored")), "task", "left")
    previous = F.coalesce("previous", "stored")
    legal = previous.isNull() & (F.col("status") == SCHEDULED)
    for old, new in LEGAL_MOVES:
        legal = legal | ((previous == old) & (F.col("status") == new))
    return moves.where(~F.coalesce(legal, F.lit(False))).select("task", "id", "ts", previous.alias("previous"), "status")


def illegal_against(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """(task, previous, status): changes of a micro-batch that are no legal move.

    A change follows the one before it in the batch; the first of a task follows the
    stored state (task, status). A task that is unknown must begin as scheduled.
    """
    return _moves_against(batch, stored).select("task", "previous", "status")


ILLEGAL_SCHEMA = "task string, id bigint, ts timestamp, previous string, status string"


def state_journal(spark: SparkSession, out: str, every: int = EVERY) -> Journal:
    return Journal(spark, out, {"settled": (CHANGE_SCHEMA, last_changes)}, every)


def run_states_batch(changes: DataFrame, batch: int, out: str, delay: str = "1 hour", every: int = EVERY) -> None:
    """Judge the changes of a micro-batch, in the order of their times.

    Changes wait until the delay has passed, as an earlier one may still come. Then they are
    judged against the settled states, which they replace. Tables: illegal (only grows),
    settled (the changed states), pending and cutoff (each as of the batch).
    """
    spark = changes.sparkSession
    journal = state_journal(spark, out, every)
    if journal.done(batch):
        return
    new = cut(changes.select("task", "status", "ts", "id"))
    if new.isEmpty():
        return
    known = cut(journal.latest("pending", CHANGE_SCHEMA, batch).unionByName(new).dropDuplicates(["id"]))
    # The watermark's own precision is a millisecond.
    reach = F.date_trunc("MILLISECOND", F.max("ts") - F.expr(f"INTERVAL {delay}"))
    bounds = journal.latest("cutoff", "ts timestamp", batch).unionByName(known.agg(reach.alias("ts")))
    cutoff = cut(bounds.agg(F.max("ts").alias("ts")))
    # One row.
    due = known.join(F.broadcast(cutoff.select(F.col("ts").alias("upto"))), F.col("ts") <= F.col("upto"), "left_semi")
    left = known.join(due.select("id"), "id", "left_anti")
    journal.write(batch, {
        "illegal": _moves_against(due, journal.state("settled", batch)), "settled": last_changes(due),
        "pending": left.select("task", "status", "ts", "id"), "cutoff": cutoff})


def run_states(changes: DataFrame, out: str, checkpoint: str, delay: str = "1 hour", every: int = EVERY):
    """Start the stream that watches status changes (task, status, ts, id); returns the query.

    Repeats are taken once. A change that comes after the delay has passed is dropped by the
    watermark, as Spark does it (counted in the progress of the query).
    """
    return (
        once(changes, delay).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda df, batch: run_states_batch(df, batch, out, delay, every))
        .start()
    )


def illegal_so_far(spark: SparkSession, out: str) -> DataFrame:
    """All illegal moves seen, those of changes that still wait included."""
    journal = state_journal(spark, out)
    end = 2 ** 62
    schema = spark.createDataFrame([], ILLEGAL_SCHEMA).schema
    waiting = _moves_against(journal.latest("pending", CHANGE_SCHEMA, end), journal.state("settled", end))
    return journal.output("illegal", schema, end).unionByName(waiting)
