"""Job tables kept as quads: tasks, requests, results, status changes.

All functions work on every task at once; asking for one task is a filter on
the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadlake.functions.terms import headers_map, key_hash, mint
from quadlake.operators.joins import existing, optional, path_value, star, union_of, values_of
from quadlake.operators.records import insert, link, records, text
from quadlake.operators.scan import in_graph
from quadlake.quads import QUAD, SUBJECT, of_type
from quadlake.session import cut
from quadlake.sources.buckets import apply_changes, read_buckets
from quadlake.vocab import (
    CONTAINER_CLASS, CONTAINER_PREFIX, CONTENT, CREATED, DATA_GRAPH_OF, DCT, ENDPOINT_URL, EXT,
    HEADERS, INPUT_CONTAINER, IRI, IS_PART_OF, JOB_CLASS, JOB_PREFIX, JOBS_GRAPH, LEGAL_MOVES,
    MODIFIED, OPERATION, PUBLIC_GRAPH, RDF_TYPE, REQUEST_CLASS, REQUEST_PREFIX, RESULT_CLASS,
    RESULT_PREFIX, RESULTS_CONTAINER, SCHEDULED, STATUS, TASK, TASK_CLASS, TASK_PREFIX, UUID,
    VALIDATED, XSD_BOOLEAN, XSD_DATETIME,
)

_KEY = ["g", *SUBJECT]


def iso(ts: Column) -> Column:
    """A timestamp as the text of an xsd:dateTime; a fraction of a second only where there is one."""
    return F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0{1,6}$", "")


# -- reading ---------------------------------------------------------------

def task_star(quads: DataFrame) -> DataFrame:
    """Tasks with the five parts a runnable task must have."""
    fields = {"created": CREATED, "status": STATUS, "operation": OPERATION, "id": UUID}
    return star(quads, fields, TASK_CLASS)


def scheduled_tasks(quads: DataFrame) -> DataFrame:
    """(g, task) of the subjects whose status is scheduled."""
    waiting = quads.where((F.col("p") == STATUS) & (F.col("o") == SCHEDULED) & (F.col("o_kind") == IRI))
    return waiting.select("g", F.col("s").alias("task"))


def tasks(quads: DataFrame) -> DataFrame:
    """One typed record per task: times as timestamps, headers as a map."""
    fields = {"id": UUID, "created": CREATED, "modified": MODIFIED, "status": STATUS,
              "operation": OPERATION, "job": IS_PART_OF, "container": INPUT_CONTAINER,
              "headers": HEADERS, "index": TASK + "index"}
    found = (records(quads, fields)
             .join(of_type(quads, TASK_CLASS).select("g", F.col("s").alias("uri")), ["g", "uri"], "left_semi"))
    inputs = values_of(quads, CONTENT, "input").groupBy("g", F.col("s").alias("container")) \
        .agg(F.min("input").alias("input"))
    jobs = quads.where(F.col("p") == OPERATION).groupBy("g", F.col("s").alias("job")) \
        .agg(F.min("o").alias("job_operation"))
    return (
        found.join(inputs, ["g", "container"], "left").join(jobs, ["g", "job"], "left")
        .select("g", "uri", "id", F.col("created").try_cast("timestamp").alias("created"),
                F.col("modified").try_cast("timestamp").alias("modified"), "status", "operation", "job",
                "job_operation", "input", headers_map(F.col("headers")).alias("headers"), "index")
    )


def actionable_tasks(quads: DataFrame, operations: Sequence[str]) -> DataFrame:
    """Scheduled tasks of the operations, one row per combination of values."""
    found = task_star(quads).where((F.col("status") == SCHEDULED) & F.col("operation").isin(*operations))
    for part in (path_value(quads, "input", INPUT_CONTAINER, CONTENT),
                 path_value(quads, "job_operation", IS_PART_OF, OPERATION),
                 values_of(quads, HEADERS, "headers")):
        found = optional(found, part)
    return found.select("g", F.col("s").alias("uri"), "id", "created", "input", "operation",
                        "job_operation", "headers")


def next_task(quads: DataFrame, operations: Sequence[str]) -> DataFrame:
    """The task to run next: the oldest one, then by IRI."""
    found = actionable_tasks(quads, operations)
    return found.orderBy("created", "uri", *[c for c in found.columns if c not in ("created", "uri")]).limit(1)


def task_jobs(quads: DataFrame) -> DataFrame:
    """(g, task, job) where both ends have their type."""
    parts = of_type(quads, TASK_CLASS).drop("class").join(values_of(quads, IS_PART_OF, "job"), _KEY)
    jobs = of_type(quads, JOB_CLASS).select("g", F.col("s").alias("job"))
    return parts.join(jobs, ["g", "job"], "left_semi").select("g", F.col("s").alias("task"), "job")


def task_endpoints(quads: DataFrame) -> DataFrame:
    """(g, task, url): one endpoint per task, the first by its text."""
    return (path_value(quads, "url", IS_PART_OF, ENDPOINT_URL)
            .groupBy("g", F.col("s").alias("task")).agg(F.min("url").alias("url")))


def requests(quads: DataFrame) -> DataFrame:
    """(g, input, data_graph): every value of every validation request."""
    typed = of_type(quads, REQUEST_CLASS).drop("class")
    return typed.join(values_of(quads, DATA_GRAPH_OF, "data_graph"), _KEY).select(
        "g", F.col("s").alias("input"), "data_graph")


def data_graphs(quads: DataFrame) -> DataFrame:
    """(g, input, data_graph) of requests and, through what they validated, of results."""
    results = of_type(quads, RESULT_CLASS).drop("class")
    through = results.join(path_value(quads, "data_graph", VALIDATED, DATA_GRAPH_OF), _KEY).select(
        "g", F.col("s").alias("input"), "data_graph")
    return union_of(requests(quads), through).groupBy("g", "input").agg(F.min("data_graph").alias("data_graph"))


def result_graphs(quads: DataFrame) -> DataFrame:
    """(result_graph, data_graph) by the records of validation runs."""
    records = star(quads, {"result_graph": EXT + "resultGraph"}, RESULT_CLASS)
    data = path_value(quads, "data_graph", VALIDATED, DATA_GRAPH_OF)
    return records.join(data, _KEY).select("result_graph", "data_graph").distinct()


# -- writing ---------------------------------------------------------------

def request_quads(new: DataFrame, g: str = PUBLIC_GRAPH) -> DataFrame:
    """Quads of validation requests from (id, data_graph)."""
    uri = F.concat(F.lit(REQUEST_PREFIX), "id")
    return insert(new, g, [link(uri, RDF_TYPE, REQUEST_CLASS), text(uri, UUID, F.col("id")),
                           link(uri, DATA_GRAPH_OF, F.col("data_graph"))])


def record_quads(runs: DataFrame, g: str = PUBLIC_GRAPH) -> DataFrame:
    """Quads of validation results from (id, input, job, success, result_graph, result_text)."""
    uri = F.concat(F.lit(RESULT_PREFIX), "id")
    return insert(runs, g, [
        link(uri, RDF_TYPE, RESULT_CLASS), text(uri, UUID, F.col("id")),
        link(uri, VALIDATED, F.col("input")), link(uri, EXT + "job", F.col("job")),
        text(uri, EXT + "validationSuccess", F.col("success").cast("string"), XSD_BOOLEAN),
        link(uri, EXT + "resultGraph", F.col("result_graph")),
        text(uri, EXT + "resultText", F.col("result_text")),
    ])


def task_quads(new: DataFrame, g: str = JOBS_GRAPH) -> DataFrame:
    """Container, job and task of new tasks.

    Takes (id, input, operation, job_operation, headers map, created, modified);
    the IRIs of container and job follow from the id.
    """
    container_id = key_hash(F.lit("container"), "id")
    job_id = key_hash(F.lit("job"), "id")
    container = F.concat(F.lit(CONTAINER_PREFIX), container_id)
    job = F.concat(F.lit(JOB_PREFIX), job_id)
    task = F.concat(F.lit(TASK_PREFIX), "id")
    created, modified = iso(F.col("created")), iso(F.col("modified"))
    headers = F.when(F.size("headers") > 0, F.to_json("headers"))
    return insert(new, g, [
        link(container, RDF_TYPE, CONTAINER_CLASS), text(container, UUID, container_id),
        link(container, CONTENT, F.col("input")),
        link(job, RDF_TYPE, JOB_CLASS), text(job, UUID, job_id),
        text(job, CREATED, created, XSD_DATETIME), text(job, MODIFIED, created, XSD_DATETIME),
        text(job, DCT + "creator", "empty"), link(job, OPERATION, F.col("job_operation")),
        link(job, STATUS, SCHEDULED),
        link(task, RDF_TYPE, TASK_CLASS), text(task, HEADERS, headers), text(task, UUID, F.col("id")),
        text(task, CREATED, created, XSD_DATETIME), text(task, MODIFIED, modified, XSD_DATETIME),
        text(task, TASK + "index", "0"), link(task, IS_PART_OF, job),
        link(task, INPUT_CONTAINER, container), link(task, OPERATION, F.col("operation")),
        link(task, STATUS, SCHEDULED),
    ])


def _status_targets(quads: DataFrame, changes: DataFrame) -> DataFrame:
    """(g, s, s_kind, time, status): the typed tasks with a status, and the latest change to each."""
    flags = (
        quads.where(F.col("p").isin(RDF_TYPE, STATUS)).groupBy(*_KEY).agg(
            F.max((F.col("p") == RDF_TYPE) & (F.col("o") == TASK_CLASS)).alias("is_task"),
            F.max(F.col("p") == STATUS).alias("has_status"))
        .where("is_task AND has_status").select(*_KEY)
    )
    latest = changes.groupBy(F.col("task").alias("s")).agg(
        F.max(F.struct("time", "status")).alias("new")).select("s", "new.*")
    return flags.where(F.col("s_kind") == IRI).join(latest, "s")


def _new_states(targets: DataFrame) -> DataFrame:
    return insert(targets, F.col("g"), [
        link(F.col("s"), STATUS, F.col("status")),
        text(F.col("s"), MODIFIED, iso(F.col("time")), XSD_DATETIME)])


def update_status(quads: DataFrame, changes: DataFrame) -> DataFrame:
    """The quads after status changes (task, status, time).

    A change applies to every graph in which the task is typed and has a
    status; other changes do nothing. All old values of status and of modified
    go. Of several changes to one task the latest counts. Only status and
    modified quads are shuffled; the rest passes through.
    """
    targets = _status_targets(quads, changes)
    touched = F.col("p").isin(STATUS, MODIFIED)
    kept = quads.where(touched).join(targets.select(*_KEY), _KEY, "left_anti")
    return union_of(quads.where(~touched), kept, _new_states(targets))


def status_changes(quads: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The quads that status changes take out, and those they put in, by the rules of ``update_status``."""
    targets = cut(_status_targets(quads, changes))
    old = quads.where(F.col("p").isin(STATUS, MODIFIED)).join(targets.select(*_KEY), _KEY, "left_semi")
    return old.select(*QUAD), _new_states(targets)


def store_status(spark: SparkSession, path: str, changes: DataFrame) -> int:
    """Apply status changes to a store of buckets; how many buckets were rewritten. A repeat rewrites none."""
    return apply_changes(spark, path, *status_changes(read_buckets(spark, path), changes))


def attach_results(quads: DataFrame, results: DataFrame, run: str, g: str = JOBS_GRAPH) -> DataFrame:
    """Quads that give each task a container of its results.

    Takes (task, result), one row per result; ``as_list`` unfolds arrays. Tasks
    that do not exist in the graph get nothing.
    """
    known = existing(results, quads, TASK_CLASS, "task", g)
    number = key_hash(F.lit(run), "task")
    container = mint(CONTAINER_PREFIX, F.lit(run), "task")
    heads = insert(known.select("task").distinct(), g, [
        link(F.col("task"), RESULTS_CONTAINER, container),
        link(container, RDF_TYPE, CONTAINER_CLASS), text(container, UUID, number)])
    return union_of(heads, insert(known, g, [link(container, CONTENT, F.col("result"))]))


def as_list(value: Column, is_array: bool) -> Column:
    """An array stays as it is; a single value becomes an array of one."""
    return value if is_array else F.array(value)


def link_report(quads: DataFrame, reports: DataFrame, predicate: str, g: str = JOBS_GRAPH) -> DataFrame:
    """A quad from each job of the task to the report, from (task, report)."""
    jobs = values_of(in_graph(quads, g), IS_PART_OF, "job").where(F.col("s_kind") == IRI)
    found = reports.join(jobs.withColumnRenamed("s", "task"), "task")
    return insert(found, g, [link(F.col("job"), predicate, F.col("report"))])


# -- life cycle ------------------------------------------------------------

def latest_status(changes: DataFrame) -> DataFrame:
    """(task, status, ts): the last status by (ts, id). Works on streams too."""
    return changes.groupBy("task").agg(
        F.max_by("status", F.struct("ts", "id")).alias("status"), F.max("ts").alias("ts"))


def status_moves(changes: DataFrame, bucket: str = "hour") -> DataFrame:
    """(task, id, ts, previous, status, legal) for every change.

    The change before is looked up in two steps, so that one very busy task is
    no single group: ``lag`` within (task, time bucket), then for the first
    change of a bucket the last one of the task's bucket before. The second
    step sees one row per task and bucket.
    """
    slotted = changes.withColumn("slot", F.date_trunc(bucket, "ts"))
    lasts = slotted.groupBy("task", "slot").agg(
        F.max_by("status", F.struct("ts", "id")).alias("last"))
    before = lasts.withColumn("carried", F.lag("last").over(
        Window.partitionBy("task").orderBy("slot"))).drop("last")
    inside = slotted.withColumn("near", F.lag("status").over(
        Window.partitionBy("task", "slot").orderBy("ts", "id")))
    known = inside.join(before, ["task", "slot"])
    previous = F.coalesce("near", "carried")
    allowed = F.lit(False)
    for old, new in LEGAL_MOVES:
        allowed = allowed | ((F.col("previous") == old) & (F.col("status") == new))
    start = F.col("previous").isNull() & (F.col("status") == SCHEDULED)
    return (known.withColumn("previous", previous)
            .select("task", "id", "ts", "previous", "status",
                    F.coalesce(start | allowed, F.lit(False)).alias("legal")))


def illegal_moves(changes: DataFrame, bucket: str = "hour") -> DataFrame:
    return status_moves(changes, bucket).where(~F.col("legal")).drop("legal")
