"""The registered queries: each operator over the quads of the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.functions.terms import mint
from quadlake.operators import checks, counts, joins, records, scan
from quadlake.plans import coverage as cov
from quadlake.plans import jobs as job
from quadlake.plans import paths, report, shape_graph, validation
from quadlake.quads import OBJECT, QUAD, literal
from quadlake.session import checkpoint_folder, cut, remove, tune, tune_quads
from quadlake.sources import buckets, derived, nquads, sample_shapes, store
from quadlake.spec import CLASSES, RULES, TYPOS
from quadlake.streaming import change_feed, drain
from quadlake.streaming.standing import StandingCoverage
from quadlake.vocab import (
    BUSY, CONTENT, COVERAGE_JOB, COVERAGE_OPERATION, COVERAGE_REPORT, CREATED, DCAT, DCT,
    FAILED, FOAF, HEADERS, INPUT_CONTAINER, IRI, OPERATION, PUBLIC_GRAPH, RDF_TYPE, REQUEST_PREFIX,
    RESULT_GRAPH_PREFIX, STATUS, SUMMARY_PREFIX, TASK_CLASS, UUID, VALIDATION_OPERATION,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

REGION = "urn:g:region:1"
OPERATIONS = [COVERAGE_OPERATION, VALIDATION_OPERATION]
RUN = "run-1"
SHAPES_GRAPH = "urn:g:shapes"
PROPERTIES = sorted({r.property for r in RULES})
# A moment after all events, for status changes.
NOW = "2024-02-01 00:00:00"


_STORES: dict[tuple[str, str, str], str] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, build: Query) -> DataFrame:
    """The derived quads as a stored table, written once per application.

    The operators are meant for stored quads: a filter on the graph prunes
    folders, one on the predicate row groups, and each use is one scan.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORES:
        path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4()}"
        store.create_store(build(spark, sf_dir), path)
        _STORES[key] = path
    return store.read_store(spark, _STORES[key])


def quads_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(tune_quads(spark), sf_dir, "catalogue", derived.catalogue_quads)


def jobs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(tune_quads(spark), sf_dir, "jobs", derived.job_quads)


def catalogue(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Register a query over the catalogue quads under its function name."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(quads_of(spark, sf_dir))
    return f


def over_jobs(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Register a query over the job quads."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(jobs_of(spark, sf_dir))
    return f


def tables(f: Query) -> Query:
    """Register a query that takes the session and the folder."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(tune(spark), sf_dir)
    return f


# -- scans -----------------------------------------------------------------

@catalogue
def scan_graph(q):
    return scan.in_graph(q, REGION).drop("g")


@catalogue
def scan_any_graph(q):
    return scan.match(q, p=RDF_TYPE)


@catalogue
def pattern_s__(q):
    return scan.pattern(q, REGION, s="urn:x:catalog:1")


@catalogue
def pattern__p_(q):
    return scan.pattern(q, REGION, p=DCT + "title")


@catalogue
def pattern___o(q):
    return scan.pattern(q, REGION, o=DCAT + "Distribution")


@catalogue
def pattern_sp_(q):
    return scan.pattern(q, REGION, s="urn:x:catalog:1", p=DCAT + "dataset")


@catalogue
def pattern_s_o(q):
    return scan.pattern(q, REGION, s="urn:x:catalog:1", o=literal("NATION_1"))


@catalogue
def pattern__po(q):
    return scan.pattern(q, p=RDF_TYPE, o=DCAT + "Distribution")


@catalogue
def pattern_all(q):
    return scan.pattern(q, REGION)


@catalogue
def ask_spo(q):
    return scan.ask(q, "urn:x:catalog:1", RDF_TYPE, DCAT + "Catalog", REGION)


@catalogue
def scan_default(q):
    return scan.default_graph(q)


@catalogue
def graph_size(q):
    return scan.graph_size(q)


@catalogue
def default_size(q):
    return scan.default_size(q)


@catalogue
def scan_ordered(q):
    return scan.pattern(q, p=DCT + "title", order_by="s")


@catalogue
def scan_page(q):
    return scan.pattern(q, REGION, p=DCT + "title", limit=50, offset=100)


@catalogue
def scan_after(q):
    last = {"s": "urn:x:dataset:5", "s_kind": IRI, "o": "", "o_kind": "", "o_dt": "", "o_lang": ""}
    return scan.after(scan.pattern(q, REGION, p=DCT + "title"), "s", last, 50)


@catalogue
def scan_offset(q):
    order = scan.term_order(q.select("s", "s_kind", "p", *OBJECT), "s")
    return scan.page(q.drop("g"), order, offset=1000)


@catalogue
def ingest_nquads(q):
    return nquads.parse_lines(nquads.format_lines(q))


@tables
def ingest_rejects(spark, sf_dir):
    lines = spark.read.schema("text string").parquet(f"{sf_dir}/documents.parquet").select(
        F.explode(F.split("text", "\n")).alias("line"))
    good = nquads.format_lines(quads_of(spark, sf_dir))
    return nquads.rejected_lines(joins.union_of(good, lines)).groupBy("line").agg(
        F.count(F.lit(1)).alias("times"))


@catalogue
def format_nquads(q):
    return nquads.format_lines(q)


@catalogue
def store_graph(q):
    """What an append of all graphs under the name of one would add to the store."""
    return store.new_quads(q, q.withColumn("g", F.lit(REGION)).select(*QUAD))


@catalogue
def bucket_store(q):
    """All graphs written to buckets, with copies of all under one name added, and that graph read back."""
    spark = q.sparkSession
    path = f"{checkpoint_folder(spark)}/buckets-{uuid.uuid4()}"
    buckets.create_buckets(q, path)
    buckets.apply_changes(spark, path, q.where(F.lit(False)), q.withColumn("g", F.lit(REGION)))
    return buckets.read_buckets(spark, path, [REGION])


@catalogue
def batch_ids(q):
    return store.batch_ids(q, 100).select("g", "s", "p", "o", "batch", "complete")


@over_jobs
def record_from_quads(j):
    fields = {"id": UUID, "created": CREATED, "status": STATUS, "headers": HEADERS, "index": UUID}
    found = records.records(j, fields, {"headers": "{}", "status": "none"}, {"source": F.lit("quads")})
    return found.drop("index")


@tables
def record_to_quads(spark, sf_dir):
    s = F.concat(F.lit("urn:x:part:"), F.col("c_custkey").cast("string"))
    rich = F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))
    return records.insert(derived.table(spark, sf_dir, "customer"), "urn:g:parts", [
        records.link(s, RDF_TYPE, FOAF + "Agent"), records.text(s, FOAF + "name", F.col("c_name")),
        records.text(s, DCT + "subject", rich)])


# -- filters and joins -----------------------------------------------------

@catalogue
def entities_of_class(q):
    return scan.match(q, p=RDF_TYPE, o=DCAT + "Dataset").select("g", "s")


@catalogue
def values_filter(q):
    return scan.with_values(q, "p", [DCT + "title", DCT + "format", DCAT + "Distribution"]).select("g", "s", "p", "o")


@over_jobs
def scheduled_tasks(j):
    return job.scheduled_tasks(j)


@catalogue
def class_properties(q):
    return joins.class_properties(q, CLASSES).select("g", "s", "class", "p", "o")


@over_jobs
def task_star(j):
    return job.task_star(j).drop("s_kind")


@over_jobs
def tasks(j):
    found = job.tasks(j)
    return found.withColumn("user", found["headers"]["user"]).withColumn(
        "created", job.iso(F.col("created"))).withColumn("modified", job.iso(F.col("modified"))).drop("headers")


@over_jobs
def task_endpoint(j):
    return job.task_endpoints(j)


@over_jobs
def task_job(j):
    return job.task_jobs(j)


@catalogue
def path_sequence(q):
    return joins.sequence(q, DCAT + "dataset", DCAT + "distribution").select("g", "s", "o")


@over_jobs
def optional_pattern(j):
    typed = joins.values_of(j, RDF_TYPE, "class").where(F.col("class") == TASK_CLASS)
    return joins.optional(typed, joins.values_of(j, HEADERS, "headers")).select("g", "s", "headers")


@tables
def focus_class(spark, sf_dir):
    q = quads_of(spark, sf_dir)
    results = validation.validate(q, [sample_shapes.LESS_THAN, sample_shapes.MIN_SIZE])
    return report.focus_classes(results, q).select("g", "result_id", "focus", "class")


@catalogue
def severity_lookup(q):
    return cov.coverage(q).groupBy("severity").agg(F.sum("violation_count").alias("violations"))


@over_jobs
def actionable_tasks(j):
    return job.actionable_tasks(j, OPERATIONS)


@over_jobs
def next_task(j):
    return job.next_task(j, OPERATIONS)


@over_jobs
def data_graph_of_input(j):
    return job.data_graphs(j)


@over_jobs
def validation_requests(j):
    return job.requests(j)


# -- counts and checks -----------------------------------------------------

@catalogue
def count_entities(q):
    return counts.count_entities(q, CLASSES)


@catalogue
def count_with_property(q):
    return counts.count_with_property(q, CLASSES, PROPERTIES)


@catalogue
def coverage(q):
    return cov.coverage(q)


@catalogue
def coverage_total(q):
    return cov.coverage_total(cov.coverage(q))


@catalogue
def coverage_nested(q):
    nested = cov.coverage_nested(cov.coverage(q))
    return nested.select("g", "total_violations", F.to_json("class_coverages").alias("class_coverages"))


@catalogue
def uri_reuse(q):
    return checks.uri_reuse(q).withColumn("types", F.array_join("types", ","))


@catalogue
def group_concat_types(q):
    return checks.type_lists(q)


@catalogue
def capitalization_typos(q):
    return checks.capitalization_typos(q, TYPOS)


@catalogue
def skolemize(q):
    blank = F.col("s").startswith("urn:x:record:")
    marked = q.withColumn("s_kind", F.when(blank, "bnode").otherwise(F.col("s_kind"))).withColumn(
        "o_kind", F.when(F.col("o").startswith("urn:x:record:"), "bnode").otherwise(F.col("o_kind")))
    return scan.skolemize(marked)


@over_jobs
def undef_fill(j):
    found = joins.optional(joins.values_of(j, UUID, "id"), joins.values_of(j, HEADERS, "headers"))
    return scan.fill_unbound(found.select("g", "s", "headers"), "headers")


# -- writing ---------------------------------------------------------------

@catalogue
def coverage_summary_quads(q):
    endpoints = q.select("g").distinct().select("g", F.when(
        F.col("g").endswith("0"), "http://example.org/sparql/0").alias("url"))
    return report.coverage_summary(cov.coverage(q), RUN, endpoints)


def _base(q: DataFrame) -> DataFrame:
    return validation.validate(q, sample_shapes.BASE)


@catalogue
def shacl_summary_quads(q):
    return report.validation_summary(report.rollup(_base(q), q), q, RUN)


@tables
def validation_record(spark, sf_dir):
    """One result record per task with a validation operation."""
    q, j = quads_of(spark, sf_dir), jobs_of(spark, sf_dir)
    checked = validation.conforms(q, validation.validate(q, [sample_shapes.OWNER]))
    runs = (
        drain.due_tasks(j, [VALIDATION_OPERATION])
        .join(checked.withColumnRenamed("g", "data_graph"), "data_graph")
        .join(job.task_jobs(j).select("task", "job"), "task", "left")
        .select(F.sha2("task", 256).alias("id"), "input", "job", F.col("conforms").alias("success"),
                F.concat(F.lit(RESULT_GRAPH_PREFIX), F.sha2("data_graph", 256)).alias("result_graph"),
                F.concat(F.lit("Results: "), F.col("results").cast("string")).alias("result_text")))
    return job.record_quads(runs)


@over_jobs
def request_quads(j):
    wanted = job.requests(j).select(F.sha2("input", 256).alias("id"), "data_graph")
    return job.request_quads(wanted)


@tables
def task_insert_quads(spark, sf_dir):
    """A new task per customer of the catalogue."""
    new = derived.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.concat(F.lit("urn:x:request:"), (F.col("c_custkey") % 5).cast("string")).alias("input"),
        F.lit(COVERAGE_OPERATION).alias("operation"), F.lit(COVERAGE_JOB).alias("job_operation"),
        F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("segment"), F.col("c_mktsegment"))).alias("headers"),
        F.to_timestamp(F.lit(NOW)).alias("created"), F.to_timestamp(F.lit(NOW)).alias("modified"))
    return job.task_quads(new)


def _results(j: DataFrame) -> DataFrame:
    """Two results for every registered task, and some for tasks that do not exist."""
    uri = F.col("s")
    found = joins.values_of(j, OPERATION, "operation").where(F.col("operation").isin(*OPERATIONS)).select("s")
    pair = F.array(F.concat(F.lit("urn:x:report:a:"), uri), F.concat(F.lit("urn:x:report:b:"), uri))
    ghost = found.select(F.concat(uri, F.lit(":gone")).alias("task"), F.lit("urn:x:report:none").alias("result"))
    return found.select(uri.alias("task"), F.explode(job.as_list(pair, True)).alias("result")).unionByName(ghost)


def _status_changes(j):
    time = F.to_timestamp(F.lit(NOW))
    changes = job.scheduled_tasks(j).select("task", F.lit(BUSY).alias("status"), time.alias("time"))
    ghost = changes.withColumn("task", F.concat("task", F.lit(":gone")))
    later = joins.values_of(j, OPERATION, "operation").where(F.col("operation") == COVERAGE_OPERATION).select(
        F.col("s").alias("task"), F.lit(FAILED).alias("status"), (time + F.expr("INTERVAL 1 HOUR")).alias("time"))
    return joins.union_of(changes, ghost, later)


@over_jobs
def update_status(j):
    return job.update_status(j, _status_changes(j))


@over_jobs
def stored_status(j):
    """The same changes applied to a store of buckets, read back."""
    spark = j.sparkSession
    path = f"{checkpoint_folder(spark)}/status-{uuid.uuid4()}"
    buckets.create_buckets(j, path)
    job.store_status(spark, path, _status_changes(j))
    return buckets.read_buckets(spark, path)


@over_jobs
def attach_results(j):
    return job.attach_results(j, _results(j), RUN)


@over_jobs
def link_report(j):
    reports = _results(j).select("task", mint(SUMMARY_PREFIX, "result").alias("report"))
    return job.link_report(j, reports, COVERAGE_REPORT)


@over_jobs
def template_insert(j):
    """Each task copied to the public graph with the parts it has."""
    found = joins.optional(joins.values_of(j, STATUS, "status"), joins.values_of(j, HEADERS, "headers"))
    found = joins.optional(found, joins.path_value(j, "input", INPUT_CONTAINER, CONTENT))
    s = F.col("s")
    return records.insert(found, PUBLIC_GRAPH, [
        records.link(s, STATUS, F.col("status")), records.text(s, HEADERS, F.col("headers")),
        records.link(s, CONTENT, F.col("input"))])


# -- change feed -----------------------------------------------------------

@tables
def delta_inserts(spark, sf_dir):
    return change_feed.inserted(derived.messages(spark, sf_dir))


@tables
def delta_has_task(spark, sf_dir):
    return change_feed.decided(derived.messages(spark, sf_dir)).select("message_id", "accepted")


@tables
def delta_coverage(spark, sf_dir):
    return drain.coverage_of_scheduled(
        change_feed.accepted(derived.messages(spark, sf_dir)),
        jobs_of(spark, sf_dir), quads_of(spark, sf_dir))


@tables
def task_latest_status(spark, sf_dir):
    return job.latest_status(derived.status_changes(spark, sf_dir)).select("task", "status")


@tables
def task_illegal_moves(spark, sf_dir):
    return job.illegal_moves(derived.status_changes(spark, sf_dir)).select("task", "id", "previous", "status")


@tables
def task_illegal_stream(spark, sf_dir):
    """The same from the running stream, started twice; its second lot repeats changes of the first."""
    root = f"{checkpoint_folder(spark)}/changes-{uuid.uuid4()}"
    changes = derived.status_changes(spark, sf_dir)
    middle = changes.agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2").alias("ts")).first().ts
    for lot in (F.col("ts") < F.lit(middle), F.col("ts") >= F.lit(middle) - F.expr("INTERVAL 30 MINUTES")):
        changes.where(lot).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(drain.CHANGE_SCHEMA).parquet(f"{root}/in")
        drain.run_states(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return drain.illegal_so_far(spark, f"{root}/out").select("task", "id", "previous", "status")


@catalogue
def coverage_standing(q):
    """Coverage kept from three batches: titles come later, licences go again."""
    standing = StandingCoverage(q.sparkSession, f"{checkpoint_folder(q.sparkSession)}/standing-{uuid.uuid4()}", every=2)
    standing.change(0, q.where(F.col("p") != DCT + "title"))
    standing.change(1, q.where(F.col("p") == DCT + "title"))
    standing.change(2, q.where("false"), q.where(F.col("p") == DCT + "license"))
    return standing.coverage()


# -- validation ------------------------------------------------------------

@catalogue
def shacl_targets(q):
    return validation.targets(q, sample_shapes.FAMILIES["targets"])


@catalogue
def shacl_paths(q):
    return validation.path_values(q, sample_shapes.FAMILIES["paths"])


@catalogue
def path_closure(q):
    return validation.path_values(q, sample_shapes.FAMILIES["closure"])


def _shown(results: DataFrame) -> DataFrame:
    return results.select("g", "result_id", "shape", "focus", "path", "value", "component", "severity")


def _family(name: str) -> None:
    QUERIES[f"shacl_{name}"] = lambda spark, sf_dir: _shown(validation.validate(
        quads_of(spark, sf_dir), sample_shapes.FAMILIES[name]))


for _name in ("count", "class", "datatype", "nodekind", "range", "string", "lang", "pair", "less_than",
              "logic", "node", "qualified", "closed", "hasvalue", "in", "sql", "record"):
    _family(_name)


@catalogue
def shacl_conforms(q):
    return validation.conforms(q, validation.validate(q, [sample_shapes.OWNER]))


@catalogue
def shacl_results(q):
    return _base(q)


@catalogue
def shacl_result_quads(q):
    graph = F.concat(F.lit(RESULT_GRAPH_PREFIX), F.sha2("g", 256))
    return validation.result_quads(_base(q), graph)


@catalogue
def shacl_report_quads(q):
    graph = F.concat(F.lit(RESULT_GRAPH_PREFIX), F.sha2("g", 256))
    results = cut(_base(q))
    return validation.report_quads(results, validation.conforms(q, results), graph)


@catalogue
def shacl_reports_read(q):
    """Report nodes written as quads of result graphs and read back; a graph of one clean shape has one too."""
    graph = F.concat(F.lit(RESULT_GRAPH_PREFIX), F.sha2("g", 256))
    results = cut(validation.validate(q, [sample_shapes.OWNER]))
    stored = cut(validation.report_quads(results, validation.conforms(q, results), graph))
    return validation.reports_from_quads(stored).drop("report")


@catalogue
def shacl_results_read(q):
    """Results written as quads of result graphs and read back."""
    graph = F.concat(F.lit(RESULT_GRAPH_PREFIX), F.sha2("g", 256))
    return validation.results_from_quads(cut(validation.result_quads(_base(q), graph), packed=True))


@catalogue
def shacl_result_paths(q):
    """Results along paths of several steps, stored with the structure of the paths, and their texts read back."""
    graph = F.concat(F.lit(RESULT_GRAPH_PREFIX), F.sha2("g", 256))
    # The results themselves go when their quads are stored.
    folder = f"{checkpoint_folder(q.sparkSession)}/results-{uuid.uuid4()}"
    results = cut(validation.validate(q, sample_shapes.ALONG), folder, packed=True)
    stored = cut(joins.union_of(validation.result_quads(results, graph), paths.result_path_quads(results, graph)), packed=True)
    remove(q.sparkSession, folder)
    return paths.with_path_texts(validation.results_from_quads(stored), stored)


@catalogue
def shacl_shapes_graph(q):
    """Validation against shapes read from the lines of a shapes graph."""
    shapes = sample_shapes.BASE + sample_shapes.ALONG + sample_shapes.FAMILIES["logic"]
    lines = nquads.format_lines(shape_graph.shape_quads(q.sparkSession, shapes, SHAPES_GRAPH))
    return _shown(validation.validate(q, shape_graph.shapes_from_quads(nquads.parse_lines(lines))))


@catalogue
def shacl_rollup(q):
    return report.rollup(_base(q), q)


@catalogue
def shacl_rollup_stored(q):
    """The roll-up of result graphs that were stored with the records of their runs."""
    results = _base(q)
    graph = F.concat(F.lit(RESULT_GRAPH_PREFIX), F.sha2("g", 256))
    runs = q.select("g").distinct().select(
        F.col("g").alias("data_graph"), F.sha2("g", 256).alias("id"), graph.alias("result_graph"),
        F.concat(F.lit(REQUEST_PREFIX), F.sha2("g", 256)).alias("input"), F.lit(None).cast("string").alias("job"),
        F.lit(True).alias("success"), F.lit("").alias("result_text"))
    # The quads go when they are read.
    folder = f"{checkpoint_folder(q.sparkSession)}/results-{uuid.uuid4()}"
    stored = cut(joins.union_of(validation.result_quads(results, graph), job.request_quads(runs), job.record_quads(runs)),
                 folder, packed=True)
    read = cut(report.of_data_graphs(validation.results_from_quads(stored), job.result_graphs(stored)), packed=True)
    remove(q.sparkSession, folder)
    return report.rollup(read, q, keyed=False)


@catalogue
def shacl_rollup_nested(q):
    nested = report.rollup_nested(report.rollup(_base(q), q))
    return nested.select("g", "class", F.to_json("rows").alias("rows"))


@catalogue
def shacl_total(q):
    return report.rollup_total(report.rollup(_base(q), q))


@catalogue
def shacl_distinct(q):
    return report.distinct_results(_base(q), q)


@catalogue
def shacl_text(q):
    results = cut(_base(q))
    return report.report_text(results, validation.conforms(q, results))


@catalogue
def shacl_report_lines(q):
    return report.report_lines(_base(q))
