"""Quads derived from the star-schema tables.

Each table is read once and unfolded with ``inline``. Nations are a fixed-size
table; the optimizer broadcasts it by its statistics. Primary keys make the
quads distinct, so no de-duplication is needed here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.vocab import (
    BUSY, CONTAINER_CLASS, CONTENT, COVERAGE_JOB, COVERAGE_OPERATION, CREATED, DATA_GRAPH_OF,
    DCAT, DCT, DQV, ENDPOINT_URL, EXT, FAILED, FOAF, HEADERS, INPUT_CONTAINER, IRI, IS_PART_OF,
    JOB_CLASS, JOBS_GRAPH, LANG_STRING, LITERAL, MODIFIED, OPERATION, PUBLIC_GRAPH, RDF_TYPE,
    REQUEST_CLASS, RESULT_CLASS, SCHEDULED, STATUS, SUCCESS, TASK, TASK_CLASS, UUID, VALIDATED,
    VALIDATION_JOB, VALIDATION_OPERATION, XSD_DATETIME, XSD_INTEGER, XSD_STRING,
)

# Columns read of each table. A given schema saves a job per read.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string",
    "documents": "doc_id bigint, lang string, n_chars bigint",
    "labels": "doc_id bigint, quality int",
}

EVENT_STATUS = {"signup": SCHEDULED, "view": BUSY, "purchase": SUCCESS, "error": FAILED}
CLICK = EXT + "clicked"
UNREGISTERED = EXT + "UnregisteredJob"
# Events per change-feed message.
MESSAGE_EVENTS = 16

_STATUS_SQL = "CASE event_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_STATUS.items()) + " END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _time(column: str) -> str:
    return f"""date_format({column}, "yyyy-MM-dd'T'HH:mm:ss")"""


def _quad(s: str, p: str, o: str, kind: str = LITERAL, dt: str = XSD_STRING, lang: str = "''",
          when: str | None = None) -> str:
    """SQL of one quad; s, o, lang and the condition are SQL expressions."""
    o = f"CAST({o} AS STRING)"
    if when:
        o = f"CASE WHEN {when} THEN {o} END"
    dt = dt if kind == LITERAL else ""
    return (f"named_struct('s', {s}, 'p', '{p}', 'o', {o}, 'o_kind', '{kind}', "
            f"'o_dt', '{dt}', 'o_lang', {lang})")


def _unfold(df: DataFrame, g: str, *quads: str, **named: str) -> DataFrame:
    """One row per quad of each record; quads without an object are left out.

    named: SQL of texts that several quads share, worked out once for each record.
    """
    rows = df.selectExpr("*", *[f"{text} AS {name}" for name, text in named.items()]).selectExpr(
        f"{g} AS g", f"inline(array({', '.join(quads)}))")
    return rows.where("o IS NOT NULL").selectExpr(
        "g", "s", f"'{IRI}' AS s_kind", "p", "o", "o_kind", "o_dt", "o_lang")


def catalogue_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogues, datasets, distributions, records and documents."""
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    homes = nation.select("n_nationkey", "n_regionkey")
    datasets = customer.join(homes, F.col("c_nationkey") == F.col("n_nationkey"))
    records = (
        table(spark, sf_dir, "supplier")
        .join(homes, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(customer.select("c_custkey"), F.col("c_custkey") == F.col("s_suppkey"), "left")
    )
    owners = datasets.select(F.col("c_custkey").alias("o_custkey"), "n_regionkey")
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_shipdate").alias("shipped"))
    distributions = table(spark, sf_dir, "orders").join(owners, "o_custkey").join(shipped, "o_orderkey", "left")

    region = "concat('urn:g:region:', n_regionkey)"
    catalog, dataset, dist, record, doc = "catalog", "dataset", "dist", "record", "doc"
    catalog_text = "concat('urn:x:catalog:', n_nationkey)"
    dataset_text = "concat('urn:x:dataset:', c_custkey)"
    doc_text = "concat('urn:x:doc:', doc_id)"
    doc_graph = "concat('urn:g:region:', doc_id % 5)"

    parts = [
        _unfold(
            nation, region,
            _quad(catalog, RDF_TYPE, f"'{DCAT}Catalog'", IRI),
            _quad(catalog, DCT + "title", "n_name"),
            _quad(catalog, DCT + "publisher", "concat('urn:x:agent:', n_regionkey)", IRI),
            _quad(catalog, DCT + "description", "concat('catalog ', n_name)", when="n_nationkey % 3 <> 0"),
            _quad(catalog, FOAF + "homepage", "concat('http://example.org/', n_name)", IRI,
                  when="n_nationkey % 4 = 0"),
            catalog=catalog_text,
        ),
        _unfold(
            datasets, region,
            _quad(catalog, DCAT + "dataset", dataset, IRI),
            _quad(dataset, RDF_TYPE, f"'{DCAT}Dataset'", IRI),
            _quad(dataset, DCT + "title", "c_name"),
            _quad(dataset, DCAT + "keyword", "c_mktsegment"),
            _quad(dataset, DCT + "spatial", "concat('urn:x:place:', c_nationkey)", IRI),
            _quad(dataset, DCT + "description", "concat('about ', c_name)", when="c_acctbal > 0"),
            _quad(dataset, RDF_TYPE, f"'{DCAT}Distribution'", IRI, when="c_custkey % 97 = 0"),
            _quad(dataset, DCAT + "Distribution", "'urn:x:typo'", IRI, when="c_custkey % 50 = 0"),
            catalog=catalog_text, dataset=dataset_text,
        ),
        _unfold(
            distributions, region,
            _quad("concat('urn:x:dataset:', o_custkey)", DCAT + "distribution", dist, IRI),
            _quad(dist, RDF_TYPE, f"'{DCAT}Distribution'", IRI),
            _quad(dist, DCAT + "accessURL", "concat('http://example.org/d/', o_orderkey)", IRI),
            _quad(dist, DCT + "format", "o_orderpriority"),
            _quad(dist, DCT + "rights", "'closed'", when="o_orderstatus = 'F'"),
            _quad(dist, DCT + "license", "concat('urn:x:licence:', o_orderkey % 7)", IRI,
                  when="o_orderstatus = 'O'"),
            _quad(dist, DCT + "issued", _time("o_orderdate"), dt=XSD_DATETIME),
            _quad(dist, DCAT + "byteSize", "CAST(o_totalprice AS BIGINT)", dt=XSD_INTEGER),
            _quad(dist, MODIFIED, _time("shipped"), dt=XSD_DATETIME),
            dist="concat('urn:x:dist:', o_orderkey)",
        ),
        _unfold(
            records, region,
            _quad(catalog_text.replace("n_nationkey", "s_nationkey"), DCAT + "record", record, IRI),
            _quad(record, RDF_TYPE, f"'{DCAT}CatalogRecord'", IRI),
            _quad(record, MODIFIED, "'2024-01-01'", when="s_acctbal > 0"),
            _quad(record, FOAF + "primaryTopic", dataset_text, IRI, when="c_custkey IS NOT NULL"),
            record="concat('urn:x:record:', s_suppkey)",
        ),
        _unfold(
            table(spark, sf_dir, "documents"), doc_graph,
            _quad(doc, RDF_TYPE, f"'{FOAF}Document'", IRI),
            _quad(doc, DCT + "title", "concat('doc ', doc_id)", dt=LANG_STRING, lang="lower(lang)"),
            _quad(doc, DCAT + "byteSize", "n_chars", dt=XSD_INTEGER),
            doc=doc_text,
        ),
        _unfold(
            table(spark, sf_dir, "labels"), doc_graph,
            _quad(doc, DQV + "hasQualityAnnotation", "quality", dt=XSD_INTEGER),
            doc=doc_text,
        ),
    ]
    return union_all(parts)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task, status, ts, id): every status a task was given."""
    return (
        table(spark, sf_dir, "events").where(F.col("event_type").isin(*EVENT_STATUS))
        .selectExpr("concat('urn:x:task:', user_id) AS task", f"{_STATUS_SQL} AS status",
                    "ts", "event_id AS id")
    )


def job_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks, containers and jobs (jobs graph), requests and results (public graph)."""
    events = table(spark, sf_dir, "events").selectExpr("*", f"{_STATUS_SQL} AS status")
    users = events.groupBy("user_id").agg(
        F.min("ts").alias("created"), F.max("ts").alias("modified"),
        F.expr("max_by(status, CASE WHEN status IS NOT NULL THEN struct(ts, event_id) END)").alias("status"),
    )
    operation = (f"CASE user_id % 3 WHEN 0 THEN '{COVERAGE_OPERATION}' "
                 f"WHEN 1 THEN '{VALIDATION_OPERATION}' ELSE '{UNREGISTERED}' END")
    job_operation = f"CASE k % 3 WHEN 0 THEN '{COVERAGE_JOB}' ELSE '{VALIDATION_JOB}' END"
    content = "concat(if(user_id % 2 = 0, 'urn:x:request:', 'urn:x:result:'), user_id % 5)"
    task = "concat('urn:x:task:', user_id)"
    container = "concat('urn:x:container:', user_id)"
    job = "concat('urn:x:job:', k)"
    request = "concat('urn:x:request:', r_regionkey)"
    result = "concat('urn:x:result:', r_regionkey)"
    tasks = _unfold(
        users, f"'{JOBS_GRAPH}'",
        _quad(task, RDF_TYPE, f"'{TASK_CLASS}'", IRI),
        _quad(task, UUID, "concat('task-', user_id)"),
        _quad(task, CREATED, _time("created"), dt=XSD_DATETIME),
        _quad(task, MODIFIED, _time("modified"), dt=XSD_DATETIME),
        _quad(task, STATUS, "status", IRI),
        _quad(task, OPERATION, operation, IRI),
        _quad(task, IS_PART_OF, "concat('urn:x:job:', user_id % 10)", IRI),
        _quad(task, INPUT_CONTAINER, container, IRI),
        _quad(task, TASK + "index", "'0'"),
        _quad(task, HEADERS, """concat('{"user":"', user_id, '"}')""", when="user_id % 4 = 0"),
        _quad(container, RDF_TYPE, f"'{CONTAINER_CLASS}'", IRI),
        _quad(container, UUID, "concat('container-', user_id)"),
        _quad(container, CONTENT, content, IRI),
    )
    jobs = _unfold(
        events.selectExpr("user_id % 10 AS k").distinct(), f"'{JOBS_GRAPH}'",
        _quad(job, RDF_TYPE, f"'{JOB_CLASS}'", IRI),
        _quad(job, UUID, "concat('job-', k)"),
        _quad(job, OPERATION, job_operation, IRI),
        _quad(job, ENDPOINT_URL, "concat('http://example.org/sparql/', k)", when="k % 2 = 0"),
    )
    requests = _unfold(
        table(spark, sf_dir, "region"), f"'{PUBLIC_GRAPH}'",
        _quad(request, RDF_TYPE, f"'{REQUEST_CLASS}'", IRI),
        _quad(request, UUID, "concat('request-', r_regionkey)"),
        _quad(request, DATA_GRAPH_OF, "concat('urn:g:region:', r_regionkey)", IRI),
        _quad(result, RDF_TYPE, f"'{RESULT_CLASS}'", IRI),
        _quad(result, UUID, "concat('result-', r_regionkey)"),
        _quad(result, VALIDATED, request, IRI),
    )
    return union_all([tasks, jobs, requests])


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(message_id, body, sent): change-feed messages, each of a few events in order.

    A message holds at most MESSAGE_EVENTS events, so gathering them is bounded.
    """
    def triple(p: str, o: str) -> str:
        subject = "concat('urn:x:task:', user_id)"
        parts = (("subject", subject), ("predicate", p), ("object", o))
        return "named_struct(%s)" % ", ".join(f"'{k}', named_struct('value', {v})" for k, v in parts)

    inserted = triple(f"if(status IS NULL, '{CLICK}', '{STATUS}')", "coalesce(status, string(event_id))")
    deleted = triple(f"'{STATUS}'", f"'{SCHEDULED}'")
    return (
        table(spark, sf_dir, "events")
        .selectExpr(f"event_id div {MESSAGE_EVENTS} AS message_id", "event_id", "ts", "user_id",
                    f"{_STATUS_SQL} AS status")
        .selectExpr("message_id", "ts", f"struct(event_id, array({inserted}) AS inserts, "
                                        f"array({deleted}) AS deletes) AS change")
        .groupBy("message_id")
        .agg(F.expr("to_json(transform(sort_array(collect_list(change)), "
                    "c -> struct(c.inserts, c.deletes)))").alias("body"),
             F.max("ts").alias("sent"))
    )
