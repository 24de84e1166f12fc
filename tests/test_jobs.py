import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from quadlake.operators import joins, records
from quadlake.plans import jobs
from quadlake.quads import literal
from quadlake.vocab import (
    BUSY, CONTENT, COVERAGE_OPERATION, CREATED, DATA_GRAPH_OF, ENDPOINT_URL, FAILED, INPUT_CONTAINER, IS_PART_OF,
    JOB_CLASS, JOBS_GRAPH, LEGAL_MOVES, MODIFIED, OPERATION, RDF_TYPE, REQUEST_CLASS, RESULT_CLASS, SCHEDULED,
    STATUS, SUCCESS, TASK_CLASS, UUID, VALIDATED, XSD_DATETIME,
)

G = JOBS_GRAPH


def task(name, created=("2024-01-02T00:00:00",), status=(SCHEDULED,), operation=COVERAGE_OPERATION, g=G):
    return [(g, name, RDF_TYPE, TASK_CLASS), (g, name, UUID, literal(name)), (g, name, OPERATION, operation),
            *[(g, name, CREATED, literal(c, XSD_DATETIME)) for c in created],
            *[(g, name, MODIFIED, literal(c, XSD_DATETIME)) for c in created],
            *[(g, name, STATUS, s) for s in status]]


def test_actionable_keeps_multiplicity_and_optionals(make):
    q = make(*task("t1", ("2024-01-02T00:00:00", "2024-01-03T00:00:00")), *task("t2", ("2024-01-01T00:00:00",)),
             *task("t3", operation="other"), *task("t4", status=(BUSY,)), *task("t5", status=()),
             (G, "t2", INPUT_CONTAINER, "c"), (G, "c", CONTENT, "in"), (G, "t2", IS_PART_OF, "j"), (G, "j", OPERATION, "jop"))
    got = rows(jobs.actionable_tasks(q, [COVERAGE_OPERATION]), "uri", "created", "input", "job_operation", "headers")
    assert got == [("t1", "2024-01-02T00:00:00", None, None, None), ("t1", "2024-01-03T00:00:00", None, None, None),
                   ("t2", "2024-01-01T00:00:00", "in", "jop", None)]
    assert jobs.next_task(q, [COVERAGE_OPERATION]).first().uri == "t2"
    assert jobs.next_task(q, ["none"]).first() is None


def test_patterns_stay_in_one_graph(make):
    q = make((G, "t", IS_PART_OF, "j"), ("g2", "j", ENDPOINT_URL, literal("u")), (G, "t", INPUT_CONTAINER, literal("c")),
             (G, "c", CONTENT, "in"))
    assert jobs.task_endpoints(q).count() == 0
    assert joins.sequence(q, INPUT_CONTAINER, CONTENT).count() == 0


def test_task_job_needs_both_types(make):
    q = make(*task("t"), (G, "t", IS_PART_OF, "j"), (G, "t", IS_PART_OF, "k"), (G, "j", RDF_TYPE, JOB_CLASS))
    assert rows(jobs.task_jobs(q)) == [(G, "t", "j")]


def test_data_graph_of_requests_and_results(make):
    q = make(("d", "r", RDF_TYPE, REQUEST_CLASS), ("d", "r", DATA_GRAPH_OF, "x"), ("d", "v", RDF_TYPE, RESULT_CLASS),
             ("d", "v", VALIDATED, "r"), ("d", "n", DATA_GRAPH_OF, "y"))
    assert rows(jobs.data_graphs(q)) == [("d", "r", "x"), ("d", "v", "x")]


def test_update_status(make, spark):
    q = make(*task("t1", status=(SCHEDULED, BUSY)), *task("t2"), *task("t3", status=()), ("g2", "t1", STATUS, SCHEDULED),
             (G, "x", STATUS, SCHEDULED))
    at = dt.datetime(2024, 5, 1)
    changes = spark.createDataFrame(
        [("t1", BUSY, at), ("t1", FAILED, at + dt.timedelta(hours=1)), ("t3", BUSY, at), ("x", BUSY, at), ("none", BUSY, at)],
        "task string, status string, time timestamp")
    got = jobs.update_status(q, changes)
    assert rows(got.where(F.col("p") == STATUS), "g", "s", "o") == sorted(
        [(G, "t1", FAILED), (G, "t2", SCHEDULED), ("g2", "t1", SCHEDULED), (G, "x", SCHEDULED)], key=repr)
    assert rows(got.where((F.col("p") == MODIFIED) & (F.col("s") == "t1")), "o") == [("2024-05-01T01:00:00",)]
    again = jobs.update_status(got, changes)
    assert rows(again) == rows(got)


def brute_moves(changes):
    last, out = {}, []
    for task_, status, ts, n in sorted(changes, key=lambda c: (c[0], c[2], c[3])):
        before = last.get(task_)
        legal = (before, status) in LEGAL_MOVES or (before is None and status == SCHEDULED)
        out.append((task_, n, before, status, legal))
        last[task_] = status
    return sorted(out, key=repr)


def test_moves_do_not_depend_on_the_bucket(spark):
    names = [SCHEDULED, BUSY, SUCCESS, FAILED]
    start = dt.datetime(2024, 1, 1)
    data = [(f"t{0 if i % 3 else i % 5}", names[(i * 7 + i // 4) % 4], start + dt.timedelta(minutes=(i * 37) % 900), i)
            for i in range(300)]
    df = spark.createDataFrame(data, "task string, status string, ts timestamp, id bigint")
    for bucket in ("minute", "hour", "year"):
        got = rows(jobs.status_moves(df, bucket), "task", "id", "previous", "status", "legal")
        assert got == brute_moves(data)
    latest = dict(rows(jobs.latest_status(df), "task", "status"))
    assert latest == {t: max((x for x in data if x[0] == t), key=lambda x: (x[2], x[3]))[1] for t in latest}


def test_attach_and_link(make, spark):
    q = make(*task("t"), (G, "t", IS_PART_OF, "j"), (G, "t", IS_PART_OF, "k"))
    results = spark.createDataFrame([("t", "r1"), ("t", "r2"), ("none", "r3")], "task string, result string")
    got = jobs.attach_results(q, results, "run")
    assert got.count() == 5 and rows(got.where(F.col("p") == CONTENT), "o") == [("r1",), ("r2",)]
    linked = jobs.link_report(q, results.withColumnRenamed("result", "report"), "pred")
    assert rows(linked, "s", "o") == [("j", "r1"), ("j", "r2"), ("k", "r1"), ("k", "r2")]


def test_template_skips_unbound(spark):
    df = spark.createDataFrame([("a", None, "x"), ("b", "y", "z")], "s string, o string, n string")
    got = records.insert(df, "g", [records.link(F.col("s"), "p", F.col("o")), records.text(F.col("s"), "q", F.col("n"))])
    assert rows(got, "s", "p", "o") == [("a", "q", "x"), ("b", "p", "y"), ("b", "q", "z")]


def test_records_defaults_and_overrides(make):
    q = make(("g", "a", "p", literal("2")), ("g", "a", "p", literal("1")), ("g", "b", "q", literal("x")))
    got = records.records(q, {"x": "p", "y": "q"}, {"y": "none", "z": "zz"}, {"w": F.lit("w")})
    assert rows(got, "uri", "x", "y", "z", "w") == [("a", "1", "none", "zz", "w"), ("b", None, "x", "zz", "w")]


def test_new_tasks_can_be_read_back(spark):
    new = spark.createDataFrame(
        [("1", "in", COVERAGE_OPERATION, "jop", {"h": "v"}, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)),
         ("2", "in", COVERAGE_OPERATION, "jop", None, dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 3))],
        "id string, input string, operation string, job_operation string, headers map<string,string>, "
        "created timestamp, modified timestamp")
    q = jobs.task_quads(new)
    first, second = jobs.tasks(q).orderBy("id").collect()
    assert (first.input, first.job_operation, first.headers, first["index"]) == ("in", "jop", {"h": "v"}, "0")
    assert first.created == dt.datetime(2024, 1, 1) and second.headers is None
    assert jobs.actionable_tasks(q, [COVERAGE_OPERATION]).count() == 2
    assert jobs.task_jobs(q).count() == 2


def test_times_keep_fractions(spark):
    texts = ["2024-05-01T01:00:00", "2024-05-01T01:00:10.5", "2024-05-01T01:00:00.000001", "2024-05-01T10:20:30.12"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(jobs.iso(F.col("t").cast("timestamp")))
    assert [r[0] for r in got.collect()] == texts
