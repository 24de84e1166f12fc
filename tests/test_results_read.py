"""Stored results are read by one shuffle, with the rows that joins of their quads give."""

import time
import uuid

from pyspark.sql import functions as F

from quadlake.functions.terms import packed, unpacked
from quadlake.operators.joins import optional, star, values_of
from quadlake.operators.scan import match
from quadlake.plans import report, validation
from quadlake.quads import SUBJECT, literal
from quadlake.session import cut
from quadlake.vocab import RDF_TYPE, SH

RESULT = SH + "ValidationResult"
MINTED = "urn:x:result:" + "0123456789abcdef" * 4


def _joined(quads):
    found = star(quads, {"severity": SH + "resultSeverity"}, RESULT)
    focus = match(quads, p=SH + "focusNode").select("g", *SUBJECT, F.col("o").alias("focus"), F.col("o_kind").alias("focus_kind"))
    found = optional(found.join(focus, ["g", *SUBJECT]), values_of(quads, SH + "resultPath", "path"))
    found = optional(found, values_of(quads, SH + "sourceShape", "shape"))
    return found.select("g", F.col("s").alias("result_id"), "focus", "focus_kind", "path", "shape", "severity")


def _odd(make):
    rows = []
    for k, s in enumerate([MINTED, MINTED + "0", "urn:r:1", "_:r", MINTED.upper(), MINTED + "\n", "urn:r:none"]):
        for g in ("urn:g:1", "urn:g:2"):
            rows += [(g, s, RDF_TYPE, RESULT), (g, s, SH + "resultSeverity", SH + "Violation"),
                     (g, s, SH + "focusNode", "_:f" if k % 2 else f"urn:f:{k}")]
            rows += [(g, s, SH + "resultPath", f"urn:p:{i}") for i in range(k % 3)]
            rows += [(g, s, SH + "sourceShape", f"urn:s:{i}") for i in range(k % 2)]
    rows += [("urn:g:1", "urn:r:1", SH + "focusNode", literal("a text")), ("urn:g:1", "urn:r:1", SH + "resultSeverity", "urn:other"),
             ("urn:g:3", "urn:r:1", RDF_TYPE, RESULT), ("urn:g:3", "urn:r:1", SH + "focusNode", "urn:f:1"),
             ("urn:g:3", "urn:r:2", SH + "focusNode", "urn:f:1"), ("urn:g:3", "urn:r:2", SH + "resultSeverity", "urn:x"),
             ("urn:g:3", "urn:r:2", RDF_TYPE, literal(RESULT))]
    quads = make(*rows)
    none = F.lit(None).cast("string")
    # Repeated quads count again, and nothing meets a graph that is null.
    return quads.unionByName(quads.where("s = 'urn:r:1' AND g = 'urn:g:1'")).unionByName(quads.limit(9).withColumn("g", none))


def _sorted(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_the_rows_of_joins(make):
    quads = _odd(make)
    found = validation.results_from_quads(quads)
    want = _joined(quads)
    assert found.columns == want.columns
    assert _sorted(found) == _sorted(want) and want.count() > 40


def test_one_shuffle(spark, make):
    quads = cut(_odd(make))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = validation.results_from_quads(quads)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_keys_are_packed_and_read_back(spark):
    texts = [MINTED, MINTED + "0", MINTED.upper(), MINTED + "\n", "x\n" + MINTED, MINTED[-64:], "", "urn:a", "é" * 70, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", packed(F.col("t")).alias("key"))
    got = df.select("t", unpacked(F.col("key")).alias("back"), F.length("key.digits").alias("n")).collect()
    assert [r.back for r in got] == [r.t for r in got] == texts
    assert [r.n for r in got] == [32, 32, None, None, 32, 32, None, None, None, None]


def test_the_stored_roll_up_counts_each_result_once(make):
    quads = _odd(make).unionByName(make(*[("urn:g:1", f"urn:f:{k}", RDF_TYPE, c) for k in range(7) for c in ("urn:A", "urn:B")]))
    read = validation.results_from_quads(quads)
    want = report.focus_classes(read.where("severity IS NOT NULL"), quads, ["urn:A", "urn:B"]).groupBy(
        "g", "class", "path", "shape", "severity").agg(F.count_distinct("result_id").alias("count"))
    assert _sorted(report.rollup(read, quads, ["urn:A", "urn:B"], keyed=False)) == _sorted(want) and want.count()


def test_all_quads_of_a_result_come_from_one_row(spark):
    """Its IRI then is written next to itself; quads of a result without a graph are those they were."""
    values = ("urn:g", MINTED, "urn:s", "urn:f", "iri", "urn:p", "v", "literal", "urn:dt", "en", "urn:c", "urn:sev", "m")
    results = spark.createDataFrame([values, (None, *values[1:]), (*values[:5], None, *[None] * 4, *values[10:])],
                                    validation.RESULT_SCHEMA)
    quads = validation.result_quads(results, F.col("g"))
    assert "Union" not in quads._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.g or "", r.p.removeprefix(SH)) for r in quads.where("o = 'v' OR o = 'urn:f' OR o = 'urn:p'").collect()) == [
        ("", "focusNode"), ("", "value"), ("urn:g", "focusNode"), ("urn:g", "focusNode"), ("urn:g", "resultPath"), ("urn:g", "value")]
    assert quads.count() == 8 + 2 + 6
    assert quads.where("p LIKE '%value'").select("o_kind", "o_dt", "o_lang").distinct().collect() == [("literal", "urn:dt", "en")]


def test_a_table_leaves_no_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles())
                if f.getName().startswith("shuffle_")}

    before = files()
    cut(spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").agg(F.max("id").alias(f"m{uuid.uuid4().hex}")))
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before
