import pytest
from pyspark.sql import functions as F

from quadlake.operators import joins, scan
from quadlake.plans.coverage import coverage
from quadlake.queries import QUERIES, jobs_of, quads_of
from quadlake.vocab import DCAT, RDF_TYPE

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def q(spark):
    jobs_of(spark, SF)
    return quads_of(spark, SF)


def test_scans_are_pruned(q):
    text = plan(scan.pattern(q, "urn:g:region:1", p=RDF_TYPE, o=DCAT + "Dataset"))
    assert "PartitionFilters: [isnotnull(g" in text and "urn:g:region:1" in text
    assert "EqualTo(p," in text and "EqualTo(o," in text
    assert "Exchange" not in text
    counts = plan(scan.graph_size(q))
    assert "ReadSchema: struct<>" in counts


def test_coverage_shuffles_bits_only(q):
    text = plan(coverage(q))
    assert "SortMergeJoin" not in text and "In(p," in text
    assert text.count("FileScan") == 2
    assert "partial_bit_or" in text


@pytest.mark.parametrize("name", ["coverage", "shacl_results", "shacl_rollup", "class_properties", "actionable_tasks",
                                  "uri_reuse", "update_status", "task_illegal_moves", "count_with_property"])
def test_no_cross_joins_and_no_python(spark, q, name):
    text = plan(QUERIES[name](spark, SF))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEval", "SinglePartition"):
        assert word not in text


def test_adaptive_execution_splits_a_hot_subject(spark, make):
    """A third of all facts on one subject: the join splits its partition."""
    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
                "spark.sql.adaptive.coalescePartitions.enabled": "false",
                "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    facts = spark.range(30_000).repartition(8).select(
        F.lit("g").alias("g"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 997)).alias("s"),
        F.lit("iri").alias("s_kind"), F.when(F.col("id") < 999, RDF_TYPE).otherwise("p").alias("p"),
        F.when(F.col("id") < 999, "C").otherwise(F.col("id").cast("string")).alias("o"),
        F.lit("iri").alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang")).distinct()
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = joins.class_properties(facts, ["C"], ["p"])
        n = joined.count()
        done = joined.groupBy("g", "s").count()
        done.collect()
        assert "skew=true" in plan(done)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    typed = facts.where(F.col("p") == RDF_TYPE).select("s").distinct()
    assert n == facts.where("p = 'p'").join(typed, "s", "left_semi").count()
