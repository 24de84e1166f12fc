"""A store is written by one shuffle, and the tables it is derived from are read once."""

from conftest import rows
from pyspark.sql import functions as F

from quadlake.quads import QUAD, sorted_once
from quadlake.sources import derived
from quadlake.streaming.standing import StandingCoverage


def test_the_set_takes_no_shuffle_of_its_own(spark):
    some = F.when(F.col("id") % 5 > 0, (F.col("id") % 5).cast("string"))
    found = spark.range(40).select(some.alias("a"), (F.col("id") % 3).alias("b"), F.lit("x").alias("c"))
    once = sorted_once(found, ["b", "a"])
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == plan.count("Exchange") == 1
    assert "HashAggregate" not in plan
    assert rows(once) == rows(found.distinct()) and once.count() == 15


def test_orders_are_read_once(spark):
    quads = derived.catalogue_quads(spark, "/root/testdata/sf0.001")
    plan = quads._jdf.queryExecution().executedPlan().toString()
    assert plan.count("orders.parquet") == 1
    assert quads.columns == QUAD


def test_counts_and_bits_of_a_subject_share_a_shuffle(spark, tmp_path):
    standing = StandingCoverage(spark, str(tmp_path / "standing"))
    counts = spark.range(9).selectExpr("'g' AS g", "cast(id % 3 AS string) AS s", "'iri' AS s_kind", "0 AS word",
                                       "id + 1 AS mark", "1L AS n")
    moves = standing._moves(counts, counts)
    assert moves._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert moves.count() == 3
