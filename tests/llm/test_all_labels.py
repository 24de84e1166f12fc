"""Operator 10 learns from all labelled documents."""

import math

from pyspark.sql import functions as F

from quadlake.llm import quality


def test_no_label_is_left_out(spark):
    n = 100_300
    labels = spark.range(2 * n).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    marks = quality.marks_of(labels)
    assert {r.quality: r["count"] for r in marks.groupBy("quality").count().collect()} == {0: n, 1: n}


def test_trusted_counts_are_over_every_good_label(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (1, "aa bb"), (2, "cc dd"), (3, "ee"), (None, "ff"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (4, 1), (None, 1), (9, 1)], "doc_id long, quality int")
    good, raw = quality._counts(docs, quality.marks_of(labels))
    assert (int(good.sum()), int(raw.sum())) == (6, 11)


def test_ranks_are_exact(spark):
    values = [float((k * 37) % 101) for k in range(1000)]
    rates = spark.createDataFrame([(v,) for v in values], "rate double")
    for share in (0.0, 0.002, 0.1, 0.5, 0.998, 1.0):
        assert quality._ranked(rates, share) == sorted(values)[max(math.ceil(1000 * share), 1) - 1]
        assert quality._ranked(rates, share) == rates.agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY rate)")).first()[0]
    assert quality._ranked(rates.where("false"), 0.5) is None
