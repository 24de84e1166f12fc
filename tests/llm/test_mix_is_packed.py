"""The pipeline packs documents in the order that its mixing stage wrote."""

from pyspark.sql import functions as F

import corpus_pipeline
from quadlake.llm import mixing


def test_packing_follows_the_stored_mix(spark, tmp_path):
    docs = spark.range(60).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"),
        F.when(F.col("id") < 40, "a").when(F.col("id") < 55, "b").alias("source"))
    corpus_pipeline.mixing(spark, docs, "").write.parquet(f"{tmp_path}/mix")
    stored = spark.read.parquet(f"{tmp_path}/mix")
    plan = {r.doc_id: (r["__slot"], r["__place"]) for r in mixing.mix(docs, most=None).collect()}
    assert {r.doc_id: (r["__slot"], r["__place"]) for r in stored.collect()} == plan
    assert stored.select(*docs.columns).exceptAll(docs).isEmpty() and docs.exceptAll(stored.select(*docs.columns)).isEmpty()

    def packed(found):
        rows = corpus_pipeline.packing(spark, found, "").collect()
        return [r.doc_id for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]

    assert packed(stored) == sorted(plan, key=plan.get)
    # Another order in the stage's output is another order of the sequences.
    assert packed(stored.withColumn("__slot", -F.col("__slot"))) == sorted(plan, key=lambda d: (-plan[d][0], plan[d][1]))
