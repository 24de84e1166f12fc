"""A corpus from raw documents to packed sequences.

Toxic documents go, exact copies go, of near copies one stays, the sources are mixed at
their shares, and what is left is packed in the order of the mix. Each stage reads what the one before it kept
from a Parquet table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadlake.llm.exact_dedup import drop_copies
from quadlake.llm.jaccard import drop_near_copies
from quadlake.llm.mixing import ORDER, mix
from quadlake.llm.packing import pack_documents
from quadlake.llm.tables import table
from quadlake.llm.toxicity import drop_toxic
from quadlake.session import checkpoint_folder, tune

# Near copies: five words, a similarity of 0.8.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs, NEAR_WORDS, NEAR_PERCENT)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with their places in its order, which the next stage reads."""
    return mix(docs, most=None).where("__in_mix").select(*docs.columns, *ORDER)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, order=ORDER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

# A trained machine, a tokenizer and a dynamic programme are not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    folder = f"{checkpoint_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
