"""Exact duplicates by recipes of content-defined chunks.

A text without white space is cut into chunks where its content says so: after the first
character of a boundary class beyond a least length, so equal stretches give equal
chunks. The chunks are deduplicated: a 64-bit hash is the identifier of a chunk if all
chunks of that hash have the same SHA-256, otherwise both together are. A text's recipe is
the ordered list of its chunks' identifiers, and texts are equal when their recipes are.
Only hashes move; the texts stay where they are read.

Null texts count as empty; empty texts are equal to each other. Repeated rows and rows
with a null doc_id count as documents; of equal texts the row with the most code points
stays, then the smallest doc_id (null last), then any one of what are repeated rows.
Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.llm.screen import screened
from quadlake.session import cut

# Code points of a chunk; beyond the least, a chunk ends at a boundary character.
LEAST, MOST = 256, 2048
_CHUNK = rf"(?s).{{{LEAST},{MOST - 1}}}?[bfkvwz\p{{Punct}}\p{{Nd}}\p{{Lu}}]|.{{1,{MOST}}}"


def normalised(text: Column) -> Column:
    """The text without blanks and the control characters 9 to 13."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def with_recipes(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_chars, text_sha256 and recipe of each document."""
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.char_length(F.coalesce("text", F.lit(""))).alias("n_chars"), normalised(F.col("text")).alias("text"))
    chunks = texts.select(
        "row", "doc_id", "n_chars", F.sha2("text", 256).alias("text_sha256"),
        F.posexplode_outer(F.regexp_extract_all("text", F.lit(_CHUNK), F.lit(0))).alias("place", "chunk"))
    hashed = chunks.select("row", "doc_id", "n_chars", "text_sha256", "place", F.xxhash64("chunk").alias("hash"),
                           F.unhex(F.sha2("chunk", 256)).alias("sha"), F.col("chunk").isNotNull().alias("is_chunk"))
    # The store of different chunks, and the hashes that stand for more than one.
    store = hashed.where("is_chunk").select("hash", "sha").distinct()
    doubtful = store.groupBy("hash").count().where("count > 1").select("hash", F.lit(True).alias("doubtful"))
    named = hashed.join(doubtful, "hash", "left").select(
        "row", "doc_id", "n_chars", "text_sha256",
        F.when(F.col("is_chunk"), F.struct("place", "hash", F.when(F.col("doubtful"), F.col("sha")).alias("sha"))).alias("id"))
    return (named.groupBy("row", "doc_id", "n_chars", "text_sha256").agg(F.collect_list("id").alias("ids"))
            .select("row", "doc_id", "n_chars", "text_sha256", F.transform(
                F.array_sort("ids"), lambda x: F.struct(x["hash"].alias("hash"), x["sha"].alias("sha"))).alias("recipe")))


def exact_groups(docs: DataFrame) -> DataFrame:
    """Which row stays for each document, how many are equal to it, and whether it stays."""
    recipes = with_recipes(docs)
    order = F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    classes = (recipes.groupBy("recipe").agg(F.min(order).alias("first"), F.count("*").alias("group_size")))
    return recipes.join(classes, "recipe").select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256", "n_chars")


def drop_copies(docs: DataFrame) -> DataFrame:
    """One document of each group, all columns kept. Only rows that may go are moved.

    Repeated rows of one id are one document. Columns of docs must not start with two underscores.
    """
    key = ["doc_id", "text_sha256", "n_chars"]
    keys = cut(exact_groups(docs).groupBy(*key).agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"))
    doubtful, clear = screened(docs, "doc_id", keys)
    rows = doubtful.withColumns({"__sha": F.sha2(normalised(F.col("text")), 256),
                                 "__chars": F.char_length(F.coalesce("text", F.lit("")))})

    def is_one_of(few: DataFrame) -> Column:
        return rows["doc_id"].eqNullSafe(few["doc_id"]) & (rows["__sha"] == few["text_sha256"]) & (rows["__chars"] == few["n_chars"])

    stays = rows.join(keys, is_one_of(keys), "left_anti")
    # A repeated row that stays, once.
    again = keys.where("kept")
    once = rows.join(again, is_one_of(again), "left_semi").dropDuplicates(["doc_id", "__sha", "__chars"])
    return clear.unionByName(stays.unionByName(once).select(*docs.columns))
