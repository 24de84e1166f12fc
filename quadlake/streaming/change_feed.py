"""Change-feed messages to inserted triples and to a decision per message.

A message is a JSON array of change sets, each with inserts and deletes. The
functions take batch and streaming frames alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.vocab import SCHEDULED, STATUS

_TERM = "struct<value: string>"
_TRIPLE = f"struct<subject: {_TERM}, predicate: {_TERM}, object: {_TERM}>"
MESSAGE = f"array<struct<inserts: array<{_TRIPLE}>>>"


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """A stream of messages, one per file: (message_id, body, sent)."""
    return (
        spark.readStream.schema("value string").option("wholetext", "true").format("text").load(path)
        .select(F.col("_metadata.file_path").alias("message_id"), F.col("value").alias("body"),
                F.col("_metadata.file_modification_time").alias("sent"))
    )


def _inserts():
    changes = F.from_json("body", MESSAGE)
    lists = F.transform(changes, lambda c: F.coalesce(c["inserts"], F.array().cast(f"array<{_TRIPLE}>")))
    return F.flatten(lists)


def inserted(messages: DataFrame) -> DataFrame:
    """(message_id, s, p, o): the inserts of all change sets; deletes are passed over."""
    rows = messages.select("message_id", F.explode(_inserts()).alias("t"))
    return rows.select("message_id", F.col("t.subject.value").alias("s"),
                       F.col("t.predicate.value").alias("p"), F.col("t.object.value").alias("o"))


def decided(messages: DataFrame) -> DataFrame:
    """messages with accepted: does any insert schedule a task."""
    hit = F.exists(_inserts(), lambda t: F.coalesce(
        (t["predicate"]["value"] == STATUS) & (t["object"]["value"] == SCHEDULED), F.lit(False)))
    return messages.withColumn("accepted", F.coalesce(hit, F.lit(False)))


def accepted(messages: DataFrame) -> DataFrame:
    return decided(messages).where("accepted").drop("accepted")


def refused(messages: DataFrame) -> DataFrame:
    return decided(messages).where("NOT accepted").drop("accepted")


def scheduled(messages: DataFrame) -> DataFrame:
    """(task): tasks that any insert of the messages schedules."""
    rows = inserted(messages).where((F.col("p") == STATUS) & (F.col("o") == SCHEDULED))
    return rows.select(F.col("s").alias("task")).distinct()
