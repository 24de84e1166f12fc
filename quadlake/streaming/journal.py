"""Outputs of micro-batches under one commit record each, and snapshots of what they add up to.

A batch writes all its tables and then a commit record; readers go by the records, so a
batch that was cut off is not seen, and is written anew when it is repeated. A committed
batch is not run again. A journal belongs to one stream and its checkpoint.

Tables of changes are folded into a snapshot after every few batches: a state is read from
the last snapshot and the few batches since. Snapshots have commit records too, and a
repeated batch reads the one before it. Nothing is deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Batches between two snapshots.
EVERY = 20

_RECORD = "done boolean, kind string, n bigint"


class Journal:
    def __init__(self, spark: SparkSession, path: str, folds: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]],
                 every: int = EVERY):
        """folds: tables of changes with their schema and what they are folded by."""
        if every < 1:
            raise ValueError("a snapshot stands for at least one batch")
        self.spark, self.path, self.folds, self.every = spark, path.rstrip("/"), folds, every

    def _read(self, schema: str | T.StructType, *paths: str) -> DataFrame:
        empty = self.spark.createDataFrame([], schema)
        if not paths:
            return empty
        try:
            return self.spark.read.schema(schema).parquet(*paths)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return empty

    def _records(self, kind: str, below: int) -> DataFrame:
        found = self._read(_RECORD, f"{self.path}/commits")
        return found.where((F.col("kind") == kind) & (F.col("n") < below)).select("n")

    def _commit(self, kind: str, n: int) -> None:
        record = self.spark.range(1).select(F.lit(True).alias("done"))
        record.write.mode("overwrite").parquet(f"{self.path}/commits/kind={kind}/n={n}")

    def done(self, batch: int) -> bool:
        return not self._records("batch", batch + 1).where(F.col("n") == batch).isEmpty()

    def _since(self, before: int) -> tuple[int | None, list[int]]:
        """The last snapshot and the batches since; few, as snapshots follow each other."""
        last = self._records("snapshot", before).agg(F.max("n")).first()[0]
        after = self._records("batch", before).where(F.col("n") > (-1 if last is None else last))
        return last, sorted(r.n for r in after.distinct().collect())

    def changes(self, name: str, before: int) -> DataFrame:
        """A table of changes: the last snapshot and the batches since."""
        last, batches = self._since(before)
        paths = [f"{self.path}/{name}/batch={n}" for n in batches]
        if last is not None:
            paths.append(f"{self.path}/snapshots/upto={last}/{name}")
        return self._read(self.folds[name][0], *paths)

    def state(self, name: str, before: int) -> DataFrame:
        """What the changes add up to."""
        return self.folds[name][1](self.changes(name, before))

    def latest(self, name: str, schema: str, before: int) -> DataFrame:
        """A table that each batch writes whole: that of the last batch."""
        n = self._records("batch", before).agg(F.max("n")).first()[0]
        return self._read(schema, *([] if n is None else [f"{self.path}/{name}/batch={n}"]))

    def output(self, name: str, schema: T.StructType, before: int) -> DataFrame:
        """All committed rows of a table that only grows."""
        whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        rows = self._read(whole, f"{self.path}/{name}").where(F.col("batch") < before)
        records = self._records("batch", before).select(F.col("n").alias("batch")).distinct()
        return rows.join(records, "batch", "left_semi").select(*schema.fieldNames())

    def write(self, batch: int, frames: dict[str, DataFrame]) -> None:
        """Write the tables of a batch, commit it, and make a snapshot when it is time."""
        for name, frame in frames.items():
            frame.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        self._commit("batch", batch)
        if len(self._since(batch + 1)[1]) >= self.every:
            for name in self.folds:
                self.state(name, batch + 1).write.mode("overwrite").parquet(f"{self.path}/snapshots/upto={batch}/{name}")
            self._commit("snapshot", batch)
