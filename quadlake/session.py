"""Session settings, lineage cuts and small driver-side frames."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Adaptive execution splits hot join keys at run time. "force" lets it do so
# even where a later aggregation then needs its own shuffle.
_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# Quads are compressed some fifty to one: a split or a partition of the usual size holds
# millions of them. These keep a task's share the same however large the store is; adaptive
# execution joins small partitions again. A caller's own settings stay.
_QUAD_SETTINGS = {
    "spark.sql.files.maxPartitionBytes": "8m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "600",
}

# Default bound of tables of rules and shapes, which are metadata and broadcast; a caller
# with more of them passes a bound of its own.
MAX_LOCAL_ROWS = 10_000


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings the operators rely on."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def tune_quads(spark: SparkSession) -> SparkSession:
    """Settings of ``tune``, and small shares of the tasks over stored quads."""
    for key, value in _QUAD_SETTINGS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return tune(spark)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only for a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="quadlake-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind; else they stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame, folder: str | None = None, packed: bool = False) -> DataFrame:
    """Write df as a table in the checkpoint folder, or a given one, and go on from there.

    A later loss of executors costs no recomputation, each part of the plan
    sees the same rows, and the planner knows the real size. packed is for tables of
    minted IRIs, whose digits take half the room then.
    """
    path = f"{folder or checkpoint_folder(df.sparkSession)}/cut-{uuid.uuid4()}"
    with shuffles_removed(df.sparkSession):
        df.write.options(**({"compression": "zstd"} if packed else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of intermediate rows, or a folder of them, that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def local_frame(spark: SparkSession, rows: Iterable[Sequence], schema: T.StructType | str,
                most: int = MAX_LOCAL_ROWS) -> DataFrame:
    """A frame of at most ``most`` metadata rows, a local relation with known statistics."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    rows = list(rows)
    if len(rows) > most:
        raise ValueError(f"{len(rows)} rows are too many for a table of metadata")
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in arrow]
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema)


def metadata_rows(df: DataFrame, most: int = MAX_LOCAL_ROWS) -> list:
    """Rows of a metadata table on the driver, after a check of its size."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows in a table of metadata")
    return rows
