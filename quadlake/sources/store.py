"""The stored quad table: Parquet, partitioned by graph.

Files are range-sorted by (g, p, s): a large graph is spread over many tasks
and files, and a filter on the predicate skips row groups by their statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadlake.operators.scan import sorted_parts
from quadlake.quads import QUAD, QUAD_SCHEMA, as_set, sorted_once
from quadlake.session import shuffles_removed
from quadlake.vocab import WRITE_BATCH

MAX_FILE_ROWS = 20_000_000
# Bytes of a row group, so that a large file has many splits.
ROW_GROUP = 8 << 20


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUAD_SCHEMA).parquet(path).select(*QUAD)


def _write(quads: DataFrame, path: str, mode: str) -> None:
    """Each quad of the frame once; the stored ones are not looked at."""
    with shuffles_removed(quads.sparkSession):
        (sorted_once(quads.select(*QUAD), ["g", "p", "s", "o"]).write.mode(mode).option("maxRecordsPerFile", MAX_FILE_ROWS)
         .option("parquet.block.size", ROW_GROUP).partitionBy("g").parquet(path))


def create_store(quads: DataFrame, path: str) -> None:
    """Write a new store, each quad once."""
    _write(quads, path, "errorifexists")


def new_quads(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The incoming quads that are not stored yet, each once.

    Stored graphs that receive nothing are pruned by the semi-join on g.
    """
    graphs = incoming.select("g").distinct()
    return as_set(incoming).join(stored.join(graphs, "g", "left_semi"), QUAD, "left_anti")


def append_quads(quads: DataFrame, path: str) -> None:
    """Add quads to a store and keep it a set. Repeating the call adds nothing."""
    _write(new_quads(read_store(quads.sparkSession, path), quads), path, "append")


def store_graph(triples: DataFrame, g: str, path: str) -> None:
    """Store a frame of triples under the name of a graph."""
    append_quads(triples.withColumn("g", F.lit(g)).select(*QUAD), path)


def batch_ids(quads: DataFrame, n: int = WRITE_BATCH) -> DataFrame:
    """quads with (batch, complete): groups of n quads of one graph, the last may be short.

    The quads are sorted into parts first. A quad's number in its graph is its place among
    the graph's quads of its part, plus what earlier parts hold: one row per graph and
    part, so a large graph is numbered by many tasks.
    """
    if n < 1:
        raise ValueError("n must be at least one")
    parts = sorted_parts(quads, [F.col(c) for c in QUAD])
    sizes = parts.groupBy("g", "_part").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n"))
    so_far = Window.partitionBy("g").orderBy("_part")
    starts = sizes.select("g", "_part", "_least", (F.sum("_n").over(so_far) - F.col("_n")).alias("_before"),
                          F.sum("_n").over(Window.partitionBy("g")).alias("_size"))
    number = F.col("_before") + F.col("_id") - F.col("_least")
    numbered = parts.join(starts, ["g", "_part"]).withColumn("batch", F.floor(number / n))
    return (numbered.withColumn("complete", (F.col("batch") + 1) * n <= F.col("_size"))
            .drop("_part", "_id", "_least", "_before", "_size"))
