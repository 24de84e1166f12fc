"""A store for very many graphs: a fixed number of buckets of graphs, and changes applied to it.

A folder per graph suits a few large graphs; result graphs, one per run, would soon be
millions of folders. Here a graph lies in the bucket its name hashes to. Files are range-sorted
by (bucket, g, p, s, o), so a bucket with a very large graph is spread over many files and a
predicate skips row groups by their statistics; Parquet Bloom filters on s and o let a bound
subject or object skip all files that do not have it. The number of buckets is part of the
path, so readers need no other metadata.

Changes rewrite only the buckets of the graphs they touch, by dynamic partition overwrite: the
new rows of these buckets are written in full to the shared folder first, then replace the old
ones in one commit per call. Applying a change again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadlake.quads import QUAD, QUAD_SCHEMA, as_set, sorted_once
from quadlake.session import cut
from quadlake.sources.store import MAX_FILE_ROWS

BUCKETS = 64
_PLACE = ["buckets", "bucket"]
_ORDER = ["bucket", "g", "p", "s", "o"]
_SCHEMA = T.StructType([*QUAD_SCHEMA.fields, *[T.StructField(c, T.IntegerType()) for c in _PLACE]])
# Different subjects or objects a Bloom filter of a row group is laid out for.
_DISTINCT = 200_000
_BLOOM = {f"parquet.bloom.filter.{k}#{c}": v for c in ("s", "o")
          for k, v in (("enabled", "true"), ("expected.ndv", str(_DISTINCT)))}


def bucket_of(g: Column, n: Column) -> Column:
    return F.pmod(F.xxhash64(g), n).cast("int")


def _placed(quads: DataFrame, n: int) -> DataFrame:
    return quads.select(*QUAD, F.lit(n).alias("buckets"), bucket_of(F.col("g"), F.lit(n)).alias("bucket"))


def _write(rows: DataFrame, path: str, mode: str) -> None:
    """rows: QUAD and _PLACE, in parts sorted by _ORDER."""
    (rows.write.mode(mode).options(**_BLOOM)
     .option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", MAX_FILE_ROWS)
     .partitionBy(*_PLACE).parquet(path))


def create_buckets(quads: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write a new store, each quad once."""
    if buckets < 1:
        raise ValueError("a store has at least one bucket")
    _write(sorted_once(_placed(quads, buckets), _ORDER), path, "errorifexists")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(path)


def n_buckets(spark: SparkSession, path: str) -> int:
    """The number of buckets the store was made with."""
    row = spark.read.schema(_SCHEMA).parquet(path).select("buckets").first()
    if row is None:
        raise ValueError(f"no quads at {path}; a store cannot tell its number of buckets then")
    return row.buckets


def read_buckets(spark: SparkSession, path: str, graphs: list[str] | None = None) -> DataFrame:
    """The quads of a store; with names of graphs only their buckets are opened."""
    found = _stored(spark, path)
    if graphs is not None:
        at = [bucket_of(F.lit(g), F.col("buckets")) for g in graphs]
        found = found.where(F.col("bucket").isin(*at) & F.col("g").isin(*graphs)) if graphs else found.where(F.lit(False))
    return found.select(*QUAD)


def apply_changes(spark: SparkSession, path: str, removed: DataFrame, added: DataFrame) -> int:
    """Take the removed quads out of a store and put the added ones in; how many buckets were rewritten.

    A quad both removed and added stays. Only buckets that really change are rewritten: quads
    to remove that are not stored and quads to add that are do not count.
    """
    n = n_buckets(spark, path)
    stored = _stored(spark, path)
    gone = _placed(as_set(removed), n).join(added.select(*QUAD), QUAD, "left_anti")
    wanted = cut(gone.withColumn("keep", F.lit(False)).unionByName(_placed(as_set(added), n).withColumn("keep", F.lit(True))))
    # Which stored quads the changes meet; buckets without a change are pruned by the semi-join.
    buckets = [r.bucket for r in wanted.select("bucket").distinct().collect()]  # at most as many as there are buckets
    near = stored.where(F.col("bucket").isin(*buckets))
    there = near.select(*QUAD, F.lit(True).alias("there"))
    real = cut(wanted.join(there, QUAD, "left").where(F.col("keep") != F.coalesce("there", F.lit(False))).drop("there"))
    touched = [r.bucket for r in real.select("bucket").distinct().collect()]
    if not touched:
        return 0
    kept = stored.where(F.col("bucket").isin(*touched)).join(real.where("not keep").select(*QUAD), QUAD, "left_anti")
    fresh = cut(kept.select(*QUAD, *_PLACE).unionByName(real.where("keep").select(*QUAD, *_PLACE)))
    filled = {r.bucket for r in fresh.select("bucket").distinct().collect()}
    _write(fresh.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER), path, "overwrite")
    # An overwrite leaves alone the folders that get no rows.
    for bucket in set(touched) - filled:
        _remove(spark, f"{path.rstrip('/')}/buckets={n}/bucket={bucket}")
    return len(touched)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
