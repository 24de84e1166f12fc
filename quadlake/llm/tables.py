"""Reading the tables and mapping Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.session import tune


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow form of a DDL schema of simple columns and arrays of them."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))


def emit(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Batches of rows, a few thousand at a time."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def map_rows(df: DataFrame, f: Callable[[Iterator[tuple]], Iterable[tuple]], ddl: str, size: int = 4096) -> DataFrame:
    """f turns the rows of a partition, in their order, into rows of the schema."""
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for part in parts(b) for row in zip(*(c.to_pylist() for c in part.columns)))
        return emit(f(rows), schema, size)

    return df.mapInArrow(run, ddl)


def parts(batch: pa.RecordBatch, size: int = 512) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, size):
        yield batch.slice(start, size)


def constant_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A frame of a few given rows, as a SQL constant."""
    names = [f.split()[0] for f in ddl.split(", ")]
    text = json.dumps([dict(zip(names, row)) for row in rows])
    kinds = ", ".join(f.strip().replace(" ", ":", 1) for f in ddl.split(","))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{kinds}>>")))
