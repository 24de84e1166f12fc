"""Transitive closure of edges, from given seeds, in rounds that double their reach."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake.session import checkpoint_folder, cut

_FROM = ["a", "a_kind", "a_dt", "a_lang"]
_TO = ["b", "b_kind", "b_dt", "b_lang"]


def _then(first: DataFrame, second: DataFrame) -> DataFrame:
    """(a, c) where the first has (a, b) and the second (b, c), each once."""
    step = second.select("g", *[F.col(c).alias(f"to_{c}") for c in _FROM + _TO])
    meet = F.col("f.g") == F.col("e.g")
    for a, b in zip(_FROM, _TO):
        meet = meet & (F.col(f"f.{b}") == F.col(f"e.to_{a}"))
    return first.alias("f").join(step.alias("e"), meet).select(
        "f.g", *[f"f.{a}" for a in _FROM], *[F.col(f"e.to_{b}").alias(b) for b in _TO]).distinct()


def closure(edges: DataFrame, seeds: DataFrame, reflexive: bool = False) -> DataFrame:
    """(g, a..., b...): everything b that can be reached from a seed a.

    ``edges`` has (g, a..., b...), ``seeds`` (g, a...). Round k knows all that is fewer than
    2 ** k steps away and joins it with the jumps of exactly 2 ** k steps; the jumps are then
    joined with themselves. What is new is written as one more file of the known pairs, which
    are read as one table, so no plan grows. If a round finds nothing new, nothing is left:
    whatever is further away has something exactly 2 ** k steps away before it. A path of n
    steps takes about log2 n rounds; cycles need no care. Jumps are at most as many as pairs
    at that distance. The driver sees no rows.
    """
    spark = edges.sparkSession
    folder = f"{checkpoint_folder(spark).rstrip('/')}/closure-{uuid.uuid4()}"
    start = seeds.select("g", *_FROM).distinct()
    start = start.select("g", *_FROM, *[F.col(a).alias(b) for a, b in zip(_FROM, _TO)])
    edges = cut(edges.select("g", *_FROM, *_TO).distinct())
    found, jumps = [f"{folder}/0"], edges
    start.write.parquet(found[0])
    while True:
        known = spark.read.schema(start.schema).parquet(*found)
        path = f"{folder}/{len(found)}"
        _then(known, jumps).join(known, ["g", *_FROM, *_TO], "left_anti").write.parquet(path)
        if spark.read.schema(start.schema).parquet(path).isEmpty():
            break
        found.append(path)
        jumps = cut(_then(jumps, jumps))
    if reflexive:
        return known
    # A seed reaches itself only if something it reaches has an edge to it.
    itself, back = F.lit(True), F.col("k.g") == F.col("e.g")
    for a, b in zip(_FROM, _TO):
        itself = itself & (F.col(a) == F.col(b))
        back = back & (F.col(f"k.{a}") == F.col(f"e.{b}")) & (F.col(f"k.{b}") == F.col(f"e.{a}"))
    loops = known.alias("k").join(edges.alias("e"), back, "left_semi").select(
        "g", *_FROM, *[F.col(a).alias(b) for a, b in zip(_FROM, _TO)]).distinct()
    return known.where(~itself).unionByName(loops)


def edges_of(quads: DataFrame, predicates: list[str], inverse: bool = False) -> DataFrame:
    """(g, a..., b...): a is the subject and b the object, or the other way round."""
    found = quads.where(F.col("p").isin(*predicates))
    none = F.lit("")
    subject = [F.col("s"), F.col("s_kind"), none, none]
    object_ = [F.col(c) for c in ("o", "o_kind", "o_dt", "o_lang")]
    a, b = (object_, subject) if inverse else (subject, object_)
    return found.select("g", *[c.alias(n) for c, n in zip(a, _FROM)], *[c.alias(n) for c, n in zip(b, _TO)])
