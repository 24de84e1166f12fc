"""Mixing of sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks of equal size. With weight w, block k of a
source may be released at slot floor(k / w) and is due by slot ceil((k + 1) / w); each
slot goes to the released block with the earliest deadline. After any number of slots a
source has then had its share of them to within less than one block.

Weights are whole numbers that add up to a period, after which the schedule repeats: a
table of one period's slots serves any amount of data.

Without a largest share asked for, sources keep their true shares. The documents of each
are dealt evenly over its blocks of a whole number of periods, so all sources end
together and every document has a slot; rounding of weights only changes the size of a
block. With a largest share, blocks have a fixed size, and the mix ends where the first
source has no block left for its slot; documents beyond that are held back, since no mix
of these weights could hold them.

Given target weights by source, the slots go by those weights alone. Blocks have a fixed
size then too, and the mix ends where the first source runs dry. Sources without a weight
are not in the mix; a named source without documents takes no part.

Documents of a source are ordered by a hash bucket, then doc_id. A null source is a
source. Without target weights, sources with less than one slot in a period together are
a group of their own, dealt in the order of a hash. Repeated rows and null ids are
documents of their own. Other columns are kept. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadlake.llm.tables import constant_rows

BLOCK_ROWS = 8
PERIOD = 4096
# A largest share: no source gets more, unless there are too few sources.
MOST = 0.25
# Each source is numbered in so many parts, so that a large one is split.
BUCKETS = 1024
# The columns of the order of the mix.
ORDER = ("__slot", "__place")


def target_weights(counts: list[int], most: float = MOST, period: int = PERIOD) -> list[int]:
    """Slots of a period for groups of the given sizes: in proportion, none above the
    largest share; what that takes away goes to the others in proportion."""
    shares, capped = [c / sum(counts) for c in counts], set()
    most = max(most, 1 / len(counts))
    while over := [k for k, s in enumerate(shares) if s > most + 1e-12 and k not in capped]:
        capped.update(over)
        rest = sum(counts[k] for k in range(len(counts)) if k not in capped)
        left = 1 - most * len(capped)
        shares = [most if k in capped else counts[k] / rest * left for k in range(len(counts))]
    # Rounding down keeps a source from running dry early; the period is the sum.
    return [max(1, int(s * period)) for s in shares]


def given_weights(weights: list[float], period: int = PERIOD) -> list[int]:
    """Slots of a period for positive weights: the whole parts of their shares, and one slot
    more for the largest remainders, so that the period is full; never less than one."""
    exact = [w / sum(weights) * period for w in weights]
    found = [int(x) for x in exact]
    for k in sorted(range(len(exact)), key=lambda k: (found[k] - exact[k], k))[:period - sum(found)]:
        found[k] += 1
    return [max(1, n) for n in found]


def slots(weights: list[int]) -> Column:
    """The group of each slot of a period, by earliest deadline among released blocks."""
    w, period = f"array({', '.join(map(str, weights))})", sum(weights)
    # k: blocks that each group has had; p: the group of this slot.
    return F.expr(f"""
        aggregate(sequence(0, {period} - 1),
                  struct(array_repeat(0, {len(weights)}) AS k, cast(array() AS array<int>) AS chosen),
                  (a, t) -> transform(
                      array(array_min(transform(a.k, (x, i) ->
                          CASE WHEN x < {w}[i] AND x * {period} DIV {w}[i] <= t
                          THEN struct(int(((x + 1) * {period} + {w}[i] - 1) DIV {w}[i]) AS due, i AS i) END)).i),
                      p -> struct(transform(a.k, (x, i) -> x + int(i = p)) AS k, a.chosen || array(p) AS chosen))[0],
                  a -> a.chosen)""")


def schedule(spark: SparkSession, weights: list[int]) -> DataFrame:
    """(grp, turn, slot) of one period: the slot of each block of each group."""
    place = Window.partitionBy("grp").orderBy("slot")
    return (spark.range(1).select(F.posexplode(slots(weights)).alias("slot", "grp"))
            .withColumn("turn", F.row_number().over(place) - 1))


def mix(docs: DataFrame, block_rows: int = BLOCK_ROWS, most: float | None = MOST, period: int = PERIOD,
        targets: dict[str | None, float] | None = None) -> DataFrame:
    """The documents with __group, __block, __slot, __place in the block, and whether they
    are in the mix. The order of the mix is that of slot and place.

    With targets, weights by source, the largest share has no meaning; sources without a
    positive weight have no group. Without, and with most None, all documents are in the mix,
    and block_rows is the mean size of a block."""
    spark = docs.sparkSession
    if targets is not None:
        targets = {s: float(w) for s, w in targets.items()}
        if any(not 0 <= w < float("inf") for w in targets.values()) or not any(targets.values()):
            raise ValueError("target weights are finite, not negative and not all zero")
    sizes = docs.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n"))
    if targets is not None:
        asked = constant_rows(spark, [(s, w) for s, w in targets.items() if w > 0], "__asked string, __w double")
        # At most as many rows as there are weights.
        major = sorted((r for r in sizes.join(F.broadcast(asked), F.col("name").eqNullSafe(F.col("__asked"))).collect()),
                       key=lambda r: (-r.n, r.name is None, r.name or ""))
        group_sizes = [r.n for r in major]
        weights = given_weights([targets[r.name] for r in major], period) if major else []
        total = sum(group_sizes)
        if not major:
            group_sizes, weights = [1], [1]
    else:
        total = sizes.agg(F.sum("n")).first()[0] or 0
        # At most a period's number of rows come to the driver.
        major = sorted(sizes.where(F.col("n") * period >= total).collect(), key=lambda r: (-r.n, r.name or ""))
        group_sizes = [r.n for r in major]
        if (rest := total - sum(group_sizes)) or not major:
            group_sizes.append(max(rest, 1))
        weights = target_weights(group_sizes, 1.0 if most is None else most, period)
    groups = constant_rows(spark, [(r.name, k) for k, r in enumerate(major)], "__name string, __named int")
    other = F.lit(None).cast("int") if targets is not None else F.lit(len(weights) - 1)
    # Documents without a group pass through.
    how = "inner" if targets is None else "left"
    # Null ids go by their texts, so that many of them are not one bucket.
    by = F.xxhash64("doc_id")
    if "text" in docs.columns:
        by = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(by)
    keyed = (docs.join(F.broadcast(groups), F.col("source").eqNullSafe(F.col("__name")), "left")
             .withColumn("__group", F.coalesce("__named", other))
             .withColumn("__bucket", F.pmod(by, F.lit(BUCKETS))))
    # How many documents of a group come before a bucket: a row for each group and bucket.
    before = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    first = (keyed.groupBy(F.col("__group").alias("__g"), F.col("__bucket").alias("__b")).count()
             .select("__g", "__b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first")))
    inside = Window.partitionBy("__group", "__bucket").orderBy(*[c for c in ("doc_id", "text") if c in docs.columns])
    placed = (keyed.withColumn("__rank", F.row_number().over(inside) - 1)
              .join(first, (F.col("__group") == F.col("__g")) & (F.col("__bucket") == F.col("__b")), how)
              .withColumn("__index", F.col("__first") + F.col("__rank")))
    plan = schedule(spark, weights).select(F.col("grp").alias("__grp"), F.col("turn").alias("__next"), F.col("slot").alias("__at"))
    period = sum(weights)
    # Whole periods whose blocks hold all documents, and the blocks of each group in them.
    periods = max(1, -(-total // (block_rows * period)))
    by_group = constant_rows(spark, [(k, w, n, w * periods) for k, (n, w) in enumerate(zip(group_sizes, weights))],
                             "__member int, __weight int, __size long, __blocks long")
    # Products may exceed 64 bits.
    fixed = most is not None or targets is not None
    block, start = ((f"__index DIV {block_rows}", f"__block * {block_rows}") if fixed else (
        "cast(__index AS decimal(19, 0)) * __blocks DIV __size",
        "(cast(__block AS decimal(19, 0)) * __size + __blocks - 1) DIV __blocks"))
    slotted = (placed.join(F.broadcast(by_group), F.col("__group") == F.col("__member"), how)
               .withColumn("__block", F.expr(block))
               .withColumn("__place", F.col("__index") - F.expr(start))
               .withColumn("__turn", F.expr("int(__block % __weight)"))
               .join(F.broadcast(plan), (F.col("__group") == F.col("__grp")) & (F.col("__turn") == F.col("__next")), how)
               .withColumn("__slot", F.expr(f"(__block DIV __weight) * {period} + __at")))
    kept = [*docs.columns, "__group", "__block", "__slot", "__place"]
    if not fixed:
        return slotted.select(*kept, F.lit(True).alias("__in_mix"))
    # The first slot for which a group has no block, from the same table of slots.
    ends = constant_rows(spark, [(k, -(-n // block_rows) // w, -(-n // block_rows) % w) for k, (n, w) in enumerate(zip(group_sizes, weights))],
                         "group_no int, rounds long, next_turn int")
    end = (ends.join(plan, (F.col("group_no") == F.col("__grp")) & (F.col("next_turn") == F.col("__next")))
           .agg(F.min(F.col("rounds") * period + F.col("__at"))).first()[0]) if total else 0
    return slotted.select(*kept, F.coalesce(F.col("__slot") < F.lit(end), F.lit(False)).alias("__in_mix"))


def mixed(docs: DataFrame, most: float | None = None, **options) -> DataFrame:
    """The documents of the mix in its order, all columns kept: all documents, unless a
    largest share is asked for. A table that is written and read again has no order; of
    the same documents ``mix`` gives the same slots and places again."""
    found = mix(docs, most=most, **options).where("__in_mix")
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (found.repartitionByRange(shards, *ORDER).sortWithinPartitions(*ORDER).select(*docs.columns))
