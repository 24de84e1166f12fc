"""Coverage kept up to date from inserts and deletes, without another scan of the quads.

Kept are, per subject, how many quads it has of each class and property of the rules; per
graph, how many subjects have the same bits (as in ``plans.coverage``) and how many quads
there are. A batch of changes reads the counts of the subjects it touches, takes their old
bits away and adds their new ones. Coverage then follows from the few rows of bits.

All of it lies in a journal: changes with a commit record, folded into snapshots. The rules
must stay the same for one journal.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.plans.coverage import bit_places, coverage_of, is_type, needs_of, slots_of
from quadlake.quads import QUAD, SUBJECT, as_set
from quadlake.session import cut
from quadlake.sources.buckets import apply_changes, read_buckets
from quadlake.spec import Rule
from quadlake.streaming.journal import EVERY, Journal

_KEY = ["g", *SUBJECT]
_END = 2 ** 62


def _total(*keys: str):
    """Counts by the keys, without those that are zero."""
    return lambda df: df.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")


class StandingCoverage:
    def __init__(self, spark: SparkSession, path: str, spec: Iterable[Rule] | DataFrame | None = None, every: int = EVERY):
        self.spark = spark
        self.rules, classes, properties = needs_of(spec)
        places = [*bit_places(classes).values(), *bit_places(properties, len(classes)).values()]
        self.words = [f"w{w}" for w in range(max((w for w, _ in places), default=0) + 1)]
        self.slots = slots_of(spark, classes, properties)
        bits = ", ".join(f"{w} bigint" for w in self.words)
        self.journal = Journal(spark, path, {
            "subjects": ("g string, s string, s_kind string, word int, mark bigint, n bigint", _total(*_KEY, "word", "mark")),
            "profiles": (f"g string, {bits}, n bigint", _total("g", *self.words)),
            "graphs": ("g string, n bigint", _total("g"))}, every)

    def _marks(self, changes: DataFrame) -> DataFrame:
        """(g, s, s_kind, word, mark, n): how the counts of each subject change."""
        named = changes.select(*_KEY, "p", "n", F.when(F.col("is_type"), F.col("o")).otherwise("").alias("class"))
        return _total(*_KEY, "word", "mark")(named.join(F.broadcast(self.slots), ["p", "class"]))

    def _bits(self, counts: str) -> list:
        zero = F.lit(0).cast("bigint")
        return [F.coalesce(F.bit_or(F.when((F.col("word") == k) & (F.col(counts) > 0), F.col("mark"))), zero).alias(w)
                for k, w in enumerate(self.words)]

    def _moves(self, stored: DataFrame, delta: DataFrame) -> DataFrame:
        """(g, s, s_kind, old, new): the bits of each subject before and after. One shuffle on the
        subject serves its counts and its bits."""
        zero, one = (F.lit(n).cast("bigint") for n in (0, 1))
        both = (stored.withColumn("more", zero).unionByName(delta.select(*_KEY, "word", "mark", zero.alias("n"), F.col("n").alias("more")))
                .repartition(*_KEY).groupBy(*_KEY, "word", "mark")
                .agg(F.sum("n").alias("before"), F.sum(F.col("n") + F.col("more")).alias("after")))
        return both.groupBy(*_KEY).agg(F.struct(*self._bits("before"), (-one).alias("n")).alias("old"),
                                       F.struct(*self._bits("after"), one.alias("n")).alias("new"))

    def change(self, batch: int, added: DataFrame, removed: DataFrame | None = None) -> None:
        """Fold in the changes of a batch: added quads that were not there, removed ones that
        were (``effective_changes`` finds them). A committed batch is not folded in again."""
        if self.journal.done(batch):
            return
        signed = added.select(*QUAD, F.lit(1).cast("bigint").alias("n"))
        if removed is not None:
            signed = signed.unionByName(removed.select(*QUAD, F.lit(-1).cast("bigint").alias("n")))
        signed = signed.withColumn("is_type", is_type())
        delta = cut(self._marks(signed))
        touched = delta.select(*_KEY).distinct()
        # Only the touched subjects' counts are added up.
        stored = self.journal.changes("subjects", batch).join(touched, _KEY, "left_semi")
        moves = self._moves(stored, delta)
        moved = moves.select("g", F.inline(F.array("old", "new")))
        some = F.lit(False)
        for w in self.words:
            some = some | (F.col(w) != 0)
        self.journal.write(batch, {
            "subjects": delta, "profiles": _total("g", *self.words)(moved.where(some)),
            "graphs": _total("g")(signed)})

    def coverage(self, before: int = _END) -> DataFrame:
        """Coverage after the committed batches below a number: equal to ``coverage`` of the quads then."""
        graphs = self.journal.state("graphs", before).select("g")
        return coverage_of(self.journal.state("profiles", before), graphs, self.rules)


def effective_changes(stored: DataFrame, removed: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added, removed) that really change the stored quads. A quad both removed and added stays."""
    more, less = as_set(added), as_set(removed)
    less = less.join(more, QUAD, "left_anti").join(stored, QUAD, "left_semi")
    return more.join(stored, QUAD, "left_anti"), less


def change_store(standing: StandingCoverage, store: str, batch: int, removed: DataFrame, added: DataFrame) -> int:
    """Apply a batch of changes to a store of buckets and to its standing coverage; how many
    buckets were rewritten. The coverage is committed first and the store's change can be
    repeated, so a batch that was cut off anywhere is simply run again."""
    if not standing.journal.done(batch):
        more, less = effective_changes(read_buckets(standing.spark, store), removed, added)
        standing.change(batch, cut(more), cut(less))
    return apply_changes(standing.spark, store, removed, added)
