"""Coverage of catalogue classes against a rule set, for all graphs in one pass.

Every subject becomes one row of bits (which classes, which properties) by a
``bit_or`` over its quads: one shuffle on the subject with map-side
combination, no join and no distinct. Equal rows of bits are then counted per
graph, and only those few rows meet the rules.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.operators.checks import severity_of
from quadlake.quads import SUBJECT
from quadlake.session import cut, local_frame, metadata_rows
from quadlake.spec import RULES, Rule
from quadlake.vocab import IRI, RDF_TYPE

# Bits used of one long.
_WORD = 60


def as_rules(spec: Iterable[Rule] | DataFrame | None) -> list[Rule]:
    """Rules from a list or from a frame (class, requirement, property)."""
    if spec is None:
        return list(RULES)
    if isinstance(spec, DataFrame):
        rows = metadata_rows(spec.select("class", "requirement", "property").distinct())
        return sorted(Rule(*r) for r in rows)
    return [Rule(*r) for r in spec]


def bit_places(keys: list[str], first: int = 0) -> dict[str, tuple[int, int]]:
    """Key to (word, bit)."""
    return {k: divmod(i + first, _WORD) for i, k in enumerate(keys)}


def _marks(keys: dict[str, tuple[int, int]], key: str, words: int) -> list[int]:
    at = keys.get(key)
    return [1 << at[1] if at and at[0] == w else 0 for w in range(words)]


def is_type() -> Column:
    """Type quads: only there the object counts."""
    return (F.col("p") == RDF_TYPE) & (F.col("o_kind") == IRI)


def slots_of(spark: SparkSession, classes: list[str], properties: list[str]) -> DataFrame:
    """(p, class, word, mark): the bit of each class and property; class is '' for properties."""
    slots = [(RDF_TYPE, c, w, 1 << b) for c, (w, b) in bit_places(classes).items()]
    slots += [(p, "", w, 1 << b) for p, (w, b) in bit_places(properties, len(classes)).items()]
    return local_frame(spark, slots, "p string, class string, word int, mark bigint")


def needs_of(spec: Iterable[Rule] | DataFrame | None) -> tuple[list[Rule], list[str], list[str]]:
    """The rules, their classes, and the properties that need a bit."""
    rules = as_rules(spec)
    classes = list(dict.fromkeys(r.cls for r in rules))
    # Every entity of a class has a type, so that property needs no bit.
    return rules, classes, list(dict.fromkeys(r.property for r in rules if r.property != RDF_TYPE))


def subject_bits(quads: DataFrame, classes: list[str], properties: list[str], below: DataFrame | None = None) -> DataFrame:
    """(g, s, s_kind, w0, w1...): the classes and properties of each subject as bits.

    Class i has bit i, property j bit len(classes) + j, 60 bits to a word. With below, the
    subclasses (g, class, sub) of the classes, an instance of a subclass has the bits of all
    classes above it: the bits of what is above each subclass are put together first, so
    each type quad finds them in one row per word, and no subject is repeated per class.
    """
    at_class, at_property = bit_places(classes), bit_places(properties, len(classes))
    table = slots_of(quads.sparkSession, classes, properties)
    relevant = quads.where(
        F.col("p").isin(*properties) | ((F.col("p") == RDF_TYPE) & F.col("o").isin(*classes)))
    marks = relevant.select("g", *SUBJECT, "p", F.when(is_type(), F.col("o")).otherwise("").alias("class")) \
        .join(F.broadcast(table), ["p", "class"])
    if below is not None:
        above = [(c, w, 1 << b) for c, (w, b) in at_class.items()]
        names = F.broadcast(local_frame(quads.sparkSession, above, "class string, word int, mark bigint"))
        # Written first, so the planner knows its size and broadcasts it where it is small.
        up = cut(below.join(names, "class").groupBy("g", F.col("sub").alias("class"), "word").agg(F.bit_or("mark").alias("mark")))
        typed = quads.where(is_type()).select("g", *SUBJECT, F.col("o").alias("class"))
        marks = marks.select("g", *SUBJECT, "word", "mark").unionByName(
            typed.join(up, ["g", "class"]).select("g", *SUBJECT, "word", "mark"))
    words = max((w for w, _ in (*at_class.values(), *at_property.values())), default=0) + 1
    zero = F.lit(0).cast("bigint")
    return marks.groupBy("g", *SUBJECT).agg(*[
        F.coalesce(F.bit_or(F.when(F.col("word") == w, F.col("mark"))), zero).alias(f"w{w}")
        for w in range(words)])


def coverage(quads: DataFrame, spec: Iterable[Rule] | DataFrame | None = None) -> DataFrame:
    """One row per graph and rule: how many entities of the class miss the property.

    Columns g, class, requirement, property, severity, total_entities,
    entities_with_property, violation_count. Every graph of the quads gets every
    rule, with zeros where it has no entity of the class.
    """
    rules, classes, properties = needs_of(spec)
    bits = subject_bits(quads, classes, properties)
    words = [c for c in bits.columns if c.startswith("w")]
    profiles = bits.groupBy("g", *words).agg(F.count(F.lit(1)).alias("n"))
    return coverage_of(profiles, quads.select("g").distinct(), rules)


def coverage_of(profiles: DataFrame, graphs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Coverage from profiles (g, w0, w1..., n), how many subjects have the same bits, for the given graphs (g)."""
    spark = profiles.sparkSession
    _, classes, properties = needs_of(rules)
    at_class, at_property = bit_places(classes), bit_places(properties, len(classes))
    words = [c for c in profiles.columns if c.startswith("w")]
    # Graphs without any relevant quad take part with no entities.
    zero = F.lit(0).cast("bigint")
    graphs = graphs.select("g", *[zero.alias(w) for w in words], zero.alias("n"))

    needs = local_frame(
        spark,
        [(r.cls, r.requirement, r.property, r.property == RDF_TYPE,
          _marks(at_property, r.property, len(words))) for r in rules],
        "class string, requirement string, property string, is_type boolean, marks array<bigint>")
    member = [F.struct(F.lit(c).alias("class"), F.lit(w).alias("word"), F.lit(1 << b).cast("bigint").alias("mark"))
              for c, (w, b) in at_class.items()]
    word_array = F.array(*words)

    def belongs(x: Column) -> Column:
        return F.get(word_array, x["word"]).bitwiseAND(x["mark"]) != 0

    per_class = profiles.select("g", "n", *words, F.explode(F.filter(F.array(*member), belongs)).alias("m"))
    blank = graphs.select("g", "n", *words, F.explode(F.array(*member)).alias("m"))
    both = per_class.unionByName(blank).select("g", "n", *words, F.col("m.class").alias("class"))
    has = F.exists(F.zip_with(word_array, "marks", lambda a, b: a.bitwiseAND(b)), lambda x: x != 0)
    found = (
        both.join(F.broadcast(needs), "class")
        .groupBy("g", "class", "requirement", "property")
        .agg(F.sum("n").alias("total_entities"),
             F.sum(F.when(has | F.col("is_type"), F.col("n")).otherwise(0)).alias("entities_with_property"))
    )
    missing = F.greatest(F.lit(0), F.col("total_entities") - F.col("entities_with_property"))
    return found.select(
        "g", "class", "requirement", "property", severity_of(F.col("requirement")).alias("severity"),
        "total_entities", "entities_with_property", missing.alias("violation_count"))


def coverage_total(covered: DataFrame) -> DataFrame:
    """(g, total_violations) over all levels of requirement."""
    return covered.groupBy("g").agg(F.sum("violation_count").alias("total_violations"))


def coverage_nested(covered: DataFrame) -> DataFrame:
    """(g, total_violations, class_coverages): lists as long as the rule set."""
    rule = F.struct(
        F.col("property").alias("property_uri"), "requirement", "entities_with_property",
        "total_entities", "violation_count")
    per_class = covered.groupBy("g", "class").agg(
        F.max("total_entities").alias("total_entities"),
        F.sum("violation_count").alias("violations"),
        F.sort_array(F.collect_list(rule)).alias("rule_violations"))
    entry = F.struct(F.col("class").alias("class_uri"), "total_entities", "rule_violations")
    return per_class.groupBy("g").agg(
        F.sum("violations").alias("total_violations"),
        F.sort_array(F.collect_list(entry)).alias("class_coverages"))
