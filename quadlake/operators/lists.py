"""RDF lists, written from rows of members and read back by pointer jumping."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake.functions.terms import mint
from quadlake.quads import OBJECT, QUAD, SUBJECT
from quadlake.session import checkpoint_folder, cut
from quadlake.vocab import IRI, LITERAL, RDF_FIRST, RDF_NIL, RDF_REST, SKOLEM_BASE

_CELL = ["g", "n", "n_kind"]
_HEAD = ["head", "head_kind"]


def list_quads(members: DataFrame) -> DataFrame:
    """Quads of lists given as (g, head, place, o, o_kind, o_dt, o_lang), one row per member.

    ``head`` is the IRI of the first cell; the others are minted from it and their place. The
    places of a list are 0, 1, 2 and so on, without gaps. A list has no row of its own, so
    an empty one is just rdf:nil where it is named. Members go one by one: a list of any
    length is spread over many tasks, and only its length is shuffled.
    """
    def cell(place):
        return F.when(place == 0, F.col("head")).otherwise(mint(SKOLEM_BASE, F.lit("cell"), "head", place.cast("string")))

    ends = members.groupBy("g", "head").agg(F.max("place").alias("end"))
    here = F.col("place")
    following = F.when(here == F.col("end"), F.lit(RDF_NIL)).otherwise(cell(here + 1))
    none = F.lit("")
    return members.join(ends, ["g", "head"]).select("g", cell(here).alias("s"), F.lit(IRI).alias("s_kind"), F.inline(F.array(
        F.struct(F.lit(RDF_FIRST).alias("p"), *OBJECT),
        F.struct(F.lit(RDF_REST).alias("p"), following.alias("o"), F.lit(IRI).alias("o_kind"),
                 none.alias("o_dt"), none.alias("o_lang"))))).select(*QUAD)


def _cells(quads: DataFrame) -> DataFrame:
    """(g, n, n_kind, to, to_kind, o...): the cells with one member and one rest."""
    first, rest = F.col("p") == RDF_FIRST, F.col("p") == RDF_REST
    member = F.min(F.when(first, F.struct(*OBJECT)))
    found = quads.where(F.col("p").isin(RDF_FIRST, RDF_REST)).groupBy(
        "g", F.col("s").alias("n"), F.col("s_kind").alias("n_kind")).agg(
        member.alias("member"), F.min(F.when(rest, F.struct("o", "o_kind"))).alias("to"),
        F.count_if(first).alias("firsts"), F.count_if(rest).alias("rests"))
    return found.where("firsts = 1 AND rests = 1").select(
        *_CELL, F.col("to.o").alias("to"), F.col("to.o_kind").alias("to_kind"), "member.*")


def _ahead(first: DataFrame, jumps: DataFrame) -> DataFrame:
    """The rows of the first frame whose cell has a jump, with the cell it leads to as a_n, a_kind."""
    step = jumps.select("g", "n", "n_kind", F.col("to").alias("a_n"), F.col("to_kind").alias("a_kind"))
    return first.join(step, _CELL)


def list_members(quads: DataFrame) -> DataFrame:
    """(g, head, head_kind, place, o, o_kind, o_dt, o_lang): the members of every list.

    A list starts at a cell that no other cell goes on to, or that another predicate
    names; so the tail of a list may be a list too. Every cell must have one member and one
    rest, and the last one rdf:nil: a list that runs into anything else, or into itself, has
    no rows, and neither does the empty list. Round k joins what lies fewer than 2 ** k cells
    ahead of a head with the jumps of 2 ** k cells, so the longest list of n cells takes about
    log2 n rounds, all lists together. Each round is written; the driver sees counts only.
    """
    spark = quads.sparkSession
    cells = cut(_cells(quads))
    is_end = (F.col("to") == RDF_NIL) & (F.col("to_kind") == IRI)
    total = cells.count()
    followed = cells.where(~is_end).select("g", F.col("to").alias("n"), F.col("to_kind").alias("n_kind"))
    # The keys of the cells are the right side: where they are few, the quads are not shuffled.
    named = quads.where(~F.col("p").isin(RDF_REST, RDF_FIRST) & (F.col("o_kind") != LITERAL)).select(
        "g", F.col("o").alias("n"), F.col("o_kind").alias("n_kind"))
    # A member that is a list itself is named by rdf:first.
    inner = cells.select("g", F.col("o").alias("n"), F.col("o_kind").alias("n_kind"))
    heads = cells.select(*_CELL).join(followed, _CELL, "left_anti").unionByName(
        named.unionByName(inner).join(cells.select(*_CELL), _CELL, "left_semi")).distinct()
    start = heads.select("g", F.col("n").alias("head"), F.col("n_kind").alias("head_kind"), "n", "n_kind",
                         F.lit(0).cast("bigint").alias("place"))
    folder = f"{checkpoint_folder(spark).rstrip('/')}/lists-{uuid.uuid4()}"
    found = [f"{folder}/0"]
    start.write.parquet(found[0])
    jumps, reach = cells.where(~is_end).select(*_CELL, "to", "to_kind"), 1
    while True:
        known = spark.read.schema(start.schema).parquet(*found)
        # No list without a ring is longer than all cells.
        if reach >= total:
            break
        path = f"{folder}/{len(found)}"
        _ahead(known, jumps).select("g", *_HEAD, F.col("a_n").alias("n"), F.col("a_kind").alias("n_kind"),
                                    (F.col("place") + reach).alias("place")).write.parquet(path)
        if spark.read.schema(start.schema).parquet(path).isEmpty():
            break
        found.append(path)
        ahead = jumps.select("g", F.col("to").alias("n"), F.col("to_kind").alias("n_kind"),
                             F.col("n").alias("from"), F.col("n_kind").alias("from_kind"))
        jumps = cut(_ahead(ahead, jumps).select("g", F.col("from").alias("n"), F.col("from_kind").alias("n_kind"),
                                                F.col("a_n").alias("to"), F.col("a_kind").alias("to_kind")))
        reach *= 2
    whole = known.join(cells.where(is_end).select(*_CELL), _CELL).select("g", *_HEAD)
    return (known.join(cells.select(*_CELL, *OBJECT), _CELL).join(whole, ["g", *_HEAD], "left_semi")
            .select("g", *_HEAD, "place", *OBJECT))


def members_of(links: DataFrame, members: DataFrame) -> DataFrame:
    """(g, s, s_kind, p, place, o...): for quads that name a list, its members."""
    lists = members.withColumnsRenamed({"head": "to", "head_kind": "to_kind"})
    return links.select("g", *SUBJECT, "p", F.col("o").alias("to"), F.col("o_kind").alias("to_kind")).join(
        lists, ["g", "to", "to_kind"]).drop("to", "to_kind")
