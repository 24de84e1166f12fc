"""Property paths as quads: the structure of a path text is written, and read back as text.

The text of a path of one predicate is its IRI. Any other text has its predicates in angle
brackets: steps joined by '/', '^' before an inverse step, '?', '+' or '*' after a
repeated one, alternatives in parentheses with '|'. A predicate holds no '>'.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake.functions.terms import mint
from quadlake.operators.lists import list_members, list_quads, members_of
from quadlake.operators.records import insert, link
from quadlake.quads import OBJECT, SUBJECT
from quadlake.session import cut
from quadlake.vocab import IRI, LITERAL, RDF_FIRST, SH, SKOLEM_BASE

# The predicates of path expressions, by sign.
REPEATS = {"*": SH + "zeroOrMorePath", "+": SH + "oneOrMorePath", "?": SH + "zeroOrOnePath"}
INVERSE = SH + "inversePath"
ALTERNATIVE = SH + "alternativePath"

_IRI_TEXT = r"<[^>]*>"
STEP_TEXT = rf"(\^?(?:{_IRI_TEXT}|\((?:{_IRI_TEXT}\|?)+\))[?+*]?)"
_KEY = ["g", "node", "node_kind"]


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, "[<>]", "")


def _listed(nodes: DataFrame, parts: Column, minted: Column | None = None) -> DataFrame:
    """Rows of list members from an array of part texts; a part that is no IRI has a minted node."""
    rows = nodes.select("g", F.col("node").alias("head"), F.posexplode(parts).alias("place", "part"))
    value = _bare(F.col("part"))
    if minted is not None:
        value = F.when(F.col("part").rlike(f"^{_IRI_TEXT}$"), value).otherwise(minted)
    none = F.lit("")
    return rows.select("g", "head", F.col("place").cast("bigint").alias("place"), "part", value.alias("o"),
                       F.lit(IRI).alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"))


def path_quads(paths: DataFrame) -> DataFrame:
    """Quads of the paths (g, node, path), each rooted at its node. Paths of one predicate have none.

    Nodes below the root are minted from their parent, so a rerun writes the same quads, and
    the same path under the same node is written once however often it is given.
    """
    # Few rows, which several frames below are made of: the paths are looked for once.
    complex_ = cut(paths.where(F.col("path").rlike("[<^]")).select("g", "node", "path").distinct())
    steps = complex_.withColumn("parts", F.regexp_extract_all("path", F.lit(STEP_TEXT), 1))
    several = F.size("parts") > 1
    listed = _listed(steps.where(several), F.col("parts"), mint(SKOLEM_BASE, F.lit("step"), "head", F.col("place").cast("string")))
    plain = F.col("part").rlike(f"^{_IRI_TEXT}$")
    # One row per step that has a structure of its own: a list's, or the path itself.
    step = listed.where(~plain).select("g", F.col("o").alias("node"), "part").unionByName(
        steps.where(~several).select("g", "node", F.col("parts")[0].alias("part")))
    sign = F.right("part", F.lit(1))
    repeated = sign.isin(*REPEATS)
    unsigned = F.when(repeated, F.expr("left(part, length(part) - 1)")).otherwise(F.col("part"))
    step = step.select("g", "node", F.when(repeated, sign).alias("sign"), unsigned.alias("part"))
    inverse = F.startswith("part", F.lit("^"))
    step = step.select("g", "node", "sign", inverse.alias("inverse"),
                       F.when(inverse, F.substr("part", F.lit(2))).otherwise(F.col("part")).alias("part"))
    # The node of each layer is that of the outer one where the layer is missing.
    is_iri = F.col("part").rlike(f"^{_IRI_TEXT}$")
    core = F.when(is_iri, _bare(F.col("part")))
    within = F.when(F.col("sign").isNull(), F.col("node")).otherwise(
        F.when(~F.col("inverse") & is_iri, core).otherwise(mint(SKOLEM_BASE, F.lit("repeated"), "node")))
    step = step.withColumn("within", within)
    inmost = F.when(~F.col("inverse"), F.col("within")).otherwise(
        F.when(is_iri, core).otherwise(mint(SKOLEM_BASE, F.lit("inverse"), "node")))
    step = step.withColumn("inmost", inmost).withColumn("list", mint(SKOLEM_BASE, F.lit("alternatives"), "node"))
    node, within, inmost = F.col("node"), F.col("within"), F.col("inmost")
    layers = insert(step, F.col("g"), [
        *[link(node, p, F.when(F.col("sign") == s, within)) for s, p in REPEATS.items()],
        link(within, INVERSE, F.when(F.col("inverse"), inmost)),
        link(inmost, ALTERNATIVE, F.when(~is_iri, F.col("list")))])
    alternatives = step.where(~is_iri).select("g", F.col("list").alias("node"), "part")
    lists = listed.unionByName(_listed(alternatives, F.regexp_extract_all("part", F.lit(f"({_IRI_TEXT})"), 1)))
    return layers.unionByName(list_quads(lists.drop("part")))


def _braced(text: Column, form: Column, *plain: str) -> Column:
    return F.when(form.isin(*plain), text).otherwise(F.concat(F.lit("("), text, F.lit(")")))


def path_texts(quads: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(g, node, node_kind, path): the text of every path expression in the quads.

    Expressions may nest in any way: what a step cannot say has parentheses around it. A
    round resolves the nodes whose parts are all resolved, so there are as many rounds as
    the deepest path has layers. A node whose parts are no paths, or that is part of itself, or
    that has two expressions, has no row. Lists that no path names are none of its business
    unless all their members are IRIs or paths: they are sequences. ``members`` are the
    list members, if they are known already.
    """
    members = list_members(quads) if members is None else members
    members = cut(members)
    direct = quads.where(F.col("p").isin(INVERSE, *REPEATS.values()))
    alternatives = members_of(quads.where(F.col("p") == ALTERNATIVE), members)
    none = F.lit(0).cast("bigint")
    parts = cut(direct.select("g", *SUBJECT, "p", none.alias("place"), *OBJECT).unionByName(
        alternatives.select("g", *SUBJECT, "p", "place", *OBJECT)).unionByName(
        members.select("g", F.col("head").alias("s"), F.col("head_kind").alias("s_kind"), F.lit(RDF_FIRST).alias("p"), "place",
                       *OBJECT)).where(F.col("o_kind") != LITERAL).withColumnsRenamed({"s": "node", "s_kind": "node_kind"}))
    literal = members.where(F.col("o_kind") == LITERAL).select(
        "g", F.col("head").alias("node"), F.col("head_kind").alias("node_kind")).distinct()
    # Parts that are expressions themselves wait for their texts; other IRIs are predicates.
    inner = parts.select("g", F.col("node").alias("o"), F.col("node_kind").alias("o_kind")).distinct()
    leaf = F.col("o_kind") == IRI
    known = parts.join(inner, ["g", "o", "o_kind"], "left_anti").where(leaf).select(
        "g", F.col("o").alias("node"), F.col("o_kind").alias("node_kind"),
        F.concat(F.lit("<"), "o", F.lit(">")).alias("path"), F.lit("iri").alias("form"), F.lit(0).alias("layer")).distinct()
    known = cut(known)
    open_ = cut(parts.join(literal, _KEY, "left_anti"))
    rounds = [known]
    while True:
        known = reduce(DataFrame.unionByName, rounds)
        done = known.select("g", F.col("node").alias("o"), F.col("node_kind").alias("o_kind"), "path", "form")
        waiting = open_.join(known.select(*_KEY), _KEY, "left_anti")
        sizes = waiting.join(done, ["g", "o", "o_kind"], "left").groupBy(*_KEY).agg(
            F.count("path").alias("ready"), F.count(F.lit(1)).alias("parts"), F.count_distinct("p").alias("ways"),
            F.count_if(F.col("p").isin(INVERSE, *REPEATS.values())).alias("singles"),
            F.min("p").alias("p"), F.array_sort(F.collect_list(F.struct("place", "path", "form"))).alias("texts"))
        sizes = sizes.where("ready = parts AND ways = 1 AND (singles = 0 OR parts = 1)")
        one = F.col("texts")[0]["path"]
        form = F.col("texts")[0]["form"]
        p = F.col("p")
        text = F.when(p == RDF_FIRST, F.array_join(F.col("texts.path"), "/"))
        text = text.when(p == ALTERNATIVE, F.concat(F.lit("("), F.array_join(F.col("texts.path"), "|"), F.lit(")")))
        text = text.when(p == INVERSE, F.concat(F.lit("^"), F.when(
            F.startswith(one, F.lit("^")), F.concat(F.lit("("), one, F.lit(")"))).otherwise(_braced(one, form, "iri", "alternative", "repeat"))))
        for sign, predicate in REPEATS.items():
            text = text.when(p == predicate, F.concat(_braced(one, form, "iri", "alternative", "inverse"), F.lit(sign)))
        # An inverse of a repeat is read like a repeat of the inverse: both go as far, backwards.
        formed = (F.when(p == RDF_FIRST, "sequence").when(p == ALTERNATIVE, "alternative")
                  .when((p == INVERSE) & (form != "repeat"), "inverse").otherwise("repeat"))
        fresh = cut(sizes.select(*_KEY, text.alias("path"), formed.alias("form"), F.lit(len(rounds)).alias("layer")))
        if fresh.isEmpty():
            break
        rounds.append(fresh)
    return known.where("layer > 0").select(*_KEY, "path")


def result_path_quads(results: DataFrame, graph: Column | str) -> DataFrame:
    """The structure of the paths that results name, under the nodes ``result_quads`` gives them.

    Each path is written once a graph. The results are read once more: store or cut them first.
    """
    g = F.lit(graph) if isinstance(graph, str) else graph
    named = results.select(g.alias("g"), "path").where(F.col("path").rlike("[<^]")).distinct()
    return path_quads(named.select("g", mint(SKOLEM_BASE, "path").alias("node"), "path"))


def with_path_texts(results: DataFrame, quads: DataFrame) -> DataFrame:
    """Results of stored result graphs (``results_from_quads``) with the texts of their paths.

    A path without a structure in its graph keeps the IRI that it has.
    """
    texts = path_texts(quads).where(F.col("node_kind") == IRI).select("g", F.col("node").alias("path"), F.col("path").alias("path_text"))
    found = results.join(texts, ["g", "path"], "left")
    return found.withColumn("path", F.coalesce("path_text", "path")).select(*results.columns)
