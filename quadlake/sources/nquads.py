"""N-Triples and N-Quads text in and out, one statement per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.functions.terms import n3, unescape
from quadlake.quads import QUAD
from quadlake.vocab import BNODE, IRI, LANG_STRING, LITERAL, XSD_STRING

# Fixed patterns of the line formats. Possessive repeats keep the matcher from
# recursing, so literals of any length pass.
_IRIREF = r"<((?:[^\x00-\x20<>\"{}|^`\\]++|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})++)>"
_BLANK = r"_:([0-9\p{L}_](?:[\p{L}\p{N}_:\-.]*[\p{L}\p{N}_:\-])?)"
_QUOTED = r"\"((?:[^\"\\\r\n]++|\\[tbnrf\"'\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*+)\""
_LANG = r"@([A-Za-z]+(?:-[A-Za-z0-9]+)*)"
_LINE = (
    rf"^[ \t]*(?:{_IRIREF}|{_BLANK})[ \t]*{_IRIREF}[ \t]*"
    rf"(?:{_IRIREF}|{_BLANK}|{_QUOTED}(?:\^\^{_IRIREF}|{_LANG})?)[ \t]*"
    rf"(?:(?:{_IRIREF}|{_BLANK})[ \t]*)?\.[ \t]*(?:#.*)?$"
)
_GROUPS = ("s_iri", "s_label", "p", "o_iri", "o_label", "o_text", "dt", "lang", "g_iri", "g_label")
_IGNORED = r"^[ \t]*(?:#.*)?$"


def format_lines(quads: DataFrame) -> DataFrame:
    """(line): each quad as an N-Quads statement."""
    none = F.lit("")
    parts = [
        n3(F.col("s"), F.col("s_kind"), none, none),
        n3(F.col("p"), F.lit(IRI), none, none),
        n3(F.col("o"), F.col("o_kind"), F.col("o_dt"), F.col("o_lang")),
        n3(F.col("g"), F.lit(IRI), none, none),
        F.lit("."),
    ]
    return quads.select(F.concat_ws(" ", *parts).alias("line"))


def _group(name: str) -> Column:
    return F.get("m", F.lit(_GROUPS.index(name) + 1))


def _present(group: str) -> Column:
    return _group(group) != ""


def _matched(lines: DataFrame) -> DataFrame:
    """line, ok and the groups of the pattern as the array m, with one match of each line.

    The match is replaced by its groups, each after a line feed: no group can hold one, and
    no statement starts with one. The generator keeps later filters and projections from
    repeating the match for each group they look at.
    """
    groups = "".join(f"\n${i + 1}" for i in range(len(_GROUPS))) + "\n"
    found = lines.where(~F.col("line").rlike(_IGNORED)).withColumn(
        "m", F.explode(F.array(F.split(F.regexp_replace("line", _LINE, groups), "\n", -1))))
    return found.withColumn("ok", (F.get("m", F.lit(0)) == "") & ~F.startswith("line", F.lit("\n")))


def parse_lines(lines: DataFrame, graph: str | None = None, scope: Column | str = "") -> DataFrame:
    """Quads of the well-formed lines; comments and empty lines are passed over.

    ``graph`` names the graph of lines that have none (else they are rejected).
    Blank node labels are scoped by graph and ``scope``, for example the file,
    so the same label in two files stays two nodes.
    """
    found = _matched(lines).where("ok")
    g = F.when(_present("g_iri"), unescape(_group("g_iri")))
    g = g.when(_present("g_label"), F.concat(F.lit("_:"), _group("g_label")))
    g = g.otherwise(F.lit(graph)) if graph is not None else g
    scope = F.lit(scope) if isinstance(scope, str) else scope
    found = found.withColumn("g", g).withColumn("scope", scope).where("g IS NOT NULL")

    def label(name: str) -> Column:
        tag = F.substring(F.sha2(F.concat_ws(chr(31), "g", "scope"), 256), 1, 16)
        return F.when(F.col("scope") == "", _group(name)).otherwise(
            F.concat(F.lit("b"), tag, F.lit("-"), _group(name)))

    literal = ~(_present("o_iri") | _present("o_label"))
    lang = F.lower(_group("lang"))
    return found.select(
        "g",
        F.when(_present("s_label"), label("s_label")).otherwise(unescape(_group("s_iri"))).alias("s"),
        F.when(_present("s_label"), BNODE).otherwise(IRI).alias("s_kind"),
        unescape(_group("p")).alias("p"),
        F.when(_present("o_iri"), unescape(_group("o_iri")))
        .when(_present("o_label"), label("o_label")).otherwise(unescape(_group("o_text"))).alias("o"),
        F.when(_present("o_iri"), IRI).when(_present("o_label"), BNODE).otherwise(LITERAL).alias("o_kind"),
        F.when(~literal, "").when(lang != "", LANG_STRING)
        .when(_present("dt"), unescape(_group("dt"))).otherwise(XSD_STRING).alias("o_dt"),
        F.when(literal, lang).otherwise("").alias("o_lang"),
    ).select(*QUAD)


def rejected_lines(lines: DataFrame, graph: str | None = None) -> DataFrame:
    """The lines ``parse_lines`` leaves out because they are malformed or have no graph."""
    found = _matched(lines)
    good = F.col("ok")
    if graph is None:
        good = good & (_present("g_iri") | _present("g_label"))
    return found.where(~good).select("line")


def read_nquads(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    """Quads of text files, blank nodes scoped by file, each quad once."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), "_metadata.file_path")
    return parse_lines(lines, graph, F.col("file_path")).dropDuplicates()


def read_rejects(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    return rejected_lines(spark.read.text(path).withColumnRenamed("value", "line"), graph)


def write_nquads(quads: DataFrame, path: str, mode: str = "errorifexists") -> None:
    format_lines(quads).write.mode(mode).text(path)
