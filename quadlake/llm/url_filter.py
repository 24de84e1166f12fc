"""URL rules found by their rarest literal token.

A rule is a regular expression over host and path, with the literal tokens that every
match contains. It is indexed by the one of its tokens that the fewest URLs have; a rule
whose matches contain one of several tokens is indexed by each of those. The tokens of a URL fetch the rules indexed by them, and only those expressions run. A rule
without a literal token is indexed by the empty token, which every URL has.

Only distinct (host, path) pairs are judged. A null URL, or one without "://", has an
empty host and path and matches no rule; such rows are spread by their ids when verdicts are
joined. Very long URLs are judged whole. An empty table gives an empty result. Repeated rows
and null ids give a row each; columns other than those named are not read. Rules come from
the caller as a list or as a frame (``RULE_ROWS``); a table of any length will do, since the
index is joined, not broadcast by force.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.llm.tables import constant_rows


@dataclass(frozen=True)
class Rule:
    rule: str  # as it is reported, empty for a pattern of the method
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    rank: int  # among rules that match, the highest decides
    either: tuple[str, ...] = ()  # every match contains at least one of these


def prefix_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host, its subdomains and a path that starts with ``path``."""
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    # The last part of the path may be cut short, so it is no whole token of the URL.
    whole = path[:path.rfind("/") + 1]
    tokens = [t for t in re.split(r"[^a-z0-9]+", f"{host}{whole}".lower()) if t]
    return Rule(host + path, pattern, tuple(tokens), verdict, 1_000_000 + len(host + path))


def pattern_rule(pattern: str, tokens: Iterable[str], verdict: str, either: Iterable[str] = ()) -> Rule:
    """A pattern of the method itself: it decides where no prefix rule does."""
    return Rule("", pattern, tuple(tokens), verdict, 0, tuple(either))


# The rules of the query.
HOST_RULES = [
    prefix_rule("org", "/", "allow"),
    prefix_rule("example.org", "/es/", "block"),
    prefix_rule("example.org", "/en/1", "block"),
    prefix_rule("com", "/fr/", "allow"),
    prefix_rule("com", "/de/", "block"),
]
# Words of the host; neither a path nor a slash after the host is needed.
METHOD_RULES = [
    pattern_rule(r"^(?:[^/]*[.-])?casino[.-]", ["casino"], "block"),
    pattern_rule(r"^(?:[^/]*[.-])?bets?[.-]", (), "block", either=["bet", "bets"]),
    pattern_rule(r"^(?:[^/]*[.-])?pills[.-]", ["pills"], "block"),
    pattern_rule(r"^(?:[^/]*[.-])?ads-track[.-]", ["ads", "track"], "block"),
]
DEFAULT = "allow"

# A frame of rules: of equal ranks the smallest rule_id decides.
RULE_ROWS = ("rule_id long, rule string, pattern string, verdict string, rank int, "
             "tokens array<string>, either array<string>")
# Rows with an empty host are spread over so many groups.
SPREAD = 1024


def host_of(url: Column) -> Column:
    """What lies between the first :// and /, ?, # or the end, with A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(host: Column, path: Column) -> Column:
    """The distinct runs of letters and digits, and the empty token."""
    return F.array_distinct(F.split(F.lower(F.concat(host, path, F.lit("/"))), "[^a-z0-9]+"))


def rule_rows(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """A list of rules as a frame; earlier rules come first among equal ranks."""
    rows = [(k, r.rule, r.pattern, r.verdict, r.rank, list(r.tokens), list(r.either)) for k, r in enumerate(rules)]
    return constant_rows(spark, rows, RULE_ROWS)


def rule_index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Rules with the tokens that fetch them: the rarest of its tokens among the given
    URLs' tokens, else each of its alternatives, else the empty token."""
    needed, either = (F.coalesce(c, F.array().cast("array<string>")) for c in ("tokens", "either"))
    lists = rules.select("rule_id", F.transform(needed, F.lower).alias("needed"), F.transform(either, F.lower).alias("either"))
    fixed = lists.where(F.size("needed") > 0).select("rule_id", F.explode("needed").alias("token"))
    # Only tokens of rules are counted.
    counts = (urls.select(F.explode("tokens").alias("token"))
              .join(fixed.select("token").distinct(), "token", "left_semi").groupBy("token").count())
    rarest = (fixed.join(counts, "token", "left").groupBy("rule_id")
              .agg(F.min(F.struct(F.coalesce("count", F.lit(0)), "token")).alias("least"))
              .select("rule_id", F.col("least.token").alias("token")))
    other = lists.where(F.size("needed") == 0).select("rule_id", F.explode(
        F.when(F.size("either") > 0, F.array_distinct("either")).otherwise(F.array(F.lit("")))).alias("token"))
    return rules.select("rule_id", "rule", "pattern", "verdict", "rank").join(rarest.unionByName(other), "rule_id")


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, default: str = DEFAULT, key: str = "page_id") -> DataFrame:
    """Host, path, deciding rule and verdict of the URL of each page. Rules are a list, or a
    frame with the columns of ``RULE_ROWS`` whose rule_id is unique."""
    parsed = pages.select(F.col(key), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = parsed.select("host", "path").distinct().withColumn("tokens", tokens_of(F.col("host"), F.col("path")))
    index = rule_index(rules if isinstance(rules, DataFrame) else rule_rows(pages.sparkSession, rules), urls)
    # F.rlike takes the pattern as a column: it runs for fetched rules only.
    matched = (urls.select("host", "path", F.explode("tokens").alias("token")).join(index, "token")
               .where((F.col("host") != "") & F.rlike(F.concat("host", "path"), F.col("pattern")))
               .groupBy("host", "path")
               .agg(F.max(F.struct("rank", (-F.col("rule_id")).alias("first"), "rule", "verdict")).alias("best"))
               .select("host", "path", "best.rule", "best.verdict", F.lit(0).cast("long").alias("__spread")))
    # No rule matches an empty host, so its rows need not meet in one group.
    spread = F.when(F.col("host") == "", F.pmod(F.xxhash64(key), F.lit(SPREAD)) + 1).otherwise(0)
    return (parsed.withColumn("__spread", spread).join(matched, ["host", "path", "__spread"], "left")
            .select(key, "host", "path", F.when(F.col("rule") != "", F.col("rule")).alias("rule"),
                    F.coalesce("verdict", F.lit(default)).alias("verdict")))
