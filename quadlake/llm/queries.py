"""The registered queries of the operators, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadlake.llm import (
    chat, exact_dedup, hard_negatives, jaccard, language_id, mixing, packing, quality, token_counts, token_files, toxicity,
    url_filter, vector_codes,
)
from quadlake.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_index(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.HOST_RULES + url_filter.METHOD_RULES)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_edited(token_counts.build_trees(table(spark, sf_dir, "documents")))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"), most=None).selectExpr(
        "doc_id", "source", "__block AS block", "__slot AS slot", "__place AS place", "__in_mix AS in_mix")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.write_conversations(chat.with_hostile(table(spark, sf_dir, "conversations"))))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_token_files, op2_url_filter, op3_token_counts, op4_ngram_jaccard_join, op5_exact_dedup, op6_packing,
    op7_toxicity, op8_mixing, op9_chat_formatting, op10_quality_rules, op11_hard_negatives,
    op12_vector_codes, op13_language_id)}

_RULES = ", ".join(
    f"('{r.rule}', '{host}', '{path}', '{r.verdict}', {r.rank})"
    for r, (host, path) in ((r, r.rule.split("/", 1)) for r in url_filter.HOST_RULES))
_METHOD = " OR ".join(f"regexp_matches(host || path, '{r.pattern}')" for r in url_filter.METHOD_RULES)

def _code_sql(n_parts: int = 4, n_entries: int = 256, rounds: int = 4) -> str:
    """Plain rounds over all entries, for tables of one width that fills all parts."""
    nearest = """SELECT row, part, min(d * 256 + entry) AS best FROM (
        SELECT x.row, x.part, b.entry, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM pieces x JOIN book{k} b ON x.part = b.part) GROUP BY ALL"""
    text = f"""WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label,
            list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
        FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pieces AS MATERIALIZED (SELECT row, part::INT AS part, v[part * len(v) // {n_parts} + 1 : (part + 1) * len(v) // {n_parts}] AS v
            FROM kept, range({n_parts}) p(part)),
        book0 AS MATERIALIZED (SELECT part, (row - 1)::INT AS entry, v FROM pieces WHERE row <= {n_entries})"""
    for k in range(rounds):
        text += f""",
        near{k} AS MATERIALIZED ({nearest.format(k=k)}),
        means{k} AS (SELECT part, entry, list(mean ORDER BY place) AS v FROM (
            SELECT part, entry, place, floor(sum(c)::DOUBLE / count(*))::BIGINT AS mean
            FROM (SELECT n.part, (n.best % 256)::INT AS entry, unnest(x.v) AS c, unnest(range(len(x.v))) AS place
                  FROM near{k} n JOIN pieces x USING (row, part)) GROUP BY ALL) GROUP BY ALL),
        book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN means{k} m USING (part, entry))"""
    return text + f""",
        coded AS (SELECT row, string_agg(lpad(lower(to_hex(best % 256)), 2, '0'), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error
            FROM ({nearest.format(k=rounds)}) GROUP BY row)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
            (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
        FROM coded JOIN kept USING (row)"""


ORACLE: dict[str, str] = {
    "op11_hard_negatives": """
        WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id,
                CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scores AS MATERIALIZED (SELECT a.row, a.vec_id AS anchor_id, x.vec_id AS id, a.label = x.label AS same, x.row AS other,
                list_inner_product(a.v, x.v)::BIGINT AS score
            FROM kept a JOIN kept x ON a.vec_id % 100 = 0 AND a.row <> x.row),
        positives AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, id, other) AS r FROM scores WHERE same QUALIFY r <= 5),
        negatives AS (SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
                row_number() OVER (PARTITION BY p.row, p.other ORDER BY n.score DESC, n.id, n.other) AS rank
            FROM positives p JOIN scores n ON p.row = n.row AND NOT n.same
                AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
        SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5""",
    "op12_vector_codes": _code_sql(),
    "op2_url_filter": f"""
        WITH rules(rule, rule_host, rule_path, rule_verdict, n) AS (VALUES {_RULES}),
        parsed AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id,
            translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parsed),
        best AS (SELECT page_id, host, path, arg_max(rule, n) AS rule, arg_max(rule_verdict, n) AS verdict
            FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, '/' || rule_path)
            GROUP BY ALL)
        SELECT page_id, host, path, rule,
            coalesce(verdict, CASE WHEN {_METHOD} THEN 'block' ELSE '{url_filter.DEFAULT}' END) AS verdict
        FROM best""",
    "op5_exact_dedup": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text,
            sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]', '', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
            row_number() OVER w = 1 AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id)""",
    "op4_ngram_jaccard_join": r"""
        WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w
            FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
        grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
        pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS o
            FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT x, y FROM pairs WHERE 100 * o >= 85 * (nx + ny - o)),
        both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(y) FROM reach WHERE x = doc_id) AS component_id FROM sets""",
}
