"""One SQL statement per registered query, written apart from the DataFrame code."""

from oracle.fixture import with_both, with_jobs, with_quads
from quadlake.spec import CLASSES, RULES
from quadlake.vocab import (
    ADMS, BUSY, CLASS_SUMMARY_PREFIX, COGS, CONTAINER_PREFIX, COVERAGE_JOB, COVERAGE_OPERATION,
    COVERAGE_REPORT, DCAT, DCT, EXT, FAILED, FOAF, JOB_PREFIX, JOBS_GRAPH, MU, NFO, PUBLIC_GRAPH,
    RDF, REQUEST_PREFIX, RESULT_GRAPH_PREFIX, RESULT_PREFIX, RULE_SUMMARY_PREFIX, SCHEDULED, SH,
    SHV, SKOLEM_BASE, STATUS_PREFIX, SUMMARY_PREFIX, TASK, TASK_PREFIX, VALIDATION_OPERATION, XSD,
)

TYPE = RDF + "type"
TITLE = DCT + "title"
STR, INT, TIME = XSD + "string", XSD + "integer", XSD + "dateTime"
R1 = "urn:g:region:1"
OBJ = "o, o_kind, o_dt, o_lang"
FOUR = ", ".join(f"'{c}'" for c in CLASSES)
OPS = f"'{COVERAGE_OPERATION}', '{VALIDATION_OPERATION}'"
US = "chr(31)"

ORACLE: dict[str, str] = {}


def q(name: str, sql: str) -> None:
    ORACLE[name] = with_quads(sql)


def j(name: str, sql: str) -> None:
    ORACLE[name] = with_jobs(sql)


def sha(*parts: str) -> str:
    return f"sha256(concat_ws({US}, {', '.join(f'coalesce({p}, chr(30))' for p in parts)}))"


# -- scans -----------------------------------------------------------------

q("scan_graph", f"SELECT s, s_kind, p, {OBJ} FROM quads WHERE g = '{R1}'")
q("scan_any_graph", f"SELECT g, s, s_kind, {OBJ} FROM quads WHERE p = '{TYPE}'")
q("pattern_s__", f"SELECT p, {OBJ} FROM quads WHERE g = '{R1}' AND s = 'urn:x:catalog:1'")
q("pattern__p_", f"SELECT s, s_kind, {OBJ} FROM quads WHERE g = '{R1}' AND p = '{TITLE}'")
q("pattern___o", f"SELECT s, s_kind, p FROM quads WHERE g = '{R1}' AND o = '{DCAT}Distribution' AND o_kind = 'iri'")
q("pattern_sp_", f"SELECT {OBJ} FROM quads WHERE g = '{R1}' AND s = 'urn:x:catalog:1' AND p = '{DCAT}dataset'")
q("pattern_s_o", f"SELECT p FROM quads WHERE g = '{R1}' AND s = 'urn:x:catalog:1' AND o = 'NATION_1' AND o_dt = '{STR}'")
q("pattern__po", f"SELECT DISTINCT s, s_kind FROM quads WHERE p = '{TYPE}' AND o = '{DCAT}Distribution'")
q("pattern_all", f"SELECT s, s_kind, p, {OBJ} FROM quads WHERE g = '{R1}'")
q("ask_spo", f"SELECT count(*) > 0 AS found FROM quads WHERE g = '{R1}' AND s = 'urn:x:catalog:1' "
             f"AND p = '{TYPE}' AND o = '{DCAT}Catalog'")
q("scan_default", f"SELECT DISTINCT s, s_kind, p, {OBJ} FROM quads")
q("graph_size", "SELECT g, count(*) AS triples FROM quads GROUP BY g")
q("default_size", f"SELECT count(*) AS triples FROM (SELECT DISTINCT s, s_kind, p, {OBJ} FROM quads)")
q("scan_ordered", f"SELECT DISTINCT s, s_kind, {OBJ} FROM quads WHERE p = '{TITLE}' ORDER BY s, o")
q("scan_page", f"SELECT s, s_kind, {OBJ} FROM quads WHERE g = '{R1}' AND p = '{TITLE}' ORDER BY s, o LIMIT 50 OFFSET 100")
q("scan_after", f"SELECT s, s_kind, {OBJ} FROM quads WHERE g = '{R1}' AND p = '{TITLE}' AND s >= 'urn:x:dataset:5' "
                "ORDER BY s, o LIMIT 50")
q("scan_offset", f"SELECT s, s_kind, p, {OBJ} FROM quads ORDER BY s, s_kind, p, o, o_kind, o_dt, o_lang OFFSET 1000")
q("ingest_nquads", "SELECT * FROM quads")

LINE = f"""'<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'iri' THEN '<' || o || '>'
  WHEN o_lang <> '' THEN '"' || o || '"@' || o_lang
  WHEN o_dt = '{STR}' THEN '"' || o || '"' ELSE '"' || o || '"^^<' || o_dt || '>' END || ' <' || g || '> .'"""
q("format_nquads", f"SELECT {LINE} AS line FROM quads")
q("ingest_rejects", r"""
, lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT line, count(*) AS times FROM lines
WHERE NOT regexp_full_match(line, '[ \t]*(#[^\n]*)?')
  AND NOT regexp_full_match(line, '[ \t]*(<[^<> ]+>|_:[^ ]+)[ \t]*<[^<> ]+>[ \t]*(<[^<> ]+>|_:[^ ]+|"[^"]*"[^ ]*)[ \t]*<[^<> ]+>[ \t]*[.][ \t]*')
GROUP BY line""")
q("store_graph", f"""SELECT DISTINCT '{R1}' AS g, s, s_kind, p, {OBJ} FROM quads
EXCEPT SELECT * FROM quads""")
q("bucket_store", f"SELECT DISTINCT '{R1}' AS g, s, s_kind, p, {OBJ} FROM quads")
q("batch_ids", f"""SELECT g, s, p, o, n // 100 AS batch, (n // 100 + 1) * 100 <= total AS complete FROM (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY s, s_kind, p, o, o_kind, o_dt, o_lang) - 1 AS n,
         count(*) OVER (PARTITION BY g) AS total FROM quads)""")
j("record_from_quads", f"""SELECT g, s AS uri, min(o) FILTER (p = '{MU}uuid') AS id,
  min(o) FILTER (p = '{DCT}created') AS created,
  coalesce(min(o) FILTER (p = '{ADMS}status'), 'none') AS status,
  coalesce(min(o) FILTER (p = '{EXT}headers'), '{{}}') AS headers, 'quads' AS source
FROM jobs WHERE p IN ('{MU}uuid', '{DCT}created', '{ADMS}status', '{EXT}headers') GROUP BY g, s""")
ORACLE["record_to_quads"] = f"""
WITH c AS (SELECT 'urn:x:part:' || c_custkey AS s, * FROM customer)
SELECT 'urn:g:parts' AS g, s, 'iri' AS s_kind, '{TYPE}' AS p, '{FOAF}Agent' AS o, 'iri' AS o_kind, '' AS o_dt, '' AS o_lang FROM c
UNION ALL SELECT 'urn:g:parts', s, 'iri', '{FOAF}name', c_name, 'literal', '{STR}', '' FROM c
UNION ALL SELECT 'urn:g:parts', s, 'iri', '{DCT}subject', c_mktsegment, 'literal', '{STR}', '' FROM c WHERE c_acctbal > 0"""

# -- filters and joins -----------------------------------------------------

q("entities_of_class", f"SELECT g, s FROM quads WHERE p = '{TYPE}' AND o = '{DCAT}Dataset'")
q("values_filter", f"SELECT g, s, p, o FROM quads WHERE p IN ('{TITLE}', '{DCT}format', '{DCAT}Distribution')")
j("scheduled_tasks", f"SELECT g, s AS task FROM jobs WHERE p = '{ADMS}status' AND o = '{SCHEDULED}'")
q("class_properties", f""", typed AS MATERIALIZED (SELECT g, s, o AS class FROM quads WHERE p = '{TYPE}' AND o IN ({FOUR}))
SELECT a.g, a.s, a.class, b.p, b.o FROM typed a JOIN quads b ON a.g = b.g AND a.s = b.s""")

STAR = f"""SELECT t.g, t.s, c.o AS created, st.o AS status, op.o AS operation, u.o AS id
FROM jobs t JOIN jobs c ON t.g = c.g AND t.s = c.s JOIN jobs st ON t.g = st.g AND t.s = st.s
JOIN jobs op ON t.g = op.g AND t.s = op.s JOIN jobs u ON t.g = u.g AND t.s = u.s
WHERE t.p = '{TYPE}' AND t.o = '{TASK}Task' AND c.p = '{DCT}created' AND st.p = '{ADMS}status'
  AND op.p = '{TASK}operation' AND u.p = '{MU}uuid'"""
j("task_star", STAR)
INPUTS = f"""SELECT a.g, a.s, b.o AS input FROM jobs a JOIN jobs b ON a.g = b.g AND a.o = b.s
WHERE a.p = '{TASK}inputContainer' AND b.p = '{EXT}content'"""
JOB_OPS = f"""SELECT a.g, a.s, b.o AS job_operation FROM jobs a JOIN jobs b ON a.g = b.g AND a.o = b.s
WHERE a.p = '{DCT}isPartOf' AND b.p = '{TASK}operation'"""
HEADERS = f"SELECT g, s, o AS headers FROM jobs WHERE p = '{EXT}headers'"
ACTIONABLE = f"""SELECT g, s AS uri, id, created, input, operation, job_operation, headers
FROM ({STAR}) LEFT JOIN ({INPUTS}) USING (g, s) LEFT JOIN ({JOB_OPS}) USING (g, s) LEFT JOIN ({HEADERS}) USING (g, s)
WHERE status = '{SCHEDULED}' AND operation IN ({OPS})"""
j("actionable_tasks", ACTIONABLE)
j("next_task", f"SELECT * FROM ({ACTIONABLE}) ORDER BY created, uri LIMIT 1")


def one(p: str) -> str:
    return f"min(o) FILTER (p = '{p}')"


j("tasks", f"""
, t AS (SELECT g, s AS uri, {one(MU + 'uuid')} AS id, {one(DCT + 'created')} AS created,
    {one(DCT + 'modified')} AS modified, {one(ADMS + 'status')} AS status, {one(TASK + 'operation')} AS operation,
    {one(DCT + 'isPartOf')} AS job, {one(TASK + 'index')} AS "index", {one(EXT + 'headers')} AS h
  FROM jobs WHERE s LIKE 'urn:x:task:%' GROUP BY g, s)
SELECT t.g, uri, id, created, modified, status, operation, job, job_operation, input, "index",
  json_extract_string(h, '$.user') AS "user"
FROM t LEFT JOIN ({INPUTS}) i ON i.s = uri LEFT JOIN ({JOB_OPS}) o ON o.s = uri""")
j("task_endpoint", f"""SELECT a.g, a.s AS task, min(b.o) AS url FROM jobs a JOIN jobs b ON a.g = b.g AND a.o = b.s
WHERE a.p = '{DCT}isPartOf' AND b.p = '{EXT}endpointUrl' GROUP BY 1, 2""")
j("task_job", f"""SELECT a.g, a.s AS task, a.o AS job FROM jobs a WHERE a.p = '{DCT}isPartOf'
AND EXISTS (FROM jobs t WHERE t.g = a.g AND t.s = a.s AND t.p = '{TYPE}' AND t.o = '{TASK}Task')
AND EXISTS (FROM jobs t WHERE t.g = a.g AND t.s = a.o AND t.p = '{TYPE}' AND t.o = '{COGS}Job')""")
q("path_sequence", f"""SELECT a.g, a.s, b.o FROM quads a JOIN quads b ON a.g = b.g AND a.o = b.s
WHERE a.p = '{DCAT}dataset' AND b.p = '{DCAT}distribution'""")
j("optional_pattern", f"""SELECT a.g, a.s, headers FROM jobs a LEFT JOIN ({HEADERS}) USING (g, s)
WHERE a.p = '{TYPE}' AND a.o = '{TASK}Task'""")
GRAPHS = f"""SELECT r.g, r.s AS input, d.o AS data_graph FROM jobs r JOIN jobs d ON r.g = d.g AND r.s = d.s
WHERE r.p = '{TYPE}' AND r.o = '{EXT}DCATValidationRequest' AND d.p = '{EXT}dataGraph'"""
j("validation_requests", GRAPHS)
INPUT_GRAPH = f"""SELECT g, input, min(data_graph) AS data_graph FROM ({GRAPHS} UNION ALL
SELECT r.g, r.s, d.o FROM jobs r JOIN jobs v ON r.g = v.g AND r.s = v.s JOIN jobs d ON d.g = v.g AND d.s = v.o
WHERE r.p = '{TYPE}' AND r.o = '{EXT}ShaclValidationResult' AND v.p = '{EXT}validated' AND d.p = '{EXT}dataGraph')
GROUP BY 1, 2"""
j("data_graph_of_input", INPUT_GRAPH)

# -- counts and checks -----------------------------------------------------

ENTITIES = f"SELECT g, o AS class, count(DISTINCT s) AS entities FROM quads WHERE p = '{TYPE}' AND o IN ({FOUR}) GROUP BY 1, 2"
q("count_entities", ENTITIES)
PROPS = f"""SELECT t.g, t.o AS class, x.p AS property, count(DISTINCT t.s) AS entities
FROM quads t JOIN quads x ON t.g = x.g AND t.s = x.s
WHERE t.p = '{TYPE}' AND t.o IN ({FOUR}) AND x.p IN (SELECT property FROM spec) GROUP BY 1, 2, 3"""
q("count_with_property", PROPS)


def coverage(graphs: str) -> str:
    return f"""SELECT gr.g, sp.class, sp.requirement, sp.property, sp.severity,
  coalesce(e.entities, 0) AS total_entities, coalesce(w.entities, 0) AS entities_with_property,
  greatest(0, coalesce(e.entities, 0) - coalesce(w.entities, 0)) AS violation_count
FROM ({graphs}) gr CROSS JOIN spec sp
LEFT JOIN ({ENTITIES}) e ON e.g = gr.g AND e.class = sp.class
LEFT JOIN ({PROPS}) w ON w.g = gr.g AND w.class = sp.class AND w.property = sp.property"""


COVERAGE = coverage("SELECT DISTINCT g FROM quads")
q("coverage", COVERAGE)
q("coverage_standing", f", later AS MATERIALIZED (SELECT * FROM quads WHERE p <> '{DCT}license')\n" + COVERAGE.replace("quads", "later"))
q("coverage_total", f"SELECT g, CAST(sum(violation_count) AS BIGINT) AS total_violations FROM ({COVERAGE}) GROUP BY g")
q("severity_lookup", f"SELECT severity, CAST(sum(violation_count) AS BIGINT) AS violations FROM ({COVERAGE}) GROUP BY 1")
q("coverage_nested", f"""
, c AS ({COVERAGE}),
k AS (SELECT g, class, CAST(sum(violation_count) AS BIGINT) AS v,
  '{{"class_uri":"' || class || '","total_entities":' || max(total_entities) || ',"rule_violations":[' ||
  string_agg('{{"property_uri":"' || property || '","requirement":"' || requirement || '","entities_with_property":'
    || entities_with_property || ',"total_entities":' || total_entities || ',"violation_count":' || violation_count || '}}',
    ',' ORDER BY property, requirement) || ']}}' AS body FROM c GROUP BY g, class)
SELECT g, CAST(sum(v) AS BIGINT) AS total_violations, '[' || string_agg(body, ',' ORDER BY class) || ']' AS class_coverages
FROM k GROUP BY g""")
TYPES = f"""SELECT g, s AS uri, string_agg(DISTINCT o, ',' ORDER BY o) AS types, count(DISTINCT o) AS n
FROM quads WHERE p = '{TYPE}' AND o IN ({FOUR}) GROUP BY g, s"""
q("uri_reuse", f"SELECT g, uri, types FROM ({TYPES}) WHERE n > 1")
q("group_concat_types", f"SELECT g, uri, types FROM ({TYPES})")
q("capitalization_typos", f"""SELECT g, p AS typo, CASE p WHEN '{DCAT}Dataset' THEN '{DCAT}dataset'
  WHEN '{DCAT}Distribution' THEN '{DCAT}distribution' ELSE '{DCAT}record' END AS intended, count(*) AS count
FROM quads WHERE p IN ('{DCAT}Dataset', '{DCAT}Distribution', '{DCAT}CatalogRecord') GROUP BY g, p""")
q("skolemize", f"""SELECT g, CASE WHEN s LIKE 'urn:x:record:%' THEN '{SKOLEM_BASE}' || sha256(g) || '-' || s ELSE s END AS s,
  s_kind, p, CASE WHEN o LIKE 'urn:x:record:%' THEN '{SKOLEM_BASE}' || sha256(g) || '-' || o ELSE o END AS o,
  o_kind, o_dt, o_lang FROM quads""")
j("undef_fill", f"""SELECT a.g, a.s, coalesce(headers, 'urn:undef:headers') AS headers
FROM jobs a LEFT JOIN ({HEADERS}) USING (g, s) WHERE a.p = '{MU}uuid'""")

# -- writing ---------------------------------------------------------------


def triples(graph: str, source: str, *rows: tuple) -> str:
    """UNION ALL of (subject, predicate, object, datatype or '' for an IRI) over a source."""
    parts = []
    for s, p, o, dt in rows:
        kind = "literal" if dt else "iri"
        parts.append(f"SELECT {graph} AS g, {s} AS s, 'iri' AS s_kind, '{p}' AS p, CAST({o} AS VARCHAR) AS o, "
                     f"'{kind}' AS o_kind, '{dt}' AS o_dt, '' AS o_lang FROM {source} WHERE ({o}) IS NOT NULL")
    return " UNION ALL ".join(parts)


def union(*parts: str) -> str:
    return " UNION ALL ".join(parts)


PUB = f"'{PUBLIC_GRAPH}'"
JG = f"'{JOBS_GRAPH}'"
RUN = "'run-1'"
S_ID, C_ID = sha(RUN, "g"), sha(RUN, "g", "class")
S_URI, C_URI = f"'{SUMMARY_PREFIX}' || {S_ID}", f"'{CLASS_SUMMARY_PREFIX}' || {C_ID}"
CR_ID = sha(RUN, "g", "class", "requirement", "property")
CR_URI = f"'{RULE_SUMMARY_PREFIX}' || {CR_ID}"


def class_rows(entities: str) -> tuple:
    return ((S_URI, SHV + "hasTargetClassSummary", C_URI, ""), (C_URI, TYPE, f"'{SHV}TargetClassSummary'", ""),
            (C_URI, MU + "uuid", C_ID, STR), (C_URI, SHV + "hasTargetClass", "class", ""),
            (C_URI, SHV + "resourceCount", entities, INT))


q("coverage_summary_quads", f", c AS MATERIALIZED ({COVERAGE}) " + union(
    triples(PUB, "(SELECT g, sum(violation_count) AS total FROM c GROUP BY g)",
            (S_URI, TYPE, f"'{SHV}ValidationSummary'", ""), (S_URI, MU + "uuid", S_ID, STR),
            (S_URI, EXT + "endpointUrl", "CASE WHEN g LIKE '%0' THEN 'http://example.org/sparql/0' END", STR),
            (S_URI, SHV + "totalViolations", "total", INT)),
    triples(PUB, "(SELECT DISTINCT g, class, total_entities FROM c)", *class_rows("total_entities")),
    triples(PUB, "c", (C_URI, SHV + "hasRuleSummary", CR_URI, ""), (CR_URI, TYPE, f"'{SHV}RuleSummary'", ""),
            (CR_URI, MU + "uuid", CR_ID, STR), (CR_URI, SHV + "violationCount", "violation_count", INT),
            (CR_URI, SHV + "hasSeverity", "severity", ""), (CR_URI, SHV + "hasRuleConstraint", "property", ""))))

RESULTS = f"""SELECT DISTINCT s AS task, 'urn:x:report:' || x || ':' || s AS result FROM jobs, (VALUES ('a'), ('b')) v(x)
WHERE p = '{TASK}operation' AND o IN ({OPS}) AND g = {JG}
AND s IN (SELECT s FROM jobs WHERE p = '{TYPE}' AND o = '{TASK}Task')"""
K_ID = sha(RUN, "task")
K_URI = f"'{CONTAINER_PREFIX}' || {K_ID}"
j("attach_results", f", r AS ({RESULTS}) " + union(
    triples(JG, "(SELECT DISTINCT task FROM r)", ("task", TASK + "resultsContainer", K_URI, ""),
            (K_URI, TYPE, f"'{NFO}DataContainer'", ""), (K_URI, MU + "uuid", K_ID, STR)),
    triples(JG, "r", (K_URI, EXT + "content", "result", ""))))
j("link_report", f", r AS (SELECT * FROM ({RESULTS}) JOIN (SELECT s AS task, o AS job FROM jobs WHERE p = '{DCT}isPartOf') USING (task)) "
  + triples(JG, "r", ("job", COVERAGE_REPORT, f"'{SUMMARY_PREFIX}' || {sha('result')}", "")))
j("request_quads", f", r AS (SELECT sha256(input) AS id, '{REQUEST_PREFIX}' || sha256(input) AS u, data_graph FROM ({GRAPHS})) "
  + triples(PUB, "r", ("u", TYPE, f"'{EXT}DCATValidationRequest'", ""), ("u", MU + "uuid", "id", STR),
            ("u", EXT + "dataGraph", "data_graph", "")))
NOW = "'2024-02-01T00:00:00'"
B_ID, L_ID = sha("'container'", "id"), sha("'job'", "id")
B_URI, L_URI, T_URI = f"'{CONTAINER_PREFIX}' || {B_ID}", f"'{JOB_PREFIX}' || {L_ID}", f"'{TASK_PREFIX}' || id"
ORACLE["task_insert_quads"] = (
    "WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS id, 'urn:x:request:' || (c_custkey % 5) AS input, "
    """CASE WHEN c_custkey % 2 = 0 THEN '{"segment":"' || c_mktsegment || '"}' END AS headers FROM customer) """
    + triples(
        JG, "c", (B_URI, TYPE, f"'{NFO}DataContainer'", ""), (B_URI, MU + "uuid", B_ID, STR),
        (B_URI, EXT + "content", "input", ""), (L_URI, TYPE, f"'{COGS}Job'", ""), (L_URI, MU + "uuid", L_ID, STR),
        (L_URI, DCT + "created", NOW, TIME), (L_URI, DCT + "modified", NOW, TIME), (L_URI, DCT + "creator", "'empty'", STR),
        (L_URI, TASK + "operation", f"'{COVERAGE_JOB}'", ""), (L_URI, ADMS + "status", f"'{SCHEDULED}'", ""),
        (T_URI, TYPE, f"'{TASK}Task'", ""), (T_URI, EXT + "headers", "headers", STR), (T_URI, MU + "uuid", "id", STR),
        (T_URI, DCT + "created", NOW, TIME), (T_URI, DCT + "modified", NOW, TIME), (T_URI, TASK + "index", "'0'", STR),
        (T_URI, DCT + "isPartOf", L_URI, ""), (T_URI, TASK + "inputContainer", B_URI, ""),
        (T_URI, TASK + "operation", f"'{COVERAGE_OPERATION}'", ""), (T_URI, ADMS + "status", f"'{SCHEDULED}'", "")))
j("update_status", f"""
, n AS (SELECT s, '{FAILED}' AS status, '2024-02-01T01:00:00' AS moved FROM jobs WHERE p = '{TASK}operation' AND o = '{COVERAGE_OPERATION}'
  UNION ALL SELECT s, '{BUSY}', {NOW} FROM jobs WHERE p = '{ADMS}status' AND o = '{SCHEDULED}'
    AND s NOT IN (SELECT s FROM jobs WHERE p = '{TASK}operation' AND o = '{COVERAGE_OPERATION}')),
m AS (SELECT * FROM n WHERE s IN (SELECT s FROM jobs WHERE p = '{ADMS}status'))
SELECT * FROM jobs WHERE NOT (p IN ('{ADMS}status', '{DCT}modified') AND s IN (SELECT s FROM m))
UNION ALL """ + triples(JG, "m", ("s", ADMS + "status", "status", ""), ("s", DCT + "modified", "moved", TIME)))
ORACLE["stored_status"] = ORACLE["update_status"]
j("template_insert", f""", f AS (SELECT a.s, a.o AS status, headers, input FROM jobs a LEFT JOIN ({HEADERS}) USING (g, s)
  LEFT JOIN ({INPUTS}) USING (g, s) WHERE a.p = '{ADMS}status') """ + triples(
    PUB, "f", ("s", ADMS + "status", "status", ""), ("s", EXT + "headers", "headers", STR), ("s", EXT + "content", "input", "")))

# -- change feed -----------------------------------------------------------

_S = f"CASE event_type WHEN 'signup' THEN 'scheduled' WHEN 'view' THEN 'busy' WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' END"
ORACLE["delta_inserts"] = f"""SELECT event_id // 16 AS message_id, 'urn:x:task:' || user_id AS s,
  CASE WHEN event_type = 'click' THEN '{EXT}clicked' ELSE '{ADMS}status' END AS p,
  CASE WHEN event_type = 'click' THEN CAST(event_id AS VARCHAR) ELSE '{STATUS_PREFIX}' || {_S} END AS o FROM events"""
ORACLE["delta_has_task"] = "SELECT event_id // 16 AS message_id, bool_or(event_type = 'signup') AS accepted FROM events GROUP BY 1"
DUE = f"""SELECT DISTINCT a.uri AS task, a.operation, a.input, d.data_graph FROM ({ACTIONABLE}) a
LEFT JOIN ({INPUT_GRAPH}) d ON d.input = a.input"""
ORACLE["delta_coverage"] = with_both(coverage(
    f"SELECT DISTINCT data_graph AS g FROM ({DUE}) WHERE operation = '{COVERAGE_OPERATION}' AND task IN "
    "(SELECT 'urn:x:task:' || user_id FROM events WHERE event_type = 'signup')"))
j("task_latest_status", "SELECT task, status FROM changes QUALIFY row_number() OVER (PARTITION BY task ORDER BY ts DESC, id DESC) = 1")
j("task_illegal_moves", f"""SELECT task, id, previous, status FROM (
  SELECT *, lag(status) OVER (PARTITION BY task ORDER BY ts, id) AS previous FROM changes)
WHERE NOT ((previous IS NULL AND status = '{SCHEDULED}') OR coalesce((previous, status) IN (('{SCHEDULED}', '{BUSY}'),
  ('{BUSY}', '{STATUS_PREFIX}success'), ('{BUSY}', '{STATUS_PREFIX}failed')), FALSE))""")
ORACLE["task_illegal_stream"] = ORACLE["task_illegal_moves"]

# -- validation ------------------------------------------------------------

VIOLATION, WARNING, INFO = SH + "Violation", SH + "Warning", SH + "Info"
CAT, SET, DIST, REC, DOC = DCAT + "Catalog", DCAT + "Dataset", DCAT + "Distribution", DCAT + "CatalogRecord", FOAF + "Document"
ISSUED, MOD, SIZE, LICENSE, RIGHTS = DCT + "issued", DCT + "modified", DCAT + "byteSize", DCT + "license", DCT + "rights"


def focus(cls: str) -> str:
    return f"(SELECT g, s FROM quads WHERE p = '{TYPE}' AND o = '{cls}')"


def values(cls: str, p: str) -> str:
    return (f"(SELECT x.g, x.s, x.o, x.o_kind, x.o_dt, x.o_lang FROM quads x JOIN {focus(cls)} f ON f.g = x.g AND f.s = x.s "
            f"WHERE x.p = '{p}')")


def found(shape: str, label: str, component: str, source: str, path: str = "NULL", value: bool = True,
          severity: str = VIOLATION, via: str = "NULL", f: str = "s") -> str:
    """Violations of one constraint; source has g, s and, if value, the object columns."""
    v = "o AS v, o_kind AS v_kind, o_dt AS v_dt, o_lang AS v_lang" if value else \
        "NULL AS v, NULL AS v_kind, NULL AS v_dt, NULL AS v_lang"
    path = path if path.startswith("NULL") or path == "via" else f"'{path}'"
    return (f"SELECT g, '{shape}' AS shape, '{label}' AS label, {f} AS f, {via} AS via, {v}, "
            f"{'via' if path == 'via' else path} AS path, '{SH}{component}ConstraintComponent' AS component, "
            f"'{severity}' AS severity FROM ({source})")


RID = f"'{SKOLEM_BASE}' || " + sha("g", "shape", "label", "f", "'iri'", "''", "''", "via", "v", "v_kind", "v_dt", "v_lang")
SHOWN = f"SELECT g, {RID} AS result_id, shape, f AS focus, path, v AS value, component, severity FROM ("


def family(name: str, *parts: str, ctes: str = "") -> None:
    q(f"shacl_{name}", ctes + SHOWN + union(*parts) + ")")


SH_ = "urn:x:shape:"
q("shacl_targets", union(
    f"SELECT g, '{SH_}by-class' AS shape, s AS focus, 'iri' AS focus_kind FROM {focus(SET)}",
    f"SELECT g, '{SH_}by-node', n, 'iri' FROM (SELECT DISTINCT g FROM quads), (VALUES ('urn:x:catalog:1'), ('urn:x:nowhere')) v(n)",
    f"SELECT DISTINCT g, '{SH_}by-subject', s, 'iri' FROM quads WHERE p IN ('{LICENSE}', '{RIGHTS}')",
    f"SELECT DISTINCT g, '{SH_}by-object', o, o_kind FROM quads WHERE p = '{DCAT}record'",
    f"SELECT g, '{CAT}', s, 'iri' FROM {focus(CAT)}"))


def node_values(shape: str, sql: str) -> str:
    return f"SELECT g, '{SH_}{shape}' AS shape, s AS focus, 'iri' AS focus_kind, o AS value, o_kind AS value_kind, o_dt AS value_dt, o_lang AS value_lang FROM ({sql})"


IRI_COLS = "'iri' AS o_kind, '' AS o_dt, '' AS o_lang"
q("shacl_paths", union(
    node_values("predicate", f"SELECT * FROM {values(SET, TITLE)}"),
    node_values("inverse", f"SELECT f.g, f.s, x.s AS o, {IRI_COLS} FROM {focus(SET)} f JOIN quads x ON x.g = f.g AND x.o = f.s AND x.p = '{DCAT}dataset'"),
    node_values("sequence", f"SELECT DISTINCT a.g, a.s, b.o, {IRI_COLS} FROM {values(CAT, DCAT + 'dataset')} a JOIN quads b ON b.g = a.g AND b.s = a.o AND b.p = '{DCAT}distribution'"),
    node_values("alternative", f"SELECT * FROM {values(DIST, LICENSE)} UNION SELECT * FROM {values(DIST, RIGHTS)}"),
    node_values("itself", f"SELECT g, s, s AS o, {IRI_COLS} FROM {focus(REC)}"),
    node_values("optional", f"SELECT g, s, s AS o, {IRI_COLS} FROM {focus(CAT)} UNION SELECT g, s, o, {IRI_COLS} FROM {values(CAT, DCAT + 'record')}")))
q("path_closure", f"""
, reach AS (
  SELECT f.g, f.s AS a, x.o AS b FROM {focus(CAT)} f JOIN quads x ON x.g = f.g AND x.s = f.s AND x.p IN ('{DCAT}dataset', '{DCAT}distribution')
  UNION SELECT r.g, r.a, x.o FROM reach r JOIN quads x ON x.g = r.g AND x.s = r.b AND x.p IN ('{DCAT}dataset', '{DCAT}distribution')),
topic AS (
  SELECT g, s AS a, s AS b FROM {focus(CAT)}
  UNION SELECT r.g, r.a, x.o FROM topic r JOIN quads x ON x.g = r.g AND x.s = r.b AND x.p IN ('{DCAT}record', '{FOAF}primaryTopic'))
""" + union(node_values("plus", f"SELECT g, a AS s, b AS o, {IRI_COLS} FROM reach"),
            node_values("star", f"SELECT g, a AS s, b AS o, {IRI_COLS} FROM topic")))


def counts(cls: str, p: str, having: str) -> str:
    return (f"SELECT f.g, f.s FROM {focus(cls)} f LEFT JOIN quads x ON x.g = f.g AND x.s = f.s AND x.p = '{p}' "
            f"GROUP BY f.g, f.s HAVING count(x.o) {having}")


MANDATORY = [found(f"{SH_}{r.cls.rsplit('#', 1)[1]}:{r.property}", "minCount(count=1)", "MinCount",
                   counts(r.cls, r.property, "< 1"), r.property, False) for r in RULES if r.requirement == "mandatory"]
family("count", *MANDATORY,
       found(SH_ + "few-distributions", "maxCount(count=10)", "MaxCount", counts(SET, DCAT + "distribution", "> 10"),
             DCAT + "distribution", False))
family("class", found(SH_ + "dataset-class", f"class(value={DIST})", "Class",
                      f"SELECT * FROM {values(CAT, DCAT + 'dataset')} v WHERE NOT EXISTS (FROM quads t WHERE t.g = v.g AND t.s = v.o "
                      f"AND t.p = '{TYPE}' AND t.o = '{DIST}')", DCAT + "dataset"))
family("datatype",
       found(SH_ + "issued-date", f"datatype(value={XSD}date)", "Datatype", f"SELECT * FROM {values(DIST, ISSUED)} WHERE o_dt <> '{XSD}date'", ISSUED),
       found(SH_ + "title-string", f"datatype(value={STR})", "Datatype", f"SELECT * FROM {values(DOC, TITLE)} WHERE o_dt <> '{STR}'", TITLE))
family("nodekind",
       found(SH_ + "url-iri", "nodeKind(value=IRI)", "NodeKind", f"SELECT * FROM {values(DIST, DCAT + 'accessURL')} WHERE o_kind <> 'iri'", DCAT + "accessURL"),
       found(SH_ + "publisher-literal", "nodeKind(value=Literal)", "NodeKind", f"SELECT * FROM {values(CAT, DCT + 'publisher')} WHERE o_kind <> 'literal'", DCT + "publisher"),
       found(SH_ + "license-no-iri", "nodeKind(value=BlankNodeOrLiteral)", "NodeKind", f"SELECT * FROM {values(DIST, LICENSE)} WHERE o_kind = 'iri'", LICENSE))
MIN_SIZE = found(SH_ + "size-min", f"minInclusive(dt={INT}, value=1000)", "MinInclusive",
                 f"SELECT * FROM quads WHERE p = '{SIZE}' AND TRY_CAST(o AS BIGINT) < 1000", SIZE, severity=WARNING)
family("range", MIN_SIZE,
       found(SH_ + "size-max", f"maxInclusive(dt={INT}, value=400000)", "MaxInclusive",
             f"SELECT * FROM {values(DIST, SIZE)} WHERE TRY_CAST(o AS BIGINT) > 400000", SIZE),
       found(SH_ + "issued-between", f"minExclusive(dt={TIME}, value=1996-01-01T00:00:00)", "MinExclusive",
             f"SELECT * FROM {values(DIST, ISSUED)} WHERE TRY_CAST(o AS TIMESTAMP) <= TIMESTAMP '1996-01-01'", ISSUED),
       found(SH_ + "issued-between", f"maxExclusive(dt={TIME}, value=1999-01-01T00:00:00)", "MaxExclusive",
             f"SELECT * FROM {values(DIST, ISSUED)} WHERE TRY_CAST(o AS TIMESTAMP) >= TIMESTAMP '1999-01-01'", ISSUED),
       found(SH_ + "title-number", f"minInclusive(dt={INT}, value=1)", "MinInclusive", f"SELECT * FROM {values(CAT, TITLE)}", TITLE))
KEYWORD = DCAT + "keyword"
family("string",
       found(SH_ + "keyword-length", "minLength(value=9)", "MinLength", f"SELECT * FROM {values(SET, KEYWORD)} WHERE length(o) < 9", KEYWORD),
       found(SH_ + "keyword-length", "maxLength(value=9)", "MaxLength", f"SELECT * FROM {values(SET, KEYWORD)} WHERE length(o) > 9", KEYWORD),
       found(SH_ + "title-pattern", "pattern(flags=i, value=^customer#[0-9]*[02468]$)", "Pattern",
             f"SELECT * FROM {values(SET, TITLE)} WHERE TRY_CAST(right(o, 1) AS INT) % 2 = 1", TITLE),
       found(SH_ + "format-pattern", "pattern(value=^[1-3]-)", "Pattern",
             f"SELECT * FROM {values(DIST, DCT + 'format')} WHERE left(o, 1) NOT IN ('1', '2', '3')", DCT + "format"))
ENGLISH = found(SH_ + "title-english", "languageIn(values=en)", "LanguageIn",
                f"SELECT * FROM {values(DOC, TITLE)} WHERE o_lang <> 'en' AND o_lang NOT LIKE 'en-%'", TITLE, severity=INFO)
family("lang", ENGLISH)


def unmatched(p: str, other: str, negate: str = "NOT") -> str:
    return (f"SELECT * FROM {values(DIST, p)} v WHERE {negate} EXISTS (FROM quads x WHERE x.g = v.g AND x.s = v.s "
            f"AND x.p = '{other}' AND x.o = v.o AND x.o_dt = v.o_dt)")


family("pair",
       found(SH_ + "issued-is-modified", f"equals(predicate={MOD})", "Equals", unmatched(ISSUED, MOD), ISSUED),
       found(SH_ + "issued-is-modified", f"equals(predicate={MOD})", "Equals", unmatched(MOD, ISSUED), ISSUED),
       found(SH_ + "issued-not-modified", f"disjoint(predicate={MOD})", "Disjoint", unmatched(ISSUED, MOD, ""), ISSUED))


def later(p: str, other: str, op: str) -> str:
    return (f"SELECT * FROM {values(DIST, p)} v WHERE EXISTS (FROM quads x WHERE x.g = v.g AND x.s = v.s AND x.p = '{other}' "
            f"AND NOT TRY_CAST(v.o AS TIMESTAMP) {op} TRY_CAST(x.o AS TIMESTAMP))")


LESS = found(SH_ + "issued-before-modified", f"lessThan(predicate={MOD})", "LessThan", later(ISSUED, MOD, "<"), ISSUED)
family("less_than", LESS, found(SH_ + "modified-until-issued", f"lessThanOrEquals(predicate={ISSUED})", "LessThanOrEquals",
                                later(MOD, ISSUED, "<="), MOD))


def has(p: str, s: str = "f.s") -> str:
    return f"EXISTS (FROM quads x WHERE x.g = f.g AND x.s = {s} AND x.p = '{p}')"


def itself(where: str) -> str:
    return f"SELECT g, s, s AS o, {IRI_COLS} FROM {focus(DIST)} f WHERE {where}"


HR, HL, HF = SH_ + "has-rights", SH_ + "has-license", SH_ + "has-format"
LOGIC = [
    found(SH_ + "rights-xor-license", f"xone(shapes={HR} {HL})", "Xone", itself(f"{has(RIGHTS)} = {has(LICENSE)}")),
    found(SH_ + "rights-or-license", f"or(shapes={HR} {HL})", "Or", itself(f"NOT {has(RIGHTS)} AND NOT {has(LICENSE)}")),
    found(SH_ + "rights-and-format", f"and(shapes={HR} {HF})", "And", itself(f"NOT ({has(RIGHTS)} AND {has(DCT + 'format')})")),
    found(SH_ + "no-license", f"not(shapes={HL})", "Not", itself(has(LICENSE)))]
family("logic", *LOGIC)
DISTS = values(SET, DCAT + "distribution")
family("node",
       found(SH_ + "all-rights", f"node(shapes={HR})", "Node", f"SELECT * FROM {DISTS} f WHERE NOT {has(RIGHTS, 'f.o')}", DCAT + "distribution"),
       found(SH_ + "license-count", "minCount(count=1)", "MinCount",
             f"SELECT DISTINCT g, o AS s FROM {DISTS} f WHERE NOT {has(LICENSE, 'f.o')}", LICENSE, False))


def qualified(having: str, where: str = "TRUE") -> str:
    return (f"SELECT d.g, d.s FROM {focus(SET)} d LEFT JOIN (SELECT * FROM {DISTS} f WHERE {has(RIGHTS, 'f.o')} AND {where}) v "
            f"ON v.g = d.g AND v.s = d.s GROUP BY d.g, d.s HAVING count(v.o) {having}")


_Q = f"qualified(max=6, min=3, shapes={HR})"
family("qualified",
       found(SH_ + "some-rights", _Q, "QualifiedMinCount", qualified("< 3"), DCAT + "distribution", False, via="'qualified_min'"),
       found(SH_ + "some-rights", _Q, "QualifiedMaxCount", qualified("> 6"), DCAT + "distribution", False, via="'qualified_max'"),
       found(SH_ + "disjoint-rights", f"qualified(disjoint={HL}, min=4, shapes={HR})", "QualifiedMinCount",
             qualified("< 4", f"NOT {has(LICENSE, 'f.o')}"), DCAT + "distribution", False, via="'qualified_min'"))
family("closed", found(SH_ + "closed-record", f"closed(allowed={MOD}, ignored={TYPE})", "Closed",
                       f"SELECT x.g, x.s, x.o, x.o_kind, x.o_dt, x.o_lang, x.p FROM quads x JOIN record f ON f.g = x.g AND f.s = x.s "
                       f"WHERE x.p NOT IN ('{MOD}', '{TYPE}')", "via", via="p").replace("via AS path", "p AS path"),
       ctes=f", record AS MATERIALIZED (SELECT * FROM {focus(REC)} t)")
OWNER = found(SH_ + "owner", "hasValue(value=urn:x:agent:0)", "HasValue",
              f"SELECT g, s FROM {focus(CAT)} f WHERE NOT EXISTS (FROM quads x WHERE x.g = f.g AND x.s = f.s "
              f"AND x.p = '{DCT}publisher' AND x.o = 'urn:x:agent:0')", DCT + "publisher", False)
family("hasvalue", OWNER)
family("in", found(SH_ + "keyword-in", f"in(values=literal {STR}  BUILDING literal {STR}  MACHINERY)", "In",
                   f"SELECT * FROM {values(SET, KEYWORD)} WHERE o NOT IN ('BUILDING', 'MACHINERY')", KEYWORD))
family("sql", found(SH_ + "even-size", "sql(expr=CAST(value AS BIGINT) % 2 = 0)", "SPARQL",
                    f"SELECT * FROM {values(DIST, SIZE)} WHERE TRY_CAST(o AS BIGINT) % 2 <> 0", SIZE))
family("record", found(
    SH_ + "even-or-settled",
    "sql(expr=CAST(value AS BIGINT) % 2 = 0 OR (license.n > 0 AND modified.least >= issued.most), "
    f"fields=issued {DCT}issued license {LICENSE} modified {MOD})", "SPARQL",
    f"SELECT v.* FROM {values(DIST, SIZE)} v JOIN (SELECT g, s, max(CASE WHEN p = '{DCT}issued' THEN o END) AS issued, "
    f"count(CASE WHEN p = '{LICENSE}' THEN 1 END) AS licenses, min(CASE WHEN p = '{MOD}' THEN o END) AS modified "
    "FROM quads GROUP BY g, s) r ON r.g = v.g AND r.s = v.s "
    "WHERE NOT coalesce(TRY_CAST(v.o AS BIGINT) % 2 = 0 OR (licenses > 0 AND modified >= issued), FALSE)", SIZE))

q("shacl_conforms", f", r AS ({OWNER}) SELECT g, count(r.f) = 0 AS conforms, count(r.f) AS results "
                    "FROM (SELECT DISTINCT g FROM quads) LEFT JOIN r USING (g) GROUP BY g")
BASE = f", r AS MATERIALIZED (SELECT *, {RID} AS result_id FROM ({union(*MANDATORY, LESS, MIN_SIZE, ENGLISH)}))\n"
q("shacl_results", BASE + """SELECT g, result_id, shape, f AS focus, 'iri' AS focus_kind, path, v AS value, v_kind AS value_kind,
  v_dt AS value_dt, v_lang AS value_lang, component, severity, label AS message FROM r""")
q("focus_class", f", r AS (SELECT *, {RID} AS result_id FROM ({union(LESS, MIN_SIZE)})) SELECT r.g, result_id, f AS focus, t.o AS class "
                 f"FROM r JOIN quads t ON t.g = r.g AND t.s = r.f AND t.p = '{TYPE}' AND t.o IN ({FOUR})")
RG = f"'{RESULT_GRAPH_PREFIX}' || sha256(g)"
q("shacl_result_quads", BASE + union(
    triples(RG, "r", ("result_id", TYPE, f"'{SH}ValidationResult'", ""), ("result_id", SH + "resultSeverity", "severity", ""),
            ("result_id", SH + "resultPath", "path", ""), ("result_id", SH + "sourceShape", "shape", ""),
            ("result_id", SH + "sourceConstraintComponent", "component", ""), ("result_id", SH + "resultMessage", "label", STR),
            ("result_id", SH + "focusNode", "f", "")),
    f"SELECT {RG}, result_id, 'iri', '{SH}value', v, v_kind, v_dt, v_lang FROM r WHERE v IS NOT NULL"))
REPORT = f"'{SKOLEM_BASE}' || " + sha("'report'", "g", RG)
q("shacl_report_quads", BASE.rstrip() + f""", v AS (SELECT g, count(r.f) AS n FROM (SELECT DISTINCT g FROM quads) LEFT JOIN r USING (g) GROUP BY g)
SELECT {RG} AS g, {REPORT} AS s, 'iri' AS s_kind, '{TYPE}' AS p, '{SH}ValidationReport' AS o, 'iri' AS o_kind, '' AS o_dt, '' AS o_lang FROM v
UNION ALL SELECT {RG}, {REPORT}, 'iri', '{SH}conforms', CASE WHEN n = 0 THEN 'true' ELSE 'false' END, 'literal', '{XSD}boolean', '' FROM v
UNION ALL SELECT {RG}, {REPORT}, 'iri', '{SH}result', result_id, 'iri', '', '' FROM r""")
q("shacl_reports_read", f", r AS ({OWNER}) SELECT {RG} AS g, count(r.f) = 0 AS conforms, count(r.f) AS results "
                        "FROM (SELECT DISTINCT g FROM quads) LEFT JOIN r USING (g) GROUP BY g")
q("shacl_results_read", BASE + f"""SELECT {RG} AS g, result_id, f AS focus, 'iri' AS focus_kind, path, shape, severity FROM r""")
def along(source: str, having: str) -> str:
    """Focus nodes by the number of their different value nodes; source has g, s and the object columns of a value."""
    term = "concat_ws('|', o_kind, o_dt, o_lang, o)"
    return f"SELECT g, s FROM ({source}) GROUP BY g, s HAVING count(DISTINCT CASE WHEN o IS NOT NULL THEN {term} END) {having}"


_SEQUENCE, _EITHER = f"<{DCAT}dataset>/<{DCAT}distribution>", f"(<{LICENSE}>|<{RIGHTS}>)"
_BACK = f"^(<{DCAT}distribution>|<{DCAT}record>)/^<{DCAT}dataset>"
ALONG = [
    found(SH_ + "along-sequence", "maxCount(count=2)", "MaxCount", along(
        f"SELECT a.g, a.s, b.o, {IRI_COLS} FROM {values(CAT, DCAT + 'dataset')} a JOIN quads b ON b.g = a.g AND b.s = a.o "
        f"AND b.p = '{DCAT}distribution'", "> 2"), _SEQUENCE, False),
    found(SH_ + "along-alternative", "minCount(count=2)", "MinCount", along(
        f"SELECT f.g, f.s, x.o, x.o_kind, x.o_dt, x.o_lang FROM {focus(DIST)} f LEFT JOIN quads x ON x.g = f.g AND x.s = f.s "
        f"AND x.p IN ('{LICENSE}', '{RIGHTS}')", "< 2"), _EITHER, False),
    found(SH_ + "along-inverse", "maxCount(count=0)", "MaxCount", along(
        f"SELECT f.g, f.s, x.s AS o, {IRI_COLS} FROM {focus(REC)} f JOIN quads x ON x.g = f.g AND x.o = f.s AND x.p = '{DCAT}record'",
        "> 0"), f"^<{DCAT}record>", False),
    found(SH_ + "along-back", "maxCount(count=0)", "MaxCount", along(
        f"SELECT f.g, f.s, y.s AS o, {IRI_COLS} FROM {focus(DIST)} f JOIN quads x ON x.g = f.g AND x.o = f.s "
        f"AND x.p IN ('{DCAT}distribution', '{DCAT}record') JOIN quads y ON y.g = x.g AND y.o = x.s AND y.p = '{DCAT}dataset'",
        "> 0"), _BACK, False, severity=SH + "Warning")]
q("shacl_result_paths", f", r AS (SELECT *, {RID} AS result_id FROM ({union(*ALONG)})) "
                        f"SELECT {RG} AS g, result_id, f AS focus, 'iri' AS focus_kind, path, shape, severity FROM r")
family("shapes_graph", *MANDATORY, LESS, MIN_SIZE, ENGLISH, *ALONG, *LOGIC)
ROLLED = f"""SELECT r.g, t.o AS class, r.path, r.shape, r.severity, count(DISTINCT result_id) AS count
FROM r JOIN quads t ON t.g = r.g AND t.s = r.f AND t.p = '{TYPE}' AND t.o IN ({FOUR}) GROUP BY ALL"""
q("shacl_rollup", BASE + ROLLED)
q("shacl_rollup_stored", BASE + ROLLED)
q("shacl_rollup_nested", BASE + f"""SELECT g, class, '[' || string_agg('{{"path":"' || path || '","shape":"' || shape || '","severity":"'
  || severity || '","count":' || count || '}}', ',' ORDER BY path, shape, severity) || ']' AS rows FROM ({ROLLED}) GROUP BY g, class""")
q("shacl_total", BASE + f"SELECT g, CAST(sum(count) AS BIGINT) AS total_violations FROM ({ROLLED}) GROUP BY g")
q("shacl_distinct", BASE + f"""SELECT g, count(*) AS results, count_if(NOT EXISTS (FROM quads t WHERE t.g = r.g AND t.s = r.f
  AND t.p = '{TYPE}' AND t.o IN ({FOUR}))) AS dropped FROM r GROUP BY g""")
SR_ID = sha(RUN, "g", "class", "path", "shape", "severity")
SR_URI = f"'{RULE_SUMMARY_PREFIX}' || {SR_ID}"
q("shacl_summary_quads", BASE + f", c AS ({ROLLED}) " + union(
    triples(PUB, "(SELECT g, coalesce(sum(count), 0) AS total FROM (SELECT DISTINCT g FROM quads) LEFT JOIN c USING (g) GROUP BY g)",
            (S_URI, TYPE, f"'{SHV}ValidationSummary'", ""), (S_URI, MU + "uuid", S_ID, STR),
            (S_URI, SHV + "totalViolations", "total", INT)),
    triples(PUB, f"(SELECT DISTINCT g, class, entities FROM c JOIN ({ENTITIES}) USING (g, class))", *class_rows("entities")),
    triples(PUB, "c", (C_URI, SHV + "hasRuleSummary", SR_URI, ""), (SR_URI, TYPE, f"'{SHV}RuleSummary'", ""),
            (SR_URI, MU + "uuid", SR_ID, STR), (SR_URI, SHV + "violationCount", "count", INT),
            (SR_URI, SHV + "hasSeverity", "severity", ""), (SR_URI, SHV + "hasRuleConstraint", "path", ""),
            (SR_URI, SHV + "hasRule", "shape", ""))))


def local(column: str) -> str:
    return f"string_split({column}, '#')[-1]"


q("shacl_text", BASE + f"""
, n AS (SELECT g, {local('severity')} || ' ' || {local('component')} || ' ' || count(*) AS line FROM r GROUP BY g, severity, component),
b AS (SELECT g, string_agg(line, chr(10) ORDER BY line) AS body FROM n GROUP BY g),
k AS (SELECT g, count(r.f) AS c FROM (SELECT DISTINCT g FROM quads) LEFT JOIN r USING (g) GROUP BY g)
SELECT g, concat_ws(chr(10), 'Conforms: ' || CASE WHEN c = 0 THEN 'true' ELSE 'false' END, 'Results: ' || c, body) AS text
FROM k LEFT JOIN b USING (g)""")
q("shacl_report_lines", BASE + f"""SELECT g, result_id, concat_ws(' ', 'severity', {local('severity')}, 'focus', f, 'path',
  coalesce(path, '-'), 'value', coalesce(v, '-'), 'shape', shape, 'message', label) AS line FROM r""")
V_URI = f"'{RESULT_PREFIX}' || id"
ORACLE["validation_record"] = with_both(f"""
, own AS ({OWNER}), k AS (SELECT g AS data_graph, count(own.f) AS n FROM (SELECT DISTINCT g FROM quads) LEFT JOIN own USING (g) GROUP BY 1),
v AS (SELECT sha256(task) AS id, input, job, n, data_graph FROM ({DUE}) JOIN k USING (data_graph)
  LEFT JOIN (SELECT s AS task, o AS job FROM jobs WHERE p = '{DCT}isPartOf') USING (task) WHERE operation = '{VALIDATION_OPERATION}')
""" + triples(PUB, "v", (V_URI, TYPE, f"'{EXT}ShaclValidationResult'", ""), (V_URI, MU + "uuid", "id", STR),
              (V_URI, EXT + "validated", "input", ""), (V_URI, EXT + "job", "job", ""),
              (V_URI, EXT + "validationSuccess", "CASE WHEN n = 0 THEN 'true' ELSE 'false' END", XSD + "boolean"),
              (V_URI, EXT + "resultGraph", f"'{RESULT_GRAPH_PREFIX}' || sha256(data_graph)", ""),
              (V_URI, EXT + "resultText", "'Results: ' || n", STR)))
