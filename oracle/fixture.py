"""The quads of the given tables as SQL."""

from quadlake.spec import RULES, SEVERITY
from quadlake.vocab import (
    ADMS, COVERAGE_JOB, COVERAGE_OPERATION, DCAT, DCT, DQV, EXT, FOAF, JOBS_GRAPH, MU, NFO, COGS,
    PUBLIC_GRAPH, RDF, STATUS_PREFIX, TASK, VALIDATION_JOB, VALIDATION_OPERATION, XSD,
)

TYPE = RDF + "type"


def _row(s, p, o, source, kind="literal", dt=XSD + "string", lang="''", where="TRUE", g="'urn:g:region:' || n_regionkey"):
    if kind != "literal":
        dt = ""
    return (f"SELECT {g} AS g, {s} AS s, 'iri' AS s_kind, '{p}' AS p, CAST({o} AS VARCHAR) AS o, "
            f"'{kind}' AS o_kind, '{dt}' AS o_dt, {lang} AS o_lang FROM {source} WHERE {where}")


_CAT = "'urn:x:catalog:' || n_nationkey"
_SET = "'urn:x:dataset:' || c_custkey"
_DIST = "'urn:x:dist:' || o_orderkey"
_REC = "'urn:x:record:' || s_suppkey"
_DOC = "'urn:x:doc:' || doc_id"
_CUST = "customer JOIN nation ON c_nationkey = n_nationkey"
_ORD = f"orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
_SUP = "supplier JOIN nation ON s_nationkey = n_nationkey"
_SHIP = f"(SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) JOIN {_ORD.replace('orders JOIN', 'orders ON l_orderkey = o_orderkey JOIN')}"
_DG = "'urn:g:region:' || (doc_id % 5)"
_ISO = "'%Y-%m-%dT%H:%M:%S'"

QUADS = "SELECT DISTINCT * FROM (" + "\nUNION ALL ".join([
    _row(_CAT, TYPE, f"'{DCAT}Catalog'", "nation", "iri"),
    _row(_CAT, DCT + "title", "n_name", "nation"),
    _row(_CAT, DCT + "publisher", "'urn:x:agent:' || n_regionkey", "nation", "iri"),
    _row(_CAT, DCT + "description", "'catalog ' || n_name", "nation", where="n_nationkey % 3 <> 0"),
    _row(_CAT, FOAF + "homepage", "'http://example.org/' || n_name", "nation", "iri", where="n_nationkey % 4 = 0"),
    _row(_CAT, DCAT + "dataset", _SET, _CUST, "iri"),
    _row(_CAT, DCAT + "record", _REC, _SUP, "iri"),
    _row(_SET, TYPE, f"'{DCAT}Dataset'", _CUST, "iri"),
    _row(_SET, DCT + "title", "c_name", _CUST),
    _row(_SET, DCAT + "keyword", "c_mktsegment", _CUST),
    _row(_SET, DCT + "spatial", "'urn:x:place:' || c_nationkey", _CUST, "iri"),
    _row(_SET, DCT + "description", "'about ' || c_name", _CUST, where="c_acctbal > 0"),
    _row(_SET, DCAT + "distribution", _DIST, _ORD, "iri"),
    _row(_SET, TYPE, f"'{DCAT}Distribution'", _CUST, "iri", where="c_custkey % 97 = 0"),
    _row(_SET, DCAT + "Distribution", "'urn:x:typo'", _CUST, "iri", where="c_custkey % 50 = 0"),
    _row(_DIST, TYPE, f"'{DCAT}Distribution'", _ORD, "iri"),
    _row(_DIST, DCAT + "accessURL", "'http://example.org/d/' || o_orderkey", _ORD, "iri"),
    _row(_DIST, DCT + "format", "o_orderpriority", _ORD),
    _row(_DIST, DCT + "rights", "'closed'", _ORD, where="o_orderstatus = 'F'"),
    _row(_DIST, DCT + "license", "'urn:x:licence:' || (o_orderkey % 7)", _ORD, "iri", where="o_orderstatus = 'O'"),
    _row(_DIST, DCT + "issued", f"strftime(o_orderdate, {_ISO})", _ORD, dt=XSD + "dateTime"),
    _row(_DIST, DCT + "modified", f"strftime(shipped, {_ISO})", _SHIP, dt=XSD + "dateTime"),
    _row(_DIST, DCAT + "byteSize", "CAST(trunc(o_totalprice) AS BIGINT)", _ORD, dt=XSD + "integer"),
    _row(_REC, TYPE, f"'{DCAT}CatalogRecord'", _SUP, "iri"),
    _row(_REC, DCT + "modified", "'2024-01-01'", _SUP, where="s_acctbal > 0"),
    _row(_REC, FOAF + "primaryTopic", _SET, _SUP + " JOIN customer ON c_custkey = s_suppkey", "iri"),
    _row(_DOC, TYPE, f"'{FOAF}Document'", "documents", "iri", g=_DG),
    _row(_DOC, DCT + "title", "'doc ' || doc_id", "documents", dt=RDF + "langString", lang="lower(lang)", g=_DG),
    _row(_DOC, DCAT + "byteSize", "n_chars", "documents", dt=XSD + "integer", g=_DG),
    _row(_DOC, DQV + "hasQualityAnnotation", "quality", "labels", dt=XSD + "integer", g=_DG),
]) + ")"

_STATUS = ("CASE event_type WHEN 'signup' THEN '{0}scheduled' WHEN 'view' THEN '{0}busy' "
           "WHEN 'purchase' THEN '{0}success' WHEN 'error' THEN '{0}failed' END").format(STATUS_PREFIX)

CHANGES = (f"SELECT 'urn:x:task:' || user_id AS task, {_STATUS} AS status, ts, event_id AS id "
           "FROM events WHERE event_type <> 'click'")

_USERS = f"""(SELECT user_id, min(ts) AS created, max(ts) AS modified FROM events GROUP BY 1)
LEFT JOIN (SELECT user_id AS u, {_STATUS} AS status FROM events WHERE event_type <> 'click'
           QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) ON u = user_id"""
_T = "'urn:x:task:' || user_id"
_C = "'urn:x:container:' || user_id"
_J = "'urn:x:job:' || k"
_JG = f"'{JOBS_GRAPH}'"
_PG = f"'{PUBLIC_GRAPH}'"
_JOB = "(SELECT DISTINCT user_id % 10 AS k FROM events)"
_REQ = "'urn:x:request:' || r_regionkey"
_RES = "'urn:x:result:' || r_regionkey"


def _job(s, p, o, source=_USERS, kind="literal", dt=XSD + "string", where="TRUE", g=_JG):
    return _row(s, p, o, source, kind, dt, where=where, g=g)


JOBS = "SELECT DISTINCT * FROM (" + "\nUNION ALL ".join([
    _job(_T, TYPE, f"'{TASK}Task'", kind="iri"),
    _job(_T, MU + "uuid", "'task-' || user_id"),
    _job(_T, DCT + "created", f"strftime(created, {_ISO})", dt=XSD + "dateTime"),
    _job(_T, DCT + "modified", f"strftime(modified, {_ISO})", dt=XSD + "dateTime"),
    _job(_T, ADMS + "status", "status", kind="iri", where="status IS NOT NULL"),
    _job(_T, TASK + "operation", f"CASE user_id % 3 WHEN 0 THEN '{COVERAGE_OPERATION}' WHEN 1 THEN "
         f"'{VALIDATION_OPERATION}' ELSE '{EXT}UnregisteredJob' END", kind="iri"),
    _job(_T, DCT + "isPartOf", "'urn:x:job:' || (user_id % 10)", kind="iri"),
    _job(_T, TASK + "inputContainer", _C, kind="iri"),
    _job(_T, TASK + "index", "'0'"),
    _job(_T, EXT + "headers", """'{"user":"' || user_id || '"}'""", where="user_id % 4 = 0"),
    _job(_C, TYPE, f"'{NFO}DataContainer'", kind="iri"),
    _job(_C, MU + "uuid", "'container-' || user_id"),
    _job(_C, EXT + "content", "CASE WHEN user_id % 2 = 0 THEN 'urn:x:request:' ELSE 'urn:x:result:' END || (user_id % 5)",
         kind="iri"),
    _job(_J, TYPE, f"'{COGS}Job'", _JOB, "iri"),
    _job(_J, MU + "uuid", "'job-' || k", _JOB),
    _job(_J, TASK + "operation", f"CASE k % 3 WHEN 0 THEN '{COVERAGE_JOB}' ELSE '{VALIDATION_JOB}' END", _JOB, "iri"),
    _job(_J, EXT + "endpointUrl", "'http://example.org/sparql/' || k", _JOB, where="k % 2 = 0"),
    _job(_REQ, TYPE, f"'{EXT}DCATValidationRequest'", "region", "iri", g=_PG),
    _job(_REQ, MU + "uuid", "'request-' || r_regionkey", "region", g=_PG),
    _job(_REQ, EXT + "dataGraph", "'urn:g:region:' || r_regionkey", "region", "iri", g=_PG),
    _job(_RES, TYPE, f"'{EXT}ShaclValidationResult'", "region", "iri", g=_PG),
    _job(_RES, MU + "uuid", "'result-' || r_regionkey", "region", g=_PG),
    _job(_RES, EXT + "validated", _REQ, "region", "iri", g=_PG),
]) + ")"

SPEC = "SELECT * FROM (VALUES " + ", ".join(
    f"('{r.cls}', '{r.requirement}', '{r.property}', '{SEVERITY[r.requirement]}')" for r in RULES
) + ") AS v(class, requirement, property, severity)"


def with_quads(sql: str) -> str:
    return f"WITH RECURSIVE quads AS MATERIALIZED ({QUADS}),\nspec AS ({SPEC})\n{sql}"


def with_jobs(sql: str) -> str:
    return f"WITH jobs AS MATERIALIZED ({JOBS}),\nchanges AS ({CHANGES})\n{sql}"


def with_both(sql: str) -> str:
    return (f"WITH quads AS MATERIALIZED ({QUADS}),\njobs AS MATERIALIZED ({JOBS}),\n"
            f"changes AS ({CHANGES}),\nspec AS ({SPEC})\n{sql}")
