"""Namespaces, IRIs and other fixed values of the data model."""

# Public namespaces.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
OWL = "http://www.w3.org/2002/07/owl#"
SH = "http://www.w3.org/ns/shacl#"
DCAT = "http://www.w3.org/ns/dcat#"
DCT = "http://purl.org/dc/terms/"
FOAF = "http://xmlns.com/foaf/0.1/"
ADMS = "http://www.w3.org/ns/adms#"
DQV = "http://www.w3.org/ns/dqv#"
CNT = "http://www.w3.org/2011/content#"
MOB = "https://w3id.org/mobilitydcat-ap#"
R5R = "http://data.europa.eu/r5r/"
NFO = "http://www.semanticdesktop.org/ontologies/2007/03/22/nfo#"
COGS = "http://vocab.deri.ie/cogs#"
SHV = "http://shacl.data.gift/shacl-validation#"
MU = "http://mu.semte.ch/vocabularies/core/"
EXT = "http://mu.semte.ch/vocabularies/ext/"
TASK = "http://redpencil.data.gift/vocabularies/tasks/"

# System graphs.
PUBLIC_GRAPH = "http://mu.semte.ch/graphs/public"
JOBS_GRAPH = "http://mu.semte.ch/graphs/jobs"

# Prefixes of minted IRIs.
JOB_PREFIX = "http://redpencil.data.gift/id/job/"
TASK_PREFIX = "http://redpencil.data.gift/id/task/"
CONTAINER_PREFIX = "http://redpencil.data.gift/id/container/"
REQUEST_PREFIX = "http://mu.semte.ch/vocabularies/ext/shacl-validation-input/"
RESULT_PREFIX = "http://mu.semte.ch/vocabularies/ext/shacl-validation-result/"
RESULT_GRAPH_PREFIX = "http://mu.semte.ch/vocabularies/ext/shacl-validation-result-graph/"
SUMMARY_PREFIX = "http://redpencil.data.gift/id/validation-summary/"
CLASS_SUMMARY_PREFIX = "http://redpencil.data.gift/id/target-class-summary/"
RULE_SUMMARY_PREFIX = "http://redpencil.data.gift/id/rule-summary/"
SKOLEM_BASE = "http://mu.semte.ch/.well-known/genid/pyshacl-validation-result/"
UNDEF_PREFIX = "urn:undef:"

# Operations and report predicates.
VALIDATION_JOB = "http://lblod.data.gift/id/jobs/concept/JobOperation/validation-job"
COVERAGE_JOB = "http://lblod.data.gift/id/jobs/concept/JobOperation/coverage-analysis-job"
VALIDATION_OPERATION = EXT + "ShaclValidationJob"
COVERAGE_OPERATION = EXT + "CoverageAnalysisJob"
SHACL_REPORT = EXT + "shaclReport"
COVERAGE_REPORT = EXT + "coverageReport"

# Task states.
STATUS_PREFIX = "http://redpencil.data.gift/id/concept/JobStatus/"
BUSY = STATUS_PREFIX + "busy"
SCHEDULED = STATUS_PREFIX + "scheduled"
SUCCESS = STATUS_PREFIX + "success"
FAILED = STATUS_PREFIX + "failed"

# Fixed value: triples in one write batch.
WRITE_BATCH = 100

RDF_TYPE = RDF + "type"
RDF_FIRST = RDF + "first"
RDF_REST = RDF + "rest"
RDF_NIL = RDF + "nil"
LANG_STRING = RDF + "langString"
SUBCLASS_OF = RDFS + "subClassOf"
XSD_STRING = XSD + "string"
XSD_INTEGER = XSD + "integer"
XSD_BOOLEAN = XSD + "boolean"
XSD_DATETIME = XSD + "dateTime"

IRI = "iri"
BNODE = "bnode"
LITERAL = "literal"

STATUS = ADMS + "status"
CREATED = DCT + "created"
MODIFIED = DCT + "modified"
IS_PART_OF = DCT + "isPartOf"
TASK_CLASS = TASK + "Task"
JOB_CLASS = COGS + "Job"
CONTAINER_CLASS = NFO + "DataContainer"
OPERATION = TASK + "operation"
INPUT_CONTAINER = TASK + "inputContainer"
RESULTS_CONTAINER = TASK + "resultsContainer"
CONTENT = EXT + "content"
HEADERS = EXT + "headers"
UUID = MU + "uuid"
ENDPOINT_URL = EXT + "endpointUrl"
REQUEST_CLASS = EXT + "DCATValidationRequest"
RESULT_CLASS = EXT + "ShaclValidationResult"
DATA_GRAPH_OF = EXT + "dataGraph"
VALIDATED = EXT + "validated"

# Legal moves of a task; a task starts as scheduled.
LEGAL_MOVES = ((SCHEDULED, BUSY), (BUSY, SUCCESS), (BUSY, FAILED))
