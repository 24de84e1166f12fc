"""Shapes for the quads of ``sources.derived``, by constraint family."""

from __future__ import annotations

from quadlake.plans.shapes import Shape, mandatory_shapes, shape
from quadlake.plans.validation import term_entry
from quadlake.quads import literal
from quadlake.vocab import DCAT, DCT, FOAF, MODIFIED, RDF_TYPE, SH, XSD, XSD_DATETIME, XSD_INTEGER, XSD_STRING

CATALOG = [("class", DCAT + "Catalog")]
DATASET = [("class", DCAT + "Dataset")]
DISTRIBUTION = [("class", DCAT + "Distribution")]
RECORD = [("class", DCAT + "CatalogRecord")]
DOCUMENT = [("class", FOAF + "Document")]
ISSUED = DCT + "issued"
SIZE = DCAT + "byteSize"


def _id(name: str) -> str:
    return "urn:x:shape:" + name


HAS_RIGHTS = shape(_id("has-rights"), ("minCount", {"count": "1"}), path=DCT + "rights")
HAS_LICENSE = shape(_id("has-license"), ("minCount", {"count": "1"}), path=DCT + "license")
HAS_FORMAT = shape(_id("has-format"), ("minCount", {"count": "1"}), path=DCT + "format")

LESS_THAN = shape(_id("issued-before-modified"), ("lessThan", {"predicate": MODIFIED}),
                  targets=DISTRIBUTION, path=ISSUED)
MIN_SIZE = shape(_id("size-min"), ("minInclusive", {"value": "1000", "dt": XSD_INTEGER}),
                 targets=[("subjectsOf", SIZE)], path=SIZE, severity=SH + "Warning")
ENGLISH = shape(_id("title-english"), ("languageIn", {"values": "en"}), targets=DOCUMENT,
                path=DCT + "title", severity=SH + "Info")
OWNER = shape(_id("owner"), ("hasValue", {"value": "urn:x:agent:0"}), targets=CATALOG, path=DCT + "publisher")

FAMILIES: dict[str, list[Shape]] = {
    "targets": [
        shape(_id("by-class"), targets=DATASET),
        shape(_id("by-node"), targets=[("node", "urn:x:catalog:1"), ("node", "urn:x:nowhere")]),
        shape(_id("by-subject"), targets=[("subjectsOf", DCT + "license"), ("subjectsOf", DCT + "rights")]),
        shape(_id("by-object"), targets=[("objectsOf", DCAT + "record")]),
        shape(DCAT + "Catalog", targets=[("implicit", "")]),
    ],
    "paths": [
        shape(_id("predicate"), targets=DATASET, path=DCT + "title"),
        shape(_id("inverse"), targets=DATASET, path=[("^", DCAT + "dataset")]),
        shape(_id("sequence"), targets=CATALOG, path=[("", DCAT + "dataset"), ("", DCAT + "distribution")]),
        shape(_id("alternative"), targets=DISTRIBUTION, path=[("", f"{DCT}license|{DCT}rights")]),
        shape(_id("itself"), targets=RECORD),
        shape(_id("optional"), targets=CATALOG, path=[("?", DCAT + "record")]),
    ],
    "closure": [
        shape(_id("plus"), targets=CATALOG, path=[("+", f"{DCAT}dataset|{DCAT}distribution")]),
        shape(_id("star"), targets=CATALOG, path=[("*", f"{DCAT}record|{FOAF}primaryTopic")]),
    ],
    "count": mandatory_shapes() + [
        shape(_id("few-distributions"), ("maxCount", {"count": "10"}), targets=DATASET, path=DCAT + "distribution"),
        shape(_id("one-catalog"), ("minCount", {"count": "1"}), ("maxCount", {"count": "1"}), targets=RECORD,
              path=[("^", DCAT + "record")]),
    ],
    "class": [
        shape(_id("dataset-class"), ("class", {"value": DCAT + "Distribution"}), targets=CATALOG, path=DCAT + "dataset"),
        shape(_id("record-class"), ("class", {"value": DCAT + "CatalogRecord"}), targets=CATALOG, path=DCAT + "record"),
    ],
    "datatype": [
        shape(_id("size-integer"), ("datatype", {"value": XSD_INTEGER}), targets=DISTRIBUTION, path=SIZE),
        shape(_id("issued-date"), ("datatype", {"value": XSD + "date"}), targets=DISTRIBUTION, path=ISSUED),
        shape(_id("title-string"), ("datatype", {"value": XSD_STRING}), targets=DOCUMENT, path=DCT + "title"),
    ],
    "nodekind": [
        shape(_id("url-iri"), ("nodeKind", {"value": "IRI"}), targets=DISTRIBUTION, path=DCAT + "accessURL"),
        shape(_id("publisher-literal"), ("nodeKind", {"value": "Literal"}), targets=CATALOG, path=DCT + "publisher"),
        shape(_id("license-no-iri"), ("nodeKind", {"value": "BlankNodeOrLiteral"}), targets=DISTRIBUTION,
              path=DCT + "license"),
    ],
    "range": [
        MIN_SIZE,
        shape(_id("size-max"), ("maxInclusive", {"value": "400000", "dt": XSD_INTEGER}), targets=DISTRIBUTION, path=SIZE),
        shape(_id("issued-between"),
              ("minExclusive", {"value": "1996-01-01T00:00:00", "dt": XSD_DATETIME}),
              ("maxExclusive", {"value": "1999-01-01T00:00:00", "dt": XSD_DATETIME}),
              targets=DISTRIBUTION, path=ISSUED),
        shape(_id("title-number"), ("minInclusive", {"value": "1", "dt": XSD_INTEGER}), targets=CATALOG,
              path=DCT + "title"),
    ],
    "string": [
        shape(_id("keyword-length"), ("minLength", {"value": "9"}), ("maxLength", {"value": "9"}), targets=DATASET,
              path=DCAT + "keyword"),
        shape(_id("title-pattern"), ("pattern", {"value": "^customer#[0-9]*[02468]$", "flags": "i"}), targets=DATASET,
              path=DCT + "title"),
        shape(_id("format-pattern"), ("pattern", {"value": "^[1-3]-"}), targets=DISTRIBUTION, path=DCT + "format"),
    ],
    "lang": [ENGLISH, shape(_id("title-unique"), ("uniqueLang", {}), targets=DOCUMENT, path=DCT + "title")],
    "pair": [
        shape(_id("issued-is-modified"), ("equals", {"predicate": MODIFIED}), targets=DISTRIBUTION, path=ISSUED),
        shape(_id("issued-not-modified"), ("disjoint", {"predicate": MODIFIED}), targets=DISTRIBUTION, path=ISSUED),
        shape(_id("title-not-keyword"), ("disjoint", {"predicate": DCAT + "keyword"}), targets=DATASET, path=DCT + "title"),
    ],
    "less_than": [
        LESS_THAN,
        shape(_id("modified-until-issued"), ("lessThanOrEquals", {"predicate": ISSUED}), targets=DISTRIBUTION, path=MODIFIED),
    ],
    "logic": [
        HAS_RIGHTS, HAS_LICENSE, HAS_FORMAT,
        shape(_id("rights-xor-license"), ("xone", {"shapes": f"{HAS_RIGHTS.id}\n{HAS_LICENSE.id}"}), targets=DISTRIBUTION),
        shape(_id("rights-or-license"), ("or", {"shapes": f"{HAS_RIGHTS.id}\n{HAS_LICENSE.id}"}), targets=DISTRIBUTION),
        shape(_id("rights-and-format"), ("and", {"shapes": f"{HAS_RIGHTS.id}\n{HAS_FORMAT.id}"}), targets=DISTRIBUTION),
        shape(_id("no-license"), ("not", {"shapes": HAS_LICENSE.id}), targets=DISTRIBUTION),
    ],
    "node": [
        HAS_RIGHTS,
        shape(_id("license-count"), ("minCount", {"count": "1"}), path=DCT + "license"),
        shape(_id("all-rights"), ("node", {"shapes": HAS_RIGHTS.id}), targets=DATASET, path=DCAT + "distribution"),
        shape(_id("all-licensed"), ("property", {"shapes": _id("license-count")}), targets=DATASET,
              path=DCAT + "distribution"),
    ],
    "qualified": [
        HAS_RIGHTS, HAS_LICENSE,
        shape(_id("some-rights"), ("qualified", {"shapes": HAS_RIGHTS.id, "min": "3", "max": "6"}), targets=DATASET,
              path=DCAT + "distribution"),
        shape(_id("disjoint-rights"), ("qualified", {"shapes": HAS_RIGHTS.id, "disjoint": HAS_LICENSE.id, "min": "4"}),
              targets=DATASET, path=DCAT + "distribution"),
    ],
    "closed": [shape(_id("closed-record"), ("closed", {"allowed": MODIFIED, "ignored": RDF_TYPE}), targets=RECORD)],
    "hasvalue": [OWNER],
    "in": [shape(_id("keyword-in"), ("in", {"values": "\n".join(
        term_entry(literal(x)) for x in ("BUILDING", "MACHINERY"))}), targets=DATASET, path=DCAT + "keyword")],
    "sql": [shape(_id("even-size"), ("sql", {"expr": "CAST(value AS BIGINT) % 2 = 0"}), targets=DISTRIBUTION, path=SIZE)],
    "record": [shape(_id("even-or-settled"), ("sql", {
        "expr": "CAST(value AS BIGINT) % 2 = 0 OR (license.n > 0 AND modified.least >= issued.most)",
        "fields": f"issued {ISSUED}\nlicense {DCT}license\nmodified {MODIFIED}"}), targets=DISTRIBUTION, path=SIZE)],
}

# Counts over paths of several steps, most of which fail.
ALONG = [
    shape(_id("along-sequence"), ("maxCount", {"count": "2"}), targets=CATALOG,
          path=[("", DCAT + "dataset"), ("", DCAT + "distribution")]),
    shape(_id("along-alternative"), ("minCount", {"count": "2"}), targets=DISTRIBUTION, path=[("", f"{DCT}license|{DCT}rights")]),
    shape(_id("along-inverse"), ("maxCount", {"count": "0"}), targets=RECORD, path=[("^", DCAT + "record")]),
    shape(_id("along-back"), ("maxCount", {"count": "0"}), targets=DISTRIBUTION,
          path=[("^", f"{DCAT}distribution|{DCAT}record"), ("^", DCAT + "dataset")], severity=SH + "Warning"),
]

BASE = mandatory_shapes() + [LESS_THAN, MIN_SIZE, ENGLISH]
