"""The rule set of the catalogue profile, as data."""

from __future__ import annotations

from typing import NamedTuple

from quadlake.vocab import ADMS, CNT, DCAT, DCT, DQV, FOAF, MOB, OWL, R5R, SH


class Rule(NamedTuple):
    cls: str
    requirement: str
    property: str


# Severity of a missed rule.
SEVERITY = {
    "mandatory": SH + "Violation",
    "recommended": SH + "Warning",
    "optional": SH + "Info",
}

# Classes of a catalogue.
CLASSES = (
    DCAT + "Catalog",
    DCAT + "Dataset",
    DCAT + "Distribution",
    DCAT + "CatalogRecord",
)

# Class IRI written where a predicate was meant.
TYPOS = {
    DCAT + "Dataset": DCAT + "dataset",
    DCAT + "Distribution": DCAT + "distribution",
    DCAT + "CatalogRecord": DCAT + "record",
}

# Property, class and level of requirement of each rule.
RULES = (
    Rule(DCAT + "Catalog", "mandatory", DCT + "description"),
    Rule(DCAT + "Catalog", "mandatory", DCT + "spatial"),
    Rule(DCAT + "Catalog", "mandatory", FOAF + "homepage"),
    Rule(DCAT + "Catalog", "mandatory", DCT + "publisher"),
    Rule(DCAT + "Catalog", "mandatory", DCAT + "record"),
    Rule(DCAT + "Catalog", "mandatory", DCT + "title"),
    Rule(DCAT + "Catalog", "recommended", DCT + "language"),
    Rule(DCAT + "Catalog", "recommended", DCT + "license"),
    Rule(DCAT + "Catalog", "recommended", DCT + "modified"),
    Rule(DCAT + "Catalog", "recommended", DCT + "issued"),
    Rule(DCAT + "Catalog", "recommended", DCAT + "themeTaxonomy"),
    Rule(DCAT + "Catalog", "optional", DCAT + "dataset"),
    Rule(DCAT + "Catalog", "optional", DCT + "hasPart"),
    Rule(DCAT + "Catalog", "optional", DCT + "identifier"),
    Rule(DCAT + "Catalog", "optional", ADMS + "identifier"),
    Rule(DCAT + "Dataset", "mandatory", DCAT + "distribution"),
    Rule(DCAT + "Dataset", "mandatory", DCT + "description"),
    Rule(DCAT + "Dataset", "mandatory", DCT + "accrualPeriodicity"),
    Rule(DCAT + "Dataset", "mandatory", DCT + "spatial"),
    Rule(DCAT + "Dataset", "mandatory", MOB + "mobilityTheme"),
    Rule(DCAT + "Dataset", "mandatory", DCT + "publisher"),
    Rule(DCAT + "Dataset", "mandatory", DCT + "title"),
    Rule(DCAT + "Dataset", "recommended", MOB + "georeferencingMethod"),
    Rule(DCAT + "Dataset", "recommended", DCAT + "contactPoint"),
    Rule(DCAT + "Dataset", "recommended", DCAT + "keyword"),
    Rule(DCAT + "Dataset", "recommended", MOB + "networkCoverage"),
    Rule(DCAT + "Dataset", "recommended", DCT + "conformsTo"),
    Rule(DCAT + "Dataset", "recommended", DCT + "rightsHolder"),
    Rule(DCAT + "Dataset", "recommended", DCT + "temporal"),
    Rule(DCAT + "Dataset", "recommended", DCAT + "theme"),
    Rule(DCAT + "Dataset", "recommended", MOB + "transportMode"),
    Rule(DCAT + "Dataset", "optional", R5R + "applicableLegislation"),
    Rule(DCAT + "Dataset", "optional", MOB + "assessmentResult"),
    Rule(DCAT + "Dataset", "optional", DCT + "hasVersion"),
    Rule(DCAT + "Dataset", "optional", DCT + "identifier"),
    Rule(DCAT + "Dataset", "optional", MOB + "intendedInformationService"),
    Rule(DCAT + "Dataset", "optional", DCT + "isReferencedBy"),
    Rule(DCAT + "Dataset", "optional", DCT + "isVersionOf"),
    Rule(DCAT + "Dataset", "optional", DCT + "language"),
    Rule(DCAT + "Dataset", "optional", ADMS + "identifier"),
    Rule(DCAT + "Dataset", "optional", DCT + "relation"),
    Rule(DCAT + "Dataset", "optional", DCT + "issued"),
    Rule(DCAT + "Dataset", "optional", DCT + "modified"),
    Rule(DCAT + "Dataset", "optional", OWL + "versionInfo"),
    Rule(DCAT + "Dataset", "optional", ADMS + "versionNotes"),
    Rule(DCAT + "Dataset", "optional", DQV + "hasQualityAnnotation"),
    Rule(DCAT + "Distribution", "mandatory", DCAT + "accessURL"),
    Rule(DCAT + "Distribution", "mandatory", MOB + "mobilityDataStandard"),
    Rule(DCAT + "Distribution", "mandatory", DCT + "format"),
    Rule(DCAT + "Distribution", "mandatory", DCT + "rights"),
    Rule(DCAT + "Distribution", "recommended", MOB + "applicationLayerProtocol"),
    Rule(DCAT + "Distribution", "recommended", DCT + "description"),
    Rule(DCAT + "Distribution", "recommended", DCT + "license"),
    Rule(DCAT + "Distribution", "optional", DCAT + "accessService"),
    Rule(DCAT + "Distribution", "optional", CNT + "characterEncoding"),
    Rule(DCAT + "Distribution", "optional", MOB + "communicationMethod"),
    Rule(DCAT + "Distribution", "optional", MOB + "dataFormatNotes"),
    Rule(DCAT + "Distribution", "optional", DCAT + "downloadURL"),
    Rule(DCAT + "Distribution", "optional", MOB + "grammar"),
    Rule(DCAT + "Distribution", "optional", ADMS + "sample"),
    Rule(DCAT + "Distribution", "optional", DCT + "temporal"),
    Rule(DCAT + "CatalogRecord", "mandatory", DCT + "created"),
    Rule(DCAT + "CatalogRecord", "mandatory", DCT + "language"),
    Rule(DCAT + "CatalogRecord", "mandatory", DCT + "modified"),
    Rule(DCAT + "CatalogRecord", "mandatory", FOAF + "primaryTopic"),
    Rule(DCAT + "CatalogRecord", "optional", DCT + "publisher"),
    Rule(DCAT + "CatalogRecord", "optional", DCT + "source"),
)
