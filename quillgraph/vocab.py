"""Vocabulary terms and defaults."""

from __future__ import annotations

# Namespaces and terms that data is written with.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
DCTERMS = "http://purl.org/dc/terms/"
BF = "http://id.loc.gov/ontologies/bibframe/"
BFLC = "http://id.loc.gov/ontologies/bflc/"
LCLOCAL = "http://id.loc.gov/ontologies/lclocal/"
MADS = "http://www.loc.gov/mads/rdf/v1#"
PREFIXES = {"bf": BF, "bflc": BFLC, "mads": MADS, "lclocal": LCLOCAL}
CONTEXT = {
    "@vocab": BF,
    "bflc": BFLC,
    "mads": MADS,
    "rdf": RDF,
    "rdfs": RDFS,
    "hasInstance": {"@type": "@id"},
    "hasWork": {"@type": "@id"},
    "instanceOf": {"@type": "@id"},
}
STATUS = "http://id.loc.gov/vocabulary/mstatus/c"
STUB_STATUS = "http://id.loc.gov/vocabulary/mstatus/incmp"
AGENT = "http://id.loc.gov/vocabulary/organizations/cbc"
DESCRIPTION_AUTHENTICATION = "http://id.loc.gov/vocabulary/marcauthen/pcc"
DESCRIPTION_LANGUAGE = "http://id.loc.gov/vocabulary/languages/eng"
DESCRIPTION_LEVEL = "http://id.loc.gov/ontologies/bibframe-2-6-0/"
STUB_LABEL, STUB_CODE, UNKNOWN_USER = "incomplete", "incmp", "Unknown"

# Names that this engine calls terms by.
TYPE, FIRST, REST, NIL, VALUE = RDF + "type", RDF + "first", RDF + "rest", RDF + "nil", RDF + "value"
LABEL = RDFS + "label"
WORK, INSTANCE, HUB = BF + "Work", BF + "Instance", BF + "Hub"
ADMIN, ADMIN_TYPE, DERIVED_FROM, STATUS_OF = BF + "adminMetadata", BF + "AdminMetadata", BF + "derivedFrom", BF + "status"
HAS_INSTANCE, INSTANCE_OF = BF + "hasInstance", BF + "instanceOf"
OTHER = "OtherResource"

# Choices of this engine.
NAMESPACE = "https://data.example.org/"
#: Extension points; each may be given to the operator that uses it.
EXCLUDED = [(BF + "identifiedBy", BF + "OclcNumber")]
RELATION_PREDICATES = [BF + "associatedResource", BFLC + "associatedResource"]
INVERSES = [(HAS_INSTANCE, INSTANCE_OF)]
TYPE_RULES = [(HAS_INSTANCE, INSTANCE), (INSTANCE_OF, WORK)]
LABELS = [BF + "mainTitle", LABEL, MADS + "authoritativeLabel", VALUE]
KINDS = {HUB: "hubs", WORK: "works", INSTANCE: "instances"}
