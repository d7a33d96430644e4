"""Names: namespaces and their prefixes, and the lists of terms that operators treat in a way of their own.

Operators work on prefixed names (rdf:type). `compact` makes them of full IRIs, `expand` the other way round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prefixes of public vocabularies.
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "dc": "http://purl.org/dc/elements/1.1/",
    "dcterms": "http://purl.org/dc/terms/",
    "schema": "http://schema.org/",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "geo": "http://www.w3.org/2003/01/geo/wgs84_pos#",
    "vcard": "http://www.w3.org/2006/vcard/ns#",
    "cis": "http://dati.beniculturali.it/cis/",
    "clv": "https://w3id.org/italia/onto/CLV/",
    "sm": "https://w3id.org/italia/onto/SM/",
    "arco": "https://w3id.org/arco/ontology/core/",
    "l0": "https://w3id.org/italia/onto/l0/",
    "ac": "https://w3id.org/italia/onto/AccessCondition/",
    "geosparql": "http://www.opengis.net/ont/geosparql#",
    "time": "http://www.w3.org/2006/time#",
    "org": "http://www.w3.org/ns/org#",
}
#: Properties of provenance, and all that say nothing about a schema.
PROVENANCE = ["dcterms:isPartOf", "clv:hasCity"]
SKIPPED = ["rdf:type", "rdfs:label", "rdfs:comment", "rdfs:seeAlso", "rdfs:isDefinedBy", "owl:sameAs", *PROVENANCE]
#: Types that are no classes of individuals.
META = [
    "owl:Class", "owl:Ontology", "owl:Thing", "owl:Nothing", "rdfs:Class", "rdfs:Resource", "owl:ObjectProperty",
    "owl:DatatypeProperty", "owl:AnnotationProperty", "owl:FunctionalProperty", "owl:NamedIndividual",
]
#: Properties whose IRIs count as literals of type xsd:anyURI.
FORCED_DATA = ["sm:URL"]
#: What a schema says, and of which types.
SCHEMA_PREDICATES = [
    "rdf:type", "rdfs:subClassOf", "rdfs:domain", "rdfs:range", "owl:equivalentClass", "owl:disjointWith", "owl:inverseOf", "owl:onProperty",
    "owl:cardinality", "owl:minCardinality", "owl:maxCardinality", "owl:someValuesFrom", "owl:allValuesFrom", "owl:hasValue", "owl:unionOf",
    "owl:intersectionOf", "owl:propertyChainAxiom", "rdfs:comment",
]
SCHEMA_TYPES = [
    "owl:Class", "owl:Ontology", "owl:ObjectProperty", "owl:DatatypeProperty", "owl:AnnotationProperty", "owl:FunctionalProperty",
    "owl:InverseFunctionalProperty", "owl:TransitiveProperty", "owl:SymmetricProperty", "owl:Restriction", "rdfs:Class",
]
#: Properties known as transitive, which OWL 2 forbids in cardinalities and functional axioms.
KNOWN_TRANSITIVE = [
    "dcterms:isPartOf", "dcterms:hasPart", "dcterms:isFormatOf", "dcterms:hasFormat", "dcterms:isVersionOf", "dcterms:isReferencedBy",
    "skos:broader", "skos:narrower", "skos:broaderTransitive", "skos:narrowerTransitive", "rdfs:subClassOf", "rdfs:subPropertyOf", "owl:sameAs",
    "schema:isPartOf", "schema:hasPart", "schema:containedInPlace", "schema:containsPlace", "time:intervalBefore", "time:intervalAfter",
    "org:subOrganizationOf", "geosparql:sfContains", "geosparql:sfWithin",
]
#: Namespaces whose class is the canonical one of several with one local name.
PREFERRED = ["dati.gov.it", "linkedopendata", "example.org"]
#: What makes a property a likely label.
LABEL_HINTS = ["name", "label", "title", "address", "url", "email", "phone", "telephone", "number", "identifier", "code"]


def _compact(c: Column, prefixes: dict[str, str]) -> Column:
    out = c
    for name, base in prefixes.items():
        out = F.when(c.startswith(base), F.concat(F.lit(f"{name}:"), F.substr(c, F.lit(len(base) + 1)))).otherwise(out)
    return out


def _expand(c: Column, prefixes: dict[str, str]) -> Column:
    out = c
    for name, base in prefixes.items():
        out = F.when(c.startswith(f"{name}:"), F.concat(F.lit(base), F.substr(c, F.lit(len(name) + 2)))).otherwise(out)
    return out


def _renamed(t: DataFrame, how, prefixes: dict[str, str] | None) -> DataFrame:
    known = PREFIXES | (prefixes or {})
    o = F.when(F.col("o_kind") == "iri", how(F.col("o"), known)).otherwise(F.col("o"))
    return t.select(how(F.col("s"), known).alias("s"), how(F.col("p"), known).alias("p"), o.alias("o"), "o_kind", how(F.col("o_dt"), known).alias("o_dt"), "o_lang")


def compact(t: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """t with prefixed names for all IRIs of known namespaces, those of prefixes included."""
    return _renamed(t, _compact, prefixes)


def expand(t: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """t with full IRIs for all prefixed names."""
    return _renamed(t, _expand, prefixes)
