"""Registered queries about schemas, refinement, labels, query text, service and validation, each beside its SQL where there is any."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import terms
from ..operators import enrich, labels, patterns, refine, rewrites, schema, service, validation
from ..operators.induction import TAU_DOMAIN, aliases, folded
from ..sources.files import turtle_blocks
from ..sources.triples import COLUMNS, LABEL, TYPE, facts, format_ntriples, graph, iri, parse_ntriples, union
from . import sparql
from .catalog import _C, _O, _S, _SHOP, _SHOP_SQL, _read, query
from .mapping_sql import COUNTED, local, mapped

_ALL = "s, p, o, k AS o_kind, dt AS o_dt, lang AS o_lang"
_HARD = "('dcterms:isPartOf', 'dcterms:hasPart')"


def _tbox_sql(ctes: str, title: str = "TBox") -> str:
    lit, i = "'literal'", "'iri'"
    return f"""{ctes}, hard AS (SELECT p FROM tra WHERE transitive), simple AS (SELECT * FROM fun JOIN inv USING (p) WHERE p NOT IN (SELECT p FROM hard)),
dts AS (SELECT p, count(DISTINCT d) AS n, min(d) AS one, bool_and(d IN ('xsd:string', 'rdf:langString')) AS texts FROM (SELECT p, CASE WHEN dt <> '' THEN dt WHEN lang <> '' THEN 'rdf:langString' ELSE 'xsd:string' END AS d FROM own WHERE k = 'literal') GROUP BY p),
rng AS (SELECT p, cls FROM conf WHERE role = 'range' AND confidence > 0.75 UNION ALL SELECT p, CASE WHEN n = 1 THEN one WHEN texts THEN 'xsd:string' ELSE 'xsd:anySimpleType' END FROM dts),
one AS (SELECT p, min(cls) AS single FROM roles WHERE role = 'range' GROUP BY p HAVING count(*) = 1),
r AS (SELECT cls, p, min_n, max_n, single, CASE WHEN rng.cls2 <> 'owl:Thing' THEN rng.cls2 END AS cls_on FROM card LEFT JOIN one USING (p) LEFT JOIN (SELECT p, cls AS cls2 FROM rng) rng USING (p) WHERE (min_n > 0 OR max_n < 999) AND p NOT IN (SELECT p FROM hard)),
parts AS (SELECT *, 'owl:' || kind || CASE WHEN cls_on IS NULL THEN CASE WHEN kind = '' THEN 'cardinality' ELSE 'Cardinality' END WHEN kind = '' THEN 'qualifiedCardinality' ELSE 'QualifiedCardinality' END AS cp
          FROM (SELECT *, '' AS kind, max_n AS num, 1 AS ord FROM r WHERE min_n = max_n UNION ALL SELECT *, 'min', min_n, 2 FROM r WHERE min_n <> max_n AND min_n > 0 UNION ALL SELECT *, 'max', max_n, 3 FROM r WHERE min_n <> max_n AND max_n < 999)),
nodes AS (SELECT cls, p, cls_on, '_:r' || sha256(p || '|' || string_agg(cp || '=' || num, ' ' ORDER BY ord) || '|' || coalesce(cls_on, '')) AS node FROM parts GROUP BY cls, p, cls_on),
somes AS (SELECT cls, p, single, '_:r' || sha256(p || '|some|' || single) AS node FROM r WHERE min_n >= 1 AND single IS NOT NULL),
tb(s, p, o, k, dt, lang) AS (SELECT DISTINCT * FROM (
SELECT 'https://example.org/tbox/generated' AS s, p, o, CASE WHEN p = 'rdf:type' THEN {i} ELSE {lit} END, '', '' FROM (SELECT unnest(['rdf:type', 'dc:title', 'dc:creator', 'dc:description']) AS p, unnest(['owl:Ontology', '{title}', 'tessera', '']) AS o)
UNION ALL SELECT cls, 'rdf:type', 'owl:Class', {i}, '', '' FROM size UNION ALL SELECT cls, 'rdfs:label', {local('cls')}, {lit}, '', 'en' FROM size
UNION ALL SELECT cls, 'rdfs:comment', 'Istanze osservate nella ABox: ' || members, {lit}, '', '' FROM size
UNION ALL SELECT child, 'rdfs:subClassOf', parent, {i}, '', '' FROM sub UNION ALL SELECT a, 'owl:disjointWith', b, {i}, '', '' FROM dis
UNION ALL SELECT p, 'rdf:type', CASE WHEN k = 'literal' THEN 'owl:DatatypeProperty' ELSE 'owl:ObjectProperty' END, {i}, '', '' FROM own
UNION ALL SELECT p, 'rdfs:label', {local('p')}, {lit}, '', 'en' FROM own
UNION ALL SELECT p, 'rdfs:comment', role || ': ' || {local('cls')} || ' (confidence: ' || round(confidence * 100, 1) || '%)', {lit}, '', '' FROM conf WHERE confidence > 0.75
UNION ALL SELECT p, 'rdfs:domain', cls, {i}, '', '' FROM conf WHERE role = 'domain' AND confidence > 0.75 UNION ALL SELECT p, 'rdfs:range', cls, {i}, '', '' FROM rng
UNION ALL SELECT p, 'rdf:type', 'owl:FunctionalProperty', {i}, '', '' FROM (SELECT p FROM simple WHERE functional UNION SELECT p FROM fdata WHERE functional)
UNION ALL SELECT p, 'rdf:type', 'owl:InverseFunctionalProperty', {i}, '', '' FROM simple WHERE inverse_functional
UNION ALL SELECT p, 'rdf:type', 'owl:SymmetricProperty', {i}, '', '' FROM sym WHERE "symmetric" UNION ALL SELECT p, 'rdf:type', 'owl:TransitiveProperty', {i}, '', '' FROM hard
UNION ALL SELECT p, 'owl:inverseOf', min(q), {i}, '', '' FROM (SELECT p, q FROM invp UNION SELECT q, p FROM invp) GROUP BY p
UNION ALL SELECT cls, 'rdfs:subClassOf', node, 'bnode', '', '' FROM (SELECT cls, node FROM nodes UNION SELECT cls, node FROM somes)
UNION ALL SELECT node, 'rdf:type', 'owl:Restriction', {i}, '', '' FROM (SELECT node FROM nodes UNION SELECT node FROM somes) UNION ALL SELECT node, 'owl:onProperty', p, {i}, '', '' FROM (SELECT node, p FROM nodes UNION SELECT node, p FROM somes)
UNION ALL SELECT node, 'owl:onClass', cls_on, {i}, '', '' FROM nodes WHERE cls_on IS NOT NULL UNION ALL SELECT node, 'owl:someValuesFrom', single, {i}, '', '' FROM somes
UNION ALL SELECT node, cp, CAST(num AS VARCHAR), {lit}, 'xsd:nonNegativeInteger', '' FROM parts JOIN nodes USING (cls, p)))"""


_TBOX = _tbox_sql(_SHOP_SQL)


@query(f"{_TBOX} SELECT {_ALL} FROM tb")
def build_tbox(spark, sf_dir):
    return schema.build_tbox(schema.analyse(graph(spark, sf_dir, *_SHOP)))


_ORDERED_SQL = f"WITH {mapped('orders', 'lineitem', 'part', more=chr(10).join(['''SELECT 'ex:part/' || l_partkey, 'ex:partOfOrder', 'ex:order/' || l_orderkey, 'iri', '', '' FROM lineitem''']))}, {COUNTED}"


@query(f"{_tbox_sql(_ORDERED_SQL)} SELECT {_ALL} FROM tb")
def build_tbox_inverses(spark, sf_dir):
    line = _read(spark, sf_dir, "lineitem")
    back = facts(line, iri("part", "l_partkey"), "ex:partOfOrder", iri("order", "l_orderkey"), "iri")
    return schema.build_tbox(schema.analyse(graph(spark, sf_dir, "orders", "lineitem", "part", repeats=True).unionByName(back)))


_JUNK = """SELECT 'ex:customer/' || c_custkey, 'dcterms:isPartOf', 'ex:dump', 'iri', '', '' FROM customer UNION ALL SELECT 'ex:Customer', 'rdf:type', 'owl:Class', 'iri', '', ''
UNION ALL SELECT 'ex:Customer', 'rdfs:subClassOf', 'ex:Agent', 'iri', '', '' UNION ALL SELECT 'ex:Customer', 'ex:note', 'kept', 'literal', '', ''
UNION ALL SELECT '_:x', 'owl:onProperty', 'ex:name', 'iri', '', '' UNION ALL SELECT '_:x', 'ex:why', 'gone', 'literal', '', '' UNION ALL SELECT 'ex:supplier/' || s_suppkey, 'rdf:type', 'http://b.example/Customer', 'iri', '', '' FROM supplier"""


def _junk(spark, sf_dir):
    c, s = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "supplier")
    said = [("ex:Customer", TYPE, "owl:Class", "iri"), ("ex:Customer", "rdfs:subClassOf", "ex:Agent", "iri"), ("ex:Customer", "ex:note", "kept", "literal"), ("_:x", "owl:onProperty", "ex:name", "iri"), ("_:x", "ex:why", "gone", "literal")]
    own = spark.createDataFrame([(*x, "", "") for x in said], ", ".join(f"{c} string" for c in COLUMNS))
    return union([graph(spark, sf_dir, "customer", "supplier"), own, facts(c, iri("customer", "c_custkey"), "dcterms:isPartOf", F.lit("ex:dump"), "iri"), facts(s, iri("supplier", "s_suppkey"), TYPE, F.lit("http://b.example/Customer"), "iri")])


def _stripped(spark, sf_dir):
    """(facts with what is no fact, schema of the facts, aliases)."""
    alias = spark.createDataFrame([("http://b.example/Customer", "ex:Customer")], "s string, canonical string")
    tbox = schema.build_tbox(schema.analyse(graph(spark, sf_dir, "customer", "supplier")))
    return _junk(spark, sf_dir), tbox, alias


_KEPT = f"""a(s, p, o, k, dt, lang) AS (SELECT DISTINCT * FROM (SELECT * FROM t UNION ALL {_JUNK})),
f(s, p, o, k, dt, lang) AS (SELECT DISTINCT s, p, CASE WHEN p = 'rdf:type' AND o = 'http://b.example/Customer' THEN 'ex:Customer' ELSE o END, k, dt, lang FROM a
  WHERE p <> 'dcterms:isPartOf' AND NOT (p = 'rdf:type' AND o LIKE 'owl:%') AND s <> '_:x' AND NOT (s IN (SELECT s FROM tb WHERE s NOT LIKE '_:%') AND p IN ('rdf:type', 'rdfs:subClassOf')))"""
_PEOPLE = _tbox_sql(f"WITH {mapped('customer', 'supplier')}, {COUNTED}")


@query(f"{_PEOPLE}, {_KEPT} SELECT {_ALL} FROM f")
def strip_tbox(spark, sf_dir):
    return schema.strip_tbox(*_stripped(spark, sf_dir))


@query(f"{_PEOPLE}, {_KEPT} SELECT {_ALL} FROM f UNION SELECT {_ALL} FROM tb UNION SELECT s, 'rdf:type', 'owl:NamedIndividual', 'iri', '', '' FROM f WHERE p = 'rdf:type'")
def build_merged(spark, sf_dir):
    abox, tbox, alias = _stripped(spark, sf_dir)
    return schema.build_merged(tbox, abox, alias)


@query("SELECT s, cls AS o FROM (SELECT 'http://a.example/' || c_custkey AS s, CASE WHEN c_custkey % 2 = 0 THEN 'http://linkedopendata.x/P' ELSE 'http://a.example/Q' END AS cls FROM customer)")
def fold_aliases(spark, sf_dir):
    c = _read(spark, sf_dir, "customer")
    cls = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'http://a.example/P' WHEN 2 THEN 'http://linkedopendata.x/P' ELSE 'http://a.example/Q' END")
    t = facts(c, F.concat(F.lit("http://a.example/"), F.col("c_custkey").cast("string")), TYPE, cls, "iri")
    return folded(t, aliases(t.select(F.col("o").alias("cls")))).select("s", "o")


def _hashed(spark, sf_dir):
    c, n = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "nation")
    s = F.concat(F.lit("ex:"), F.md5(F.col("c_custkey").cast("string")))
    nation = facts(n, iri("nation", "n_nationkey"), LABEL, F.col("n_name"))
    return union([nation, facts(c, s, TYPE, F.lit("ex:Customer"), "iri"), facts(c, s, "ex:name", F.col("c_name")), facts(c, s, "ex:segment", F.col("c_mktsegment")), facts(c, iri("nation", "c_nationkey"), "ex:hasMember", s, "iri")])


@query("""WITH c AS (SELECT 'ex:' || md5(CAST(c_custkey AS VARCHAR)) AS s, *, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT s, 'rdfs:label' AS p, 'Customer — ' || n_name || CASE WHEN n > 1 THEN ' (' || c_name || ')' ELSE '' END AS o FROM c UNION ALL SELECT s, 'rdf:type', 'ex:Customer' FROM c UNION ALL SELECT s, 'ex:name', c_name FROM c UNION ALL SELECT s, 'ex:segment', c_mktsegment FROM c
UNION ALL SELECT 'ex:nation/' || c_nationkey, 'ex:hasMember', s FROM c UNION ALL SELECT 'ex:nation/' || n_nationkey, 'rdfs:label', n_name FROM nation""")
def label_individuals(spark, sf_dir):
    return schema.label_individuals(_hashed(spark, sf_dir)).select("s", "p", "o")


# Refinement works on suppliers as institutes: each with a site shared by its nation, a geometry, a condition of access and contacts.
_BASE = "https://x.example/data/"
_INST = f"'{_BASE}inst/' || s_suppkey"
_LEVEL = "CASE s_suppkey % 4 WHEN 0 THEN 'Non accessibile' WHEN 1 THEN 'PARZIALMENTE accessibile' WHEN 2 THEN 'Totalmente accessibile' ELSE 'Da verificare' END"
_TRIPLES: list[tuple[str, str, str, str, str, str]] = [
    # table, subject, property, object, kind, rows
    ("supplier", _INST, "rdf:type", "CASE WHEN s_suppkey % 5 = 0 THEN 'ex:Museum' ELSE 'cis:CulturalInstituteOrSite' END", "iri", "true"),
    ("supplier JOIN nation ON n_nationkey = s_nationkey", _INST, "rdfs:label", "n_name || ' - ' || s_name", "literal", "s_suppkey % 7 <> 1"),
    ("supplier JOIN nation ON n_nationkey = s_nationkey", _INST, "rdfs:label", "n_name", "literal", "s_suppkey % 7 = 1"),
    ("supplier", _INST, "l0:name", "'\"\"' || s_name || '\"\";'", "literal", "true"),
    ("supplier", _INST, "ac:hasAccessCondition", "'ex:access/' || s_suppkey", "iri", "true"),
    ("supplier", "'ex:access/' || s_suppkey", "rdf:type", "'ac:AccessCondition'", "iri", "true"),
    ("supplier", "'ex:access/' || s_suppkey", "rdfs:label", _LEVEL, "literal", "true"),
    ("supplier", "'ex:access/' || s_suppkey", "l0:description", "'note ' || s_name", "literal", "s_suppkey % 3 = 0"),
    ("supplier", _INST, "cis:hasSite", "'ex:site/' || s_nationkey", "iri", "true"),
    ("nation", "'ex:site/' || n_nationkey", "rdf:type", "'cis:Site'", "iri", "true"),
    ("nation", "'ex:site/' || n_nationkey", "cis:siteAddress", "'ex:address/' || n_nationkey", "iri", "true"),
    ("nation", "'ex:site/' || n_nationkey", "ex:opened", "n_name", "literal", "true"),
    ("supplier", _INST, "clv:hasGeometry", "'ex:geo/' || s_suppkey", "iri", "true"),
    ("supplier", "'ex:geo/' || s_suppkey", "rdf:type", "'clv:Geometry'", "iri", "true"),
    ("supplier", "'ex:geo/' || s_suppkey", "geosparql:asWKT", "'POINT(' || s_suppkey % 180 || ' ' || s_nationkey || ')'", "literal", "true"),
    ("supplier", _INST, "sm:hasWebSite", "'ex:web/' || s_suppkey", "iri", "s_suppkey % 2 = 0"),
    ("supplier", "'ex:web/' || s_suppkey", "rdf:type", "'sm:WebSite'", "iri", "s_suppkey % 2 = 0"),
    ("supplier", "'ex:web/' || s_suppkey", "sm:URL", "'http://site/' || s_suppkey", "iri", "s_suppkey % 2 = 0"),
    ("supplier", _INST, "sm:hasEmail", "'ex:mail/' || s_suppkey", "iri", "true"),
    ("supplier", "'ex:mail/' || s_suppkey", "rdf:type", "'sm:Email'", "iri", "true"),
    ("supplier", "'ex:mail/' || s_suppkey", "sm:emailAddress", "s_name || '@x'", "literal", "true"),
]
_DECLARED = [
    ("ex:Museum", TYPE, "owl:Class"), ("ex:Museum", "rdfs:subClassOf", "cis:CulturalInstituteOrSite"), ("cis:CulturalInstituteOrSite", TYPE, "owl:Class"), ("ex:Empty", TYPE, "owl:Class"), ("ex:Emptier", TYPE, "owl:Class"),
    ("ex:Emptier", "rdfs:subClassOf", "ex:Empty"), ("ex:Error1", TYPE, "owl:Class"), ("ex:unused", TYPE, "owl:ObjectProperty"), ("cis:hasSite", TYPE, "owl:ObjectProperty"), ("l0:name", TYPE, "owl:DatatypeProperty"),
    ("l0:name", "rdfs:range", "xsd:string"), ("https://old.example/o", TYPE, "owl:Ontology"), ("cis:Site", TYPE, "owl:Class"),
]
_HERITAGE = mapped(more=" UNION ALL ".join([f"SELECT {s}, '{p}', {o}, '{k}', '', '' FROM {t} WHERE {w}" for t, s, p, o, k, w in _TRIPLES] + [f"SELECT '{s}', '{p}', '{o}', 'iri', '', ''" for s, p, o in _DECLARED] + [
    "SELECT '_:r1', 'owl:onProperty', 'cis:hasSite', 'iri', '', '' UNION ALL SELECT 'cis:CulturalInstituteOrSite', 'rdfs:subClassOf', '_:r1', 'bnode', '', '' UNION ALL SELECT 'ex:lonely', 'rdfs:label', 'alone', 'literal', '', '' UNION ALL SELECT 'l0:name', 'rdfs:comment', 'domain: X (confidence: 99.0%)', 'literal', '', '' UNION ALL SELECT 'ex:seen', 'rdfs:label', 'english', 'literal', '', 'en' UNION ALL SELECT 'ex:seen', 'rdf:type', 'owl:Class', 'iri', '', '' UNION ALL SELECT 'ex:seen', 'rdfs:label', 'visto', 'literal', '', 'it'"
]))


def _heritage(spark, sf_dir):
    tables = {n: _read(spark, sf_dir, n) for n in ("supplier", "nation")}
    both = tables["supplier"].join(tables["nation"], F.col("n_nationkey") == F.col("s_nationkey"))
    out = [facts((tables.get(t) if t in tables else both).where(w), F.expr(s), p, F.expr(o), k) for t, s, p, o, k, w in _TRIPLES]
    rest = [(s, p, o, "iri", "", "") for s, p, o in _DECLARED] + [
        ("_:r1", "owl:onProperty", "cis:hasSite", "iri", "", ""), ("cis:CulturalInstituteOrSite", "rdfs:subClassOf", "_:r1", "bnode", "", ""), ("ex:lonely", LABEL, "alone", "literal", "", ""),
        ("l0:name", "rdfs:comment", "domain: X (confidence: 99.0%)", "literal", "", ""), ("ex:seen", LABEL, "english", "literal", "", "en"), ("ex:seen", TYPE, "owl:Class", "iri", "", ""), ("ex:seen", LABEL, "visto", "literal", "", "it"),
    ]
    return union([*out, spark.createDataFrame(rest, ", ".join(f"{c} string" for c in COLUMNS))]).distinct()


_NAMES = refine.Names()
_H = f"WITH {_HERITAGE}"


def _said(*rows: tuple) -> str:
    one = lambda x: f"SELECT '{x[0]}', '{x[1]}', '{x[2]}', " + ("'iri', '', ''" if len(x) == 3 else f"'literal', '', '{x[3]}'")
    return " UNION ".join(map(one, rows))


@query(f"{_H} SELECT {_ALL} FROM t WHERE p NOT IN ('l0:name', 'rdfs:comment') UNION SELECT {_INST}, 'l0:name', s_name, 'literal', '', '' FROM supplier")
def clean_text(spark, sf_dir):
    return refine.clean_text(_heritage(spark, sf_dir), _NAMES)


@query(f"{_H} SELECT {_ALL} FROM t WHERE s <> 'ex:lonely'")
def orphan_terms(spark, sf_dir):
    return refine.without_orphans(_heritage(spark, sf_dir))


_GONE = "s NOT IN ('cis:hasSite', '_:r1') AND NOT (o IN ('cis:hasSite', '_:r1') AND k <> 'literal')"


@query(f"{_H} SELECT {_ALL} FROM t WHERE {_GONE}")
def purge_term(spark, sf_dir):
    t = _heritage(spark, sf_dir)
    return refine.purged(t, refine.terms(t, "cis:hasSite"))


_A = "ex:hasAddress"


@query(f"{_H} SELECT s, CASE WHEN p = 'cis:siteAddress' THEN '{_A}' ELSE p END AS p, o, k AS o_kind, dt AS o_dt, lang AS o_lang FROM t UNION {_said((_A, TYPE, 'owl:ObjectProperty'), (_A, TYPE, 'owl:FunctionalProperty'), (_A, LABEL, 'ha indirizzo', 'it'), (_A, LABEL, 'has address', 'en'), (_A, 'rdfs:domain', _NAMES.main), (_A, 'rdfs:range', _NAMES.address))}")
def one_address(spark, sf_dir):
    return refine.one_address(_heritage(spark, sf_dir), _NAMES)


_G, _HG, _EG = "ex:Geometria", "ex:haCoordinate", "ex:eCoordinataDi"
_GEOMETRY = _said(
    (_G, TYPE, "owl:Class"), (_G, LABEL, "Geometria", "it"), (_HG, TYPE, "owl:ObjectProperty"), (_HG, LABEL, "ha coordinate", "it"), (_HG, "rdfs:domain", _NAMES.main), (_HG, "rdfs:range", _G), (_HG, "owl:inverseOf", _EG),
    (_EG, TYPE, "owl:ObjectProperty"), (_EG, LABEL, "è coordinata di", "it"), (_EG, "rdfs:domain", _G), (_EG, "rdfs:range", _NAMES.main), (_NAMES.wkt, TYPE, "owl:DatatypeProperty"), (_NAMES.wkt, LABEL, "geometria (WKT)", "it"),
    (_NAMES.wkt, "rdfs:domain", _G), (_NAMES.wkt, "rdfs:range", "xsd:string"),
)


@query(f"{_H} SELECT {_ALL} FROM t WHERE p <> 'clv:hasGeometry' AND o <> 'clv:Geometry' UNION SELECT s, '{_HG}', o, k, dt, lang FROM t WHERE p = 'clv:hasGeometry' UNION SELECT o, 'rdf:type', x, 'iri', '', '' FROM t, (SELECT unnest(['{_G}', 'owl:NamedIndividual']) AS x) WHERE p = 'clv:hasGeometry' UNION {_GEOMETRY}")
def geometry_entities(spark, sf_dir):
    return refine.geometry(_heritage(spark, sf_dir), _NAMES)


@query(f"{_H}, d AS (SELECT {_INST} AS s, CASE WHEN s_suppkey % 5 <> 0 THEN 1 ELSE 0 END AS main, CASE WHEN lower(l) LIKE '%forte%' THEN 'Fortificazione' WHEN lower(l) LIKE '%porta%' THEN 'Porta' WHEN lower(l) LIKE '%villa%' THEN 'Villa' ELSE 'AltroBeneCulturale' END AS kind FROM (SELECT *, CASE WHEN s_suppkey % 7 = 1 THEN n_name ELSE n_name || ' - ' || s_name END AS l FROM supplier JOIN nation ON n_nationkey = s_nationkey)) SELECT s, 'ex:' || kind AS o FROM d WHERE main = 1")
def taxonomy(spark, sf_dir):
    out = refine.taxonomy(_heritage(spark, sf_dir), _NAMES)
    kinds = out.where((F.col("p") == "rdfs:subClassOf") & (F.col("o") == _NAMES.main) & (F.col("s") != "ex:Museum")).select(F.col("s").alias("o"))
    return out.where(F.col("p") == TYPE).join(kinds, "o", "left_semi").select("s", "o")


@query(f"{_H} SELECT s, p, CASE WHEN p = 'rdf:type' AND o = 'ex:Museum' THEN 'cis:CulturalInstituteOrSite' ELSE o END AS o, k AS o_kind, dt AS o_dt, lang AS o_lang FROM t WHERE s <> 'ex:Museum'")
def compact_subclasses(spark, sf_dir):
    return refine.compact_main(_heritage(spark, sf_dir), _NAMES)


@query(f"""{_H}, m AS (SELECT {_INST} AS s, s_suppkey FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 2 = 0)
SELECT s, p, o FROM t WHERE NOT (s IN (SELECT s FROM m) AND p IN ('sm:hasWebSite', 'sm:hasEmail')) UNION SELECT s, 'ex:haContatti', 'ex:web/' || s_suppkey FROM m UNION SELECT 'ex:web/' || s_suppkey, 'ex:haContatti', 'ex:mail/' || s_suppkey FROM m""")
def contacts(spark, sf_dir):
    t = _heritage(spark, sf_dir)
    made = ["ex:Contact", "ex:haContatti", "ex:eContattoDi"]
    out = refine.contacts(t, _NAMES)
    known = t.select("s", "p").unionByName(out.where("p = 'ex:haContatti'").select("s", "p")).distinct()
    return out.where(~F.col("s").isin(made)).join(known, ["s", "p"], "left_semi").select("s", "p", "o")


_SLUG = "CASE s_suppkey % 4 WHEN 0 THEN 'non-accessibile' WHEN 1 THEN 'parzialmente-accessibile' WHEN 2 THEN 'totalmente-accessibile' END"


@query(f"""{_H}, a AS (SELECT {_INST} AS s, 'ex:access/' || s_suppkey AS ac, '{_BASE}access-condition/' || {_SLUG} AS node, CASE WHEN s_suppkey % 3 = 0 THEN 'note ' || s_name END AS note FROM supplier WHERE s_suppkey % 4 <> 3)
SELECT s, p, o FROM t WHERE s NOT IN (SELECT ac FROM a) AND o NOT IN (SELECT ac FROM a) UNION SELECT s, 'ac:hasAccessCondition', node FROM a UNION SELECT s, 'ex:accessibilityNote', note FROM a WHERE note IS NOT NULL
UNION SELECT node, 'rdf:type', x FROM a, (SELECT unnest(['ac:AccessCondition', 'owl:NamedIndividual']) AS x)""")
def shared_access(spark, sf_dir):
    out = refine.shared_access(_heritage(spark, sf_dir), _NAMES, _BASE)
    texts = F.col("s").startswith(f"{_BASE}access-condition/") & (F.col("p") != TYPE)
    return out.where(~texts & (F.col("s") != "ex:accessibilityNote")).select("s", "p", "o")


@query(f"""WITH l AS (SELECT {_INST} AS s, n_name, CASE WHEN s_suppkey % 7 = 1 THEN n_name ELSE n_name || ' - ' || s_name END AS label FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 5 <> 0),
w AS (SELECT label, min(s) AS whole FROM l GROUP BY label) SELECT s, 'ex:isPartOf' AS p, whole AS o FROM l JOIN w ON w.label = n_name WHERE l.label LIKE '% - %'""")
def inferred_parts(spark, sf_dir):
    return refine.parts(_heritage(spark, sf_dir), _NAMES).where("p = 'ex:isPartOf'").select("s", "p", "o")


@query(f"""{_H}, m AS (SELECT s FROM t WHERE p = 'rdf:type' AND o = 'cis:CulturalInstituteOrSite')
SELECT s, p, o, k AS o_kind, dt AS o_dt, CASE WHEN k = 'literal' AND lang = '' AND (p IN ('l0:name', 'l0:description') OR (p = 'rdfs:label' AND s IN (SELECT s FROM m))) THEN 'it' ELSE lang END AS o_lang FROM t WHERE NOT (s = 'l0:name' AND p = 'rdfs:range') UNION {_said(('l0:name', 'rdfs:range', 'rdfs:Literal'))}""")
def tagged_text(spark, sf_dir):
    return refine.tagged_text(_heritage(spark, sf_dir), _NAMES)


@query(f"{_H} SELECT {_ALL} FROM t WHERE s NOT IN ('ex:Error1', 'ex:unused', 'ex:Empty', 'ex:Emptier', 'ex:seen') AND p <> 'ex:none'")
def pruned(spark, sf_dir):
    return refine.pruned(_heritage(spark, sf_dir), _NAMES)


@query(f"{_H}, w(s, word) AS (VALUES ('cis:CulturalInstituteOrSite', 'Istituto culturale o sito'), ('cis:hasSite', 'ha sito'), ('l0:name', 'nome'), ('cis:Site', 'Sito'), ('ex:seen', 'visto')) SELECT {_ALL} FROM t WHERE NOT (p = 'rdfs:label' AND s IN (SELECT s FROM w)) UNION SELECT s, 'rdfs:label', word, 'literal', '', 'it' FROM w")
def italian_labels(spark, sf_dir):
    return refine.italian_labels(_heritage(spark, sf_dir))


@query(f"{_H} SELECT CASE WHEN s = 'https://old.example/o' THEN 'ex:onto' ELSE s END AS s, p, o, k AS o_kind, dt AS o_dt, lang AS o_lang FROM t UNION {_said(('ex:onto', 'owl:versionInfo', 'refined', ''), ('ex:onto', 'owl:versionIRI', 'ex:onto/1.0'))}")
def retitled(spark, sf_dir):
    return refine.retitled(_heritage(spark, sf_dir), "ex:onto")


@query(f"{_H} SELECT s, p, o, k AS o_kind FROM t UNION SELECT o, 'ex:isAccessConditionOf', s, 'iri' FROM t WHERE p = 'ac:hasAccessCondition' UNION SELECT 'ex:isAccessConditionOf', 'owl:inverseOf', 'ac:hasAccessCondition', 'iri' UNION SELECT 'ex:isAccessConditionOf', 'rdf:type', 'owl:ObjectProperty', 'iri' UNION SELECT 'ex:isAccessConditionOf', 'rdfs:label', 'isAccessConditionOf', 'literal'")
def named_inverses(spark, sf_dir):
    return refine.inverses(_heritage(spark, sf_dir), _NAMES).select("s", "p", "o", "o_kind")


def refined(spark, sf_dir):
    """All steps in order."""
    return refine.refine(_heritage(spark, sf_dir), _NAMES)


@query(f"{_H} SELECT s, p, o FROM t WHERE p NOT IN ('cis:hasSite', 'cis:siteAddress') AND s NOT LIKE 'ex:site/%' AND {_GONE} AND s <> 'cis:Site' AND o <> 'cis:Site' UNION SELECT {_INST}, 'ex:hasPlace', 'ex:address/' || s_nationkey FROM supplier UNION SELECT {_INST}, 'ex:opened', n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION SELECT 'ex:site/' || n_nationkey, p, o FROM nation, (SELECT p, o, s FROM t) x WHERE x.s = 'ex:site/' || n_nationkey AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier) AND o <> 'cis:Site' ")
def merge_sites(spark, sf_dir):
    return refine.merge_sites(_heritage(spark, sf_dir), "cis:hasSite", "cis:Site", {"cis:siteAddress": "ex:hasPlace"}).select("s", "p", "o")


@query(f"SELECT 'ex:site/' || s_nationkey AS site, count(*) AS n, min({_INST}) AS first, 2 AS properties FROM supplier GROUP BY 1")
def site_sharing(spark, sf_dir):
    return refine.site_sharing(_heritage(spark, sf_dir), "cis:hasSite")


# Labels.
@query("SELECT 'ex:order/' || o_orderkey AS s, c_name || ' / ' || o_orderstatus AS label FROM orders JOIN customer ON c_custkey = o_custkey")
def composed_labels(spark, sf_dir):
    o, c = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer")
    status = F.concat(F.lit("ex:status/"), F.col("o_orderstatus"))
    t = union([
        graph(spark, sf_dir, "orders"), facts(c, iri("customer", "c_custkey"), LABEL, F.col("c_name")), facts(o, iri("order", "o_orderkey"), "ex:state", status, "iri"),
        facts(o.select("o_orderstatus").distinct(), status, LABEL, F.col("o_orderstatus")), facts(o, iri("order", "o_orderkey"), LABEL, F.lit("order")),
    ])
    return labels.composed(t, "ex:Order", ["ex:hasCustomer", "ex:state"], " / ").where((F.col("p") == LABEL) & F.col("s").startswith("ex:order/")).select("s", F.col("o").alias("label"))


@query(f"WITH {mapped('customer')} SELECT s, p, o, k AS o_kind, dt AS o_dt FROM t WHERE p <> 'ex:hasNation' UNION SELECT s, p, o, 'literal', 'xsd:anyURI' FROM t WHERE p = 'ex:hasNation' UNION SELECT s, 'rdfs:label', o, 'literal', '' FROM t WHERE p = 'ex:hasNation' UNION SELECT 'ex:Customer', 'rdfs:label', 'Cliente', 'literal', ''")
def configured_labels(spark, sf_dir):
    config = labels.Config(fix_labels={"ex:Customer": {"property": "ex:hasNation", "convert_to_anyuri": True}}, class_labels={"ex:Customer": {"it": "Cliente"}})
    old = facts(_read(spark, sf_dir, "customer"), iri("customer", "c_custkey"), LABEL, F.lit("old"))
    return labels.configured(graph(spark, sf_dir, "customer").unionByName(old), config).select("s", "p", "o", "o_kind", "o_dt")


@query(f"SELECT {_C} AS s, CASE WHEN c_custkey % 2 = 0 THEN 'me' ELSE c_name END AS label FROM customer")
def auto_labels(spark, sf_dir):
    now = facts(_read(spark, sf_dir, "customer"), iri("customer", "c_custkey"), LABEL, F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'me' ELSE 'a label that is by far longer than the name' END"))
    return labels.auto_labelled(graph(spark, sf_dir, "customer").unionByName(now), "ex:Customer").where(F.col("p") == LABEL).select("s", F.col("o").alias("label"))


@query("SELECT 'ex:Part' AS cls, p, count(*) AS n, round(avg(length(v)), 6) AS size FROM (SELECT 'ex:name' AS p, p_name AS v FROM part UNION ALL SELECT 'ex:brand', p_brand FROM part UNION ALL SELECT 'ex:type', p_type FROM part) GROUP BY p")
def text_lengths(spark, sf_dir):
    return labels.text_lengths(graph(spark, sf_dir, "part")).withColumn("size", F.round("size", 6))


@query("""WITH c AS (SELECT 'ex:part/' || p_partkey AS s, p_name, p_brand, p_type, split_part(p_type, ' ', 1) AS kind FROM part), m AS (SELECT kind, min(s) AS m FROM c GROUP BY kind), x AS (SELECT * FROM c JOIN m USING (kind))
SELECT m AS s, 'ex:type' AS p, p_type AS o FROM x UNION SELECT m, 'rdfs:label', kind FROM x UNION SELECT s, 'ex:name', p_name FROM x WHERE s = m UNION SELECT s, 'ex:brand', p_brand FROM x WHERE s = m UNION SELECT s, 'rdf:type', 'ex:Part' FROM x WHERE s = m
UNION SELECT 'ex:order/' || l_orderkey, 'ex:contains', m FROM lineitem JOIN x ON s = 'ex:part/' || l_partkey UNION SELECT 'ex:order/' || l_orderkey, 'ex:suppliedBy', 'ex:supplier/' || l_suppkey FROM lineitem""")
def classified_parts(spark, sf_dir):
    first = labels.classifier(lambda texts: [x.split(" ")[0] for x in texts])  # a stand-in for a language model
    return labels.merged_by_class(graph(spark, sf_dir, "part", "lineitem", repeats=True), "ex:Part", "ex:type", first).select("s", "p", "o")


# Query text.
@query("SELECT coalesce('quality ' || quality || ' toxic ' || toxic, 'none') AS label, count(DISTINCT d.doc_id) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def sparql_stats(spark, sf_dir):
    text = """PREFIX ex: <ex:> SELECT ?label (COUNT(DISTINCT ?d) AS ?n) WHERE { ?d a ex:Document . OPTIONAL { ?d ex:hasLabel ?l . ?l rdfs:label ?x } BIND(COALESCE(STR(?x), "none") AS ?label) } GROUP BY ?label ORDER BY DESC(?n)"""
    return sparql.query(graph(spark, sf_dir, "documents", "labels"), text)


@query("SELECT 'ex:supplier/' || x.s_suppkey AS s, 'ex:near' AS p, 'ex:supplier/' || y.s_suppkey AS o FROM supplier x JOIN supplier y USING (s_nationkey) WHERE 'ex:supplier/' || x.s_suppkey < 'ex:supplier/' || y.s_suppkey AND x.s_suppkey < 200")
def sparql_construct(spark, sf_dir):
    t = graph(spark, sf_dir, "supplier")
    few = _read(spark, sf_dir, "supplier").where("s_suppkey < 200")
    t = t.unionByName(facts(few, iri("supplier", "s_suppkey"), "ex:asked", F.lit("ex:yes"), "iri"))
    text = "CONSTRUCT { ?a ex:near ?b } WHERE { ?a a ex:Supplier ; ex:hasNation ?n ; ex:asked ex:yes . ?b a ex:Supplier ; ex:hasNation ?n . FILTER(STR(?a) < STR(?b)) }"
    return sparql.query(t, text).select("s", "p", "o")


@query("SELECT (EXISTS (SELECT 1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))) AS answer")
def sparql_ask(spark, sf_dir):
    return sparql.query(graph(spark, sf_dir, "documents", "labels"), "ASK { ?d a ex:Document . FILTER NOT EXISTS { ?d ex:hasLabel ?l } }")


@query("SELECT 'ex:turn/' || conv_id || '-' || turn AS b, role FROM conversations WHERE turn > 0 AND role IN ('user', 'assistant')")
def sparql_path(spark, sf_dir):
    text = 'SELECT DISTINCT ?b ?role WHERE { ?a ex:nextTurn+ ?b . ?b ex:role ?role . FILTER(?role IN ("user", "assistant")) }'
    return sparql.query(graph(spark, sf_dir, "conversations"), text)


@query(f"SELECT {_O} AS o, c_name AS name, CASE WHEN n_regionkey = 1 THEN n_name END AS nation FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus <> 'F' AND c_mktsegment <> 'BUILDING'")
def sparql_optional(spark, sf_dir):
    text = """SELECT ?o ?name ?nation WHERE { ?o a ex:Order ; ex:hasCustomer ?c ; ex:status ?s . ?c ex:name ?name ; ex:segment ?g . FILTER(?s != "F" && !(?g = "BUILDING")) OPTIONAL { ?c ex:hasNation ?n . ?n ex:inRegion ex:region/1 ; ex:name ?nation } }"""
    return sparql.query(graph(spark, sf_dir, "orders", "customer", "nation"), text)


@query("SELECT upper(n_name) AS name, 'nation' AS kind FROM nation WHERE n_name LIKE 'A%' OR contains(n_name, 'IN') UNION ALL SELECT upper(r_name), 'region' FROM region WHERE r_name LIKE 'A%' OR contains(r_name, 'IN')")
def sparql_union(spark, sf_dir):
    text = """SELECT (UCASE(?n) AS ?name) ?kind WHERE { { ?x a ex:Nation . BIND("nation" AS ?kind) } UNION { ?x a ex:Region . BIND("region" AS ?kind) } ?x ex:name ?n . FILTER(STRSTARTS(?n, "A") || CONTAINS(STR(?n), "IN")) }"""
    return sparql.query(graph(spark, sf_dir, "nation", "region"), text)


@query(f"WITH {mapped('customer')} SELECT s, p, o FROM t WHERE s IN (SELECT s FROM t WHERE p = 'ex:hasNation' AND o = 'ex:nation/3')")
def sparql_describe(spark, sf_dir):
    return sparql.query(graph(spark, sf_dir, "customer"), "DESCRIBE ?c WHERE { ?c ex:hasNation ?n }", {"n": "ex:nation/3"}).select("s", "p", "o")


# Files and text.
_DIRTY = """doc_id || E' \\\\ "q"\\t\\n' || lang"""


@query(f"SELECT 'ex:document/' || doc_id AS s, {_DIRTY} AS o, lang FROM documents")
def ntriples_round_trip(spark, sf_dir):
    text = F.concat(F.col("doc_id").cast("string"), F.lit(' \\ "q"\t\n'), "lang")
    t = facts(_read(spark, sf_dir, "documents"), iri("document", "doc_id"), "ex:text", text).withColumn("o_lang", F.lit("en"))
    return parse_ntriples(format_ntriples(t)).select("s", "o", F.expr("substr(o, -2)").alias("lang"))


@query("SELECT 'ex:nation/' || n_nationkey AS s, '<ex:nation/' || n_nationkey || E'> <ex:inRegion> <ex:region/' || n_regionkey || E'> ;\\n    <ex:name> \"' || n_name || E'\" ;\\n    a <ex:Nation> .' AS value FROM nation")
def turtle_text(spark, sf_dir):
    return turtle_blocks(graph(spark, sf_dir, "nation"))


@query("SELECT doc_id, text FROM documents")
def mojibake_round_trip(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    wrong = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    broken = F.when(F.col("text").rlike("[à-ÿÀ-ÿ]") & ~F.col("text").rlike("[^\\x00-\\u00ff]"), wrong).otherwise(F.col("text"))
    return d.select("doc_id", terms.repair(broken).alias("text"))


@query("""SELECT p_name, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^0-9a-zà-ÿ]+'), lambda x: len(x) >= 4))) AS tokens, lower(p_name) LIKE '%x%' AS odd FROM part""")
def distinctive_names(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_name", F.array_sort(terms.distinctive_tokens(F.col("p_name"))).alias("tokens"), F.lower("p_name").contains("x").alias("odd"))


@query("SELECT url, regexp_replace(regexp_replace(rtrim(url, '/#'), '^.*/', ''), '^.*#', '') AS term, regexp_replace(regexp_replace(url, '^.*/', ''), '^.*#', '') AS path, NOT regexp_matches(url, '://(de|fr)[.]wikipedia[.]org') AS allowed, regexp_matches(url, '^[A-Za-z0-9_-]+$') AS valid FROM (SELECT url FROM pages UNION ALL SELECT 'https://' || lang || '.wikipedia.org/wiki/X/' FROM (SELECT unnest(['de', 'fr', 'it', 'en']) AS lang))")
def iri_names(spark, sf_dir):
    more = spark.createDataFrame([(f"https://{x}.wikipedia.org/wiki/X/",) for x in ("de", "fr", "it", "en")], "url string")
    u = F.col("url")
    return _read(spark, sf_dir, "pages").select("url").union(more).select("url", terms.term_name(u).alias("term"), terms.path_name(u).alias("path"), terms.allowed_edition(u).alias("allowed"), terms.valid_id(u).alias("valid"))


# Service.
@query("SELECT lower(n_name) AS toponym, count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")
def zone_counts(spark, sf_dir):
    from .catalog import _addresses

    return service.zone_counts(_addresses(spark, sf_dir))


@query(f"SELECT s, first, n FROM (SELECT {_S} AS s, min({_S}) OVER (PARTITION BY s_nationkey) AS first, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) WHERE n > 1")
def same_place_members(spark, sf_dir):
    from .catalog import _addresses

    return service.place_members(_addresses(spark, sf_dir))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer WHERE contains(lower(c_name), '0001') ORDER BY c_name, id LIMIT 8")
def autocomplete(spark, sf_dir):
    names = _read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    return service.autocomplete(names, "0001")


@query("SELECT CAST(k AS VARCHAR) AS id, CASE WHEN k IN (SELECT c_custkey FROM customer) THEN 'ex:customer/' || k ELSE 'ex:supplier/' || k END AS s FROM (SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier)")
def resolved_ids(spark, sf_dir):
    c, s = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "supplier")
    t = union([facts(c, iri("customer", "c_custkey"), TYPE, F.lit("ex:Party"), "iri"), facts(s, iri("supplier", "s_suppkey"), TYPE, F.lit("ex:Party"), "iri")])
    ids = c.select(F.col("c_custkey").cast("string").alias("id")).union(s.select(F.col("s_suppkey").cast("string"))).distinct().union(spark.createDataFrame([("../1",)], "id string"))
    return service.resolve(t, ids, "ex:Party", ["ex:customer/", "ex:supplier/"])


_D = f"{_INST} AS s"


@query("""SELECT 'inst/' || s_suppkey AS k, s_name AS name, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 4 <> 3 THEN 'note ' || s_name END AS note, CAST(s_nationkey AS DOUBLE) AS lat, CAST(s_suppkey % 180 AS DOUBLE) AS lon,
CASE s_suppkey % 4 WHEN 0 THEN 'Non accessibile' WHEN 1 THEN 'Parzialmente accessibile' WHEN 2 THEN 'Totalmente accessibile' ELSE 'Da verificare' END AS "accessLabel",
CASE WHEN s_suppkey % 2 = 0 THEN ['http://site/' || s_suppkey] ELSE [] END AS websites, CASE WHEN s_suppkey % 2 = 0 THEN [s_name || '@x'] ELSE [] END AS emails FROM supplier""")
def institute_details(spark, sf_dir):
    """Details of the refined graph."""
    out = service.details(refined(spark, sf_dir), _NAMES)
    return out.select(F.concat(F.lit("inst/"), "id").alias("k"), "name", "note", "lat", "lon", "accessLabel", "websites", "emails")


@query(f"""{_TBOX}, pr AS (SELECT DISTINCT s FROM tb WHERE o = 'owl:ObjectProperty')
SELECT s AS "from", o AS "to", 'subClassOf' AS label, true AS dashes, false AS bidirectional FROM tb WHERE p = 'rdfs:subClassOf' AND k = 'iri' UNION ALL
SELECT d.o, r.o, {local('pr.s')}, false, false FROM pr JOIN tb d ON d.s = pr.s AND d.p = 'rdfs:domain' JOIN tb r ON r.s = pr.s AND r.p = 'rdfs:range'""")
def ontology_edges(spark, sf_dir):
    return service.ontology_view(build_tbox(spark, sf_dir))[1]


@query(f"{_TBOX} SELECT DISTINCT s AS id, {local('s')} AS label FROM tb WHERE o = 'owl:Class'")
def ontology_nodes(spark, sf_dir):
    return service.ontology_view(build_tbox(spark, sf_dir))[0]


@query(f"""SELECT root, id, label, kind FROM (SELECT {_O} AS root, {_O} AS id, CAST(o_orderkey AS VARCHAR) AS label, 'Order' AS kind FROM orders UNION ALL SELECT {_O}, 'ex:customer/' || o_custkey, CAST(o_custkey AS VARCHAR), 'Customer' FROM orders
UNION ALL SELECT {_O}, 'ex:nation/' || c_nationkey, CAST(c_nationkey AS VARCHAR), 'Other' FROM orders JOIN customer ON c_custkey = o_custkey)""")
def neighbour_nodes(spark, sf_dir):
    t = graph(spark, sf_dir, "orders", "customer")
    return service.neighbourhood_graph(t, patterns.pattern(t, "?root", TYPE, "ex:Order"), ["ex:hasCustomer", "ex:hasNation"], {"ex:Order": "Order", "ex:Customer": "Customer"})[0]


@query("SELECT 'label' AS property, 'a label' AS description, true AS \"existsMissing\", false AS complete WHERE EXISTS (SELECT 1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))")
def completeness(spark, sf_dir):
    return service.complete(graph(spark, sf_dir, "documents", "labels"), "ex:Document", "label", {"label": ("ex:hasLabel", "a label")})


@query(f"SELECT {_INST} AS s, 'ac:hasAccessCondition' AS p, min('ex:access/' || s_suppkey) OVER () AS o FROM supplier WHERE false UNION ALL SELECT 'ex:new', 'ac:hasAccessCondition', 'ex:access/' || s_suppkey FROM supplier WHERE s_suppkey % 4 = 2")
def give_access(spark, sf_dir):
    t = _heritage(spark, sf_dir).unionByName(spark.createDataFrame([("ex:new", TYPE, _NAMES.main, "iri", "", "")], ", ".join(f"{c} string" for c in COLUMNS)))
    return service.give_access(t, "ex:new", "totalmente accessibile", ["totalmente accessibile"], _NAMES).select("s", "p", "o")


# A second graph: parts as resources of the world, with labels in two languages, types and mutual links.
def _world(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    s = F.concat(F.lit("w:"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"))
    kind = F.concat(F.lit("wo:"), F.element_at(F.split("p_type", " "), 1))
    cls = F.concat(F.lit("w:"), F.element_at(F.split("p_type", " "), 1))
    lang = lambda df, x: df.withColumn("o_lang", F.lit(x))
    return union([
        lang(facts(p, s, LABEL, F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))), "it"), facts(p, s, TYPE, kind, "iri"), facts(p, s, "ex:about", F.expr("CASE WHEN p_partkey % 3 <> 0 THEN 'w:City' ELSE 'w:Else' END"), "iri"),
        lang(facts(p.select(cls.alias("c")).distinct(), F.col("c"), LABEL, F.substr("c", F.lit(3))), "en"), facts(p, cls, "ex:link", s, "iri"), facts(p.where("p_partkey % 2 = 0"), s, "ex:link", cls, "iri"),
        lang(facts(p, s, LABEL, F.col("p_brand")), "en"), facts(p, s, "ex:subject", F.col("p_brand")), facts(p, s, "ex:subject", F.col("p_name")), facts(p, s, "ex:home", F.concat(F.lit("http://de.wikipedia.org/wiki/"), "p_brand"), "iri"),
    ])


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, 'w:' || replace(p_name, ' ', '_') || '_' || p_partkey AS s FROM part WHERE p_partkey % 3 <> 0")
def linked_exact(spark, sf_dir):
    w = _world(spark, sf_dir)
    names = _read(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").cast("string").alias("id"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"))
    return service.linked(w, names, "w:", service.about(w, ["w:City"], ["City"]))


@query("SELECT 'w:' || replace(p_name, ' ', '_') || '_' || p_partkey AS s, 'w:' || split_part(p_type, ' ', 1) AS concept, split_part(p_type, ' ', 1) AS label FROM part")
def general_concepts(spark, sf_dir):
    w = _world(spark, sf_dir)
    return service.general_concepts(w, w.where(F.col("p") == TYPE).select("s").distinct(), "wo:", "w:")


@query("WITH l AS (SELECT 'w:' || split_part(p_type, ' ', 1) AS concept, 'w:' || replace(p_name, ' ', '_') || '_' || p_partkey AS s, p_brand AS label FROM part WHERE p_partkey % 2 = 0) SELECT concept, s, label FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY s) AS k FROM l) WHERE k <= 4")
def related_concepts(spark, sf_dir):
    w = _world(spark, sf_dir)
    concepts = _read(spark, sf_dir, "part").select(F.concat(F.lit("w:"), F.element_at(F.split("p_type", " "), 1)).alias("concept")).distinct()
    return service.related_concepts(w, concepts, "ex:link", "w:")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, 'ex:subject' AS p, least(p_brand, p_name) AS o FROM part")
def described_links(spark, sf_dir):
    w = _world(spark, sf_dir)
    links = w.where(F.col("p") == TYPE).select(F.regexp_extract("s", "_([0-9]+)$", 1).alias("id"), "s")
    return service.described(w, links, {"ex:subject": 1, "ex:home": 2}).select("id", "p", "o")


# Validation.
def _after(spark, sf_dir):
    """Parts made one, without brands ending in 1, with a schema that declares some."""
    t = rewrites.dedup_individuals(graph(spark, sf_dir, "part"), "ex:Part")
    said = [("ex:name", TYPE, "owl:DatatypeProperty", "iri", "", ""), ("ex:Other", TYPE, "owl:Class", "iri", "", "")]
    return t.where(~((F.col("p") == "ex:brand") & F.col("o").endswith("1"))).unionByName(spark.createDataFrame(said, ", ".join(f"{c} string" for c in COLUMNS)))


_COVER = """WITH c AS (SELECT 'ex:part/' || p_partkey AS s, min('ex:part/' || p_partkey) OVER (PARTITION BY p_name, p_brand, p_type) AS m, * FROM part),
f AS (SELECT 'individual' AS "check", s, NULL AS p, 'ex:Part' AS o FROM c WHERE s <> m UNION ALL SELECT 'value', s, 'ex:brand', p_brand FROM c WHERE s = m AND p_brand LIKE '%1'
UNION ALL SELECT 'class', 'ex:Part', NULL, NULL UNION ALL SELECT 'property', p, NULL, NULL FROM (SELECT unnest(['ex:brand', 'ex:type']) AS p) UNION ALL SELECT 'excluded', NULL, NULL, NULL FROM c WHERE false)"""


@query(f'{_COVER} SELECT "check", s, p, o FROM f')
def coverage(spark, sf_dir):
    return validation.coverage(graph(spark, sf_dir, "part"), _after(spark, sf_dir))


@query(f"""{_COVER} SELECT x.c AS "check", CAST((SELECT count(*) FROM f WHERE "check" = x.c) AS BIGINT) AS n FROM (SELECT unnest(['individual', 'value', 'type', 'class', 'property', 'excluded']) AS c) x UNION ALL SELECT 'ok', CAST(NOT EXISTS (SELECT 1 FROM f WHERE "check" <> 'excluded') AS BIGINT)""")
def coverage_summary(spark, sf_dir):
    return validation.coverage_summary(coverage(spark, sf_dir))


@query("""WITH l AS (SELECT lower(p_name || ' ' || p_brand) AS label, min('ex:part/' || p_partkey) AS a, max('ex:part/' || p_partkey) AS b FROM part GROUP BY 1 HAVING count(*) = 2),
v AS (SELECT 'ex:part/' || p_partkey AS s, unnest(['ex:brand', 'ex:type', 'ex:name', 'ex:own']) AS p, unnest([p_brand, p_type, p_name, CASE WHEN p_partkey % 2 = 0 THEN 'even' END]) AS v FROM part)
SELECT label, a, b, x.p, x.v AS x, y.v AS y FROM l JOIN v x ON x.s = a JOIN v y ON y.s = b AND y.p = x.p WHERE x.v IS DISTINCT FROM y.v""")
def duplicate_pairs(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    label = facts(p, iri("part", "p_partkey"), LABEL, F.concat_ws(" ", "p_name", "p_brand"))
    own = facts(p.where("p_partkey % 2 = 0"), iri("part", "p_partkey"), "ex:own", F.lit("even"))
    return validation.duplicate_pairs(union([graph(spark, sf_dir, "part"), label, own]))


@query("SELECT 'ex:nation/' || s_nationkey AS s, 'ex:member' AS p, 'values' AS why FROM supplier GROUP BY s_nationkey HAVING count(*) > 1 UNION ALL SELECT 'ex:nation/' || s_nationkey, 'ex:member', 'datatype' FROM supplier GROUP BY s_nationkey")
def literal_clashes(spark, sf_dir):
    t = facts(_read(spark, sf_dir, "supplier"), iri("nation", "s_nationkey"), "ex:member", F.col("s_name"))
    return validation.literal_clashes(t, spark.createDataFrame([("ex:member",)], "p string"), spark.createDataFrame([("ex:member", "xsd:integer")], "p string, cls string"))


@query(f"""{_SHOP_SQL} SELECT 'class' AS section, {local('cls')} AS item, '' AS detail, CAST(members AS BIGINT) AS n FROM size UNION ALL SELECT DISTINCT 'property', {local('p')}, CASE WHEN k = 'literal' THEN 'data' ELSE 'object' END, 1 FROM own
UNION ALL SELECT 'role', {local('p')}, role || ' ' || {local('cls')}, n FROM roles UNION ALL SELECT 'mark', {local('p')}, 'functional', 1 FROM (SELECT p FROM fun WHERE functional UNION ALL SELECT p FROM fdata WHERE functional)
UNION ALL SELECT 'mark', {local('p')}, 'inverse_functional', 1 FROM inv WHERE inverse_functional UNION ALL SELECT 'mark', {local('p')}, 'symmetric', 1 FROM sym WHERE "symmetric" UNION ALL SELECT 'mark', {local('p')}, 'transitive', 1 FROM tra WHERE transitive
UNION ALL SELECT 'datatype', {local('p')}, 'xsd:string', count(*) FROM own WHERE k = 'literal' GROUP BY p UNION ALL SELECT 'subclass', {local('child')}, {local('parent')}, 1 FROM sub UNION ALL SELECT 'disjoint', {local('a')}, {local('b')}, 1 FROM dis
UNION ALL SELECT 'restriction', {local('cls')} || '.' || {local('p')}, CASE WHEN min_n = max_n THEN 'exact ' || min_n ELSE 'min ' || min_n || ' max ' || max_n END, 1 FROM card WHERE min_n > 0 OR max_n < 999
UNION ALL SELECT 'confidence', {local('p')} || '.' || role, CASE WHEN confidence > 0.75 THEN 'accepted' ELSE 'below' END, CAST(round(confidence * 1000) AS BIGINT) FROM conf""")
def induction_report(spark, sf_dir):
    return validation.report(schema.analyse(graph(spark, sf_dir, *_SHOP)), TAU_DOMAIN)


@query(f"{_SHOP_SQL} SELECT p, role, cls FROM conf WHERE NOT (p = 'ex:name' AND role = 'domain')")
def reviewed_axioms(spark, sf_dir):
    """A plug-in rejects one axiom below the threshold; one above it cannot be rejected."""
    a = schema.analyse(graph(spark, sf_dir, *_SHOP))
    low = a.confidence.where("p = 'ex:name'").withColumn("confidence", F.lit(0.5)).unionByName(a.confidence.where("p != 'ex:name'"))
    a.confidence = low
    said = enrich.ask(lambda prompts: ['```json\n{"name.domain": {"decision": "REJECT", "reason": "too broad"}, "segment.domain": {"decision": "REJECT"}}\n```'], enrich.review_prompt(a, TAU_DOMAIN))
    return enrich.reviewed(a, said, TAU_DOMAIN).confidence.select("p", "role", "cls")


@query(f"{_TBOX} SELECT s, p, o FROM tb WHERE NOT (s = 'ex:Customer' AND p = 'rdfs:label') UNION SELECT 'ex:Customer', 'rdfs:label', 'Cliente' UNION SELECT 'ex:Customer', 'rdfs:subClassOf', 'ex:Nation' UNION SELECT 'ex:hasNation', 'rdf:type', 'owl:SymmetricProperty'")
def enriched_tbox(spark, sf_dir):
    """The answer of a plug-in: a label, a subclass and a characteristic."""
    a = schema.analyse(graph(spark, sf_dir, *_SHOP))
    answer = '{"class_enrichments": {"Customer": {"label_it": "Cliente"}}, "property_enrichments": {"hasNation": {"symmetric": true}}, "extra_subclassof": [["Customer", "Nation"], ["Customer", "Nobody"]]}'
    a, words, _ = enrich.enriched(a, enrich.ask(lambda prompts: [f"Here it is: {answer} ."], enrich.enrich_prompt(a)))
    return enrich.with_labels(schema.build_tbox(a), words).select("s", "p", "o")


from .catalog import QUERIES  # noqa: E402

QUERIES["refined"] = refined
