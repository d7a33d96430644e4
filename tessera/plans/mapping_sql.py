"""The direct mapping in SQL: what oracles derive their answers from, as a common table t(s, p, o, k, dt, lang)."""

from __future__ import annotations

from ..sources.vocabulary import SKIPPED

_IRI, _TEXT = "'iri', '', ''", "'literal', '', ''"


def _rows(table: str, s: str, *said: tuple[str, str, bool]) -> list[str]:
    return [f"SELECT {s}, '{p}', {o}, {_IRI if iri else _TEXT} FROM {table} WHERE {o} IS NOT NULL" for p, o, iri in said]


_TABLES = {
    "documents": _rows("documents", "'ex:document/' || doc_id", ("rdf:type", "'ex:Document'", True), ("ex:lang", "lang", False), ("ex:source", "source", False)),
    "labels": _rows("labels", "'ex:document/' || doc_id", ("ex:hasLabel", "'ex:label/q' || quality || 't' || toxic", True)) + _rows("labels", "'ex:label/q' || quality || 't' || toxic", ("rdfs:label", "'quality ' || quality || ' toxic ' || toxic", False)),
    "customer": _rows("customer", "'ex:customer/' || c_custkey", ("rdf:type", "'ex:Customer'", True), ("ex:name", "c_name", False), ("ex:hasNation", "'ex:nation/' || c_nationkey", True), ("ex:segment", "c_mktsegment", False)),
    "supplier": _rows("supplier", "'ex:supplier/' || s_suppkey", ("rdf:type", "'ex:Supplier'", True), ("ex:name", "s_name", False), ("ex:hasNation", "'ex:nation/' || s_nationkey", True)),
    "nation": _rows("nation", "'ex:nation/' || n_nationkey", ("rdf:type", "'ex:Nation'", True), ("ex:name", "n_name", False), ("ex:inRegion", "'ex:region/' || n_regionkey", True)),
    "region": _rows("region", "'ex:region/' || r_regionkey", ("rdf:type", "'ex:Region'", True), ("ex:name", "r_name", False)),
    "part": _rows("part", "'ex:part/' || p_partkey", ("rdf:type", "'ex:Part'", True), ("ex:name", "p_name", False), ("ex:brand", "p_brand", False), ("ex:type", "p_type", False)),
    "orders": _rows("orders", "'ex:order/' || o_orderkey", ("rdf:type", "'ex:Order'", True), ("ex:hasCustomer", "'ex:customer/' || o_custkey", True), ("ex:status", "o_orderstatus", False), ("ex:priority", "o_orderpriority", False)),
    "lineitem": _rows("lineitem", "'ex:order/' || l_orderkey", ("ex:contains", "'ex:part/' || l_partkey", True), ("ex:suppliedBy", "'ex:supplier/' || l_suppkey", True)),
}


def mapped(*tables: str, more: str = "", name: str = "t") -> str:
    """The common table of these tables' triples, and of the rows of more (SQL of six columns), as a set."""
    parts = [x for n in tables for x in _TABLES[n]] + ([more] if more else [])
    return f"{name}(s, p, o, k, dt, lang) AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(parts)}))"


_SKIP = ", ".join(f"'{x}'" for x in SKIPPED)
#: What induction counts, over t.
COUNTED = f"""
ty AS (SELECT DISTINCT s, o AS cls FROM t WHERE p = 'rdf:type' AND k = 'iri'),
own AS (SELECT * FROM t WHERE p NOT IN ({_SKIP})),
edges AS (SELECT DISTINCT s, p, o FROM own WHERE k = 'iri'),
roles AS (SELECT p, 'domain' AS role, cls, count(*) AS n FROM own JOIN ty USING (s) GROUP BY p, cls
          UNION ALL SELECT p, 'range', cls, count(*) FROM edges JOIN (SELECT s AS o, cls FROM ty) USING (o) GROUP BY p, cls),
conf AS (SELECT p, role, cls, n / total AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY p, role ORDER BY n DESC, cls) AS r FROM roles)
         JOIN (SELECT p, count(*)::DOUBLE AS total FROM own GROUP BY p) USING (p) WHERE r = 1),
overlap AS (SELECT a.cls AS a, b.cls AS b, count(*) / (SELECT count(*) FROM ty x WHERE x.cls = a.cls)::DOUBLE AS overlap FROM ty a JOIN ty b ON a.s = b.s AND a.cls <> b.cls GROUP BY a.cls, b.cls),
ranked AS (SELECT cls, count(DISTINCT p) AS props FROM roles WHERE role = 'domain' GROUP BY cls),
sub AS (SELECT a AS child, b AS parent FROM overlap x WHERE overlap > 0.7 AND (NOT EXISTS (SELECT 1 FROM overlap y WHERE y.a = x.b AND y.b = x.a AND y.overlap > 0.7)
        OR (coalesce((SELECT props FROM ranked WHERE cls = a), 0), length(a), a) > (coalesce((SELECT props FROM ranked WHERE cls = b), 0), length(b), b))),
dis AS (SELECT x.cls AS a, y.cls AS b FROM ranked x JOIN ranked y ON x.cls < y.cls WHERE NOT EXISTS (SELECT 1 FROM roles r JOIN roles q ON r.p = q.p AND r.role = 'domain' AND q.role = 'domain' WHERE r.cls = x.cls AND q.cls = y.cls)
        AND NOT EXISTS (SELECT 1 FROM sub WHERE (child = x.cls AND parent = y.cls) OR (child = y.cls AND parent = x.cls))),
fun AS (SELECT p, max(n) <= 1 AS functional FROM (SELECT p, s, count(*) AS n FROM edges GROUP BY p, s) GROUP BY p),
inv AS (SELECT p, max(n) <= 1 AS inverse_functional FROM (SELECT p, o, count(*) AS n FROM edges GROUP BY p, o) GROUP BY p),
sym AS (SELECT e.p, count(*) = count(b.s) AS "symmetric" FROM edges e LEFT JOIN edges b ON b.p = e.p AND b.s = e.o AND b.o = e.s GROUP BY e.p),
tra AS (SELECT p, p IN (SELECT a.p FROM edges a JOIN edges b ON a.p = b.p AND a.o = b.s JOIN edges c ON c.p = a.p AND c.s = a.s AND c.o = b.o WHERE a.s <> b.o) AS transitive FROM edges GROUP BY p),
invp AS (SELECT x.p, y.p AS q FROM edges x JOIN edges y ON x.s = y.o AND x.o = y.s AND x.p < y.p GROUP BY x.p, y.p
         HAVING count(*) = (SELECT count(*) FROM edges z WHERE z.p = x.p) AND count(*) = (SELECT count(*) FROM edges z WHERE z.p = y.p)),
fdata AS (SELECT p, max(n) <= 1 AS functional FROM (SELECT p, s, count(DISTINCT o) AS n FROM own WHERE k = 'literal' GROUP BY p, s) GROUP BY p),
size AS (SELECT cls, count(*) AS members FROM ty GROUP BY cls),
card AS (SELECT cls, p, CASE WHEN count(*) < min(members) THEN 0 ELSE min(n) END AS min_n, max(n) AS max_n
         FROM (SELECT s, p, count(*) AS n FROM edges GROUP BY s, p) JOIN ty USING (s) JOIN size USING (cls) GROUP BY cls, p)
"""


def local(c: str) -> str:
    """What follows the last / or # and then the last : of a name."""
    return f"regexp_replace({c}, '^.*[/#:]', '')"
