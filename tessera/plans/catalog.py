"""Registered queries over the mapped tables, each beside SQL for the same rows from the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import terms
from ..operators import induction, patterns, rewrites, service, validation, vectors
from ..sources.triples import TYPE, facts, graph, iri, union
from .mapping_sql import COUNTED, mapped

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_C, _S, _N, _O = "'ex:customer/' || c_custkey", "'ex:supplier/' || s_suppkey", "'ex:nation/' || n_nationkey", "'ex:order/' || o_orderkey"
_LABEL = "'quality ' || quality || ' toxic ' || toxic"


_RELATED = """
SELECT 'ex:customer/' || c_custkey AS s, 'ex:partOf' AS p, 'ex:nation/' || c_nationkey AS o FROM customer
UNION ALL SELECT 'ex:nation/' || n_nationkey, 'ex:partOf', 'ex:region/' || n_regionkey FROM nation
UNION ALL SELECT 'ex:customer/' || c_custkey, 'ex:partOf', 'ex:region/' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 'ex:supplier/' || x.s_suppkey, 'ex:near', 'ex:supplier/' || y.s_suppkey FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey <> y.s_suppkey AND abs(x.s_suppkey - y.s_suppkey) < 100
UNION ALL SELECT 'ex:nation/' || c_nationkey, 'ex:hasMember', 'ex:customer/' || c_custkey FROM customer
UNION ALL SELECT 'ex:customer/' || c_custkey, 'ex:memberOf', 'ex:nation/' || c_nationkey FROM customer"""
_RELATIONS = f"WITH {mapped(more=f"SELECT s, p, o, 'iri', '', '' FROM ({_RELATED})")}, {COUNTED}"
_SHOP_SQL = f"WITH {mapped('customer', 'supplier', 'nation', 'region', 'orders')}, {COUNTED}"


@query(f"SELECT coalesce({_LABEL}, 'none') AS label, count(DISTINCT d.doc_id) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def stats_by_label(spark, sf_dir):
    return service.stats(graph(spark, sf_dir, "documents", "labels"), "ex:Document", "ex:hasLabel", "none")


@query("SELECT CAST(sum(n) AS BIGINT) AS total FROM (SELECT count(DISTINCT d.doc_id) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY quality, toxic)")
def stats_total(spark, sf_dir):
    return stats_by_label(spark, sf_dir).agg(F.sum("n").alias("total"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer")
def list_individuals(spark, sf_dir):
    return service.listing(graph(spark, sf_dir, "customer"), "ex:Customer")


@query(f"SELECT {_C} AS s, c_name AS name, c_mktsegment AS segment FROM customer")
def bgp_star(spark, sf_dir):
    return patterns.bgp(graph(spark, sf_dir, "customer"), ("?s", TYPE, "ex:Customer"), ("?s", "ex:name", "?name"), ("?s", "ex:segment", "?segment"))


@query("SELECT r_name AS region, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def bgp_path(spark, sf_dir):
    t = graph(spark, sf_dir, "orders", "customer", "nation", "region")
    found = patterns.bgp(t, ("?order", "ex:hasCustomer", "?c"), ("?c", "ex:hasNation", "?n"), ("?n", "ex:inRegion", "?r"), ("?r", "ex:name", "?region"))
    return found.groupBy("region").agg(F.count("*").alias("n"))


@query(f"SELECT 'ex:document/' || d.doc_id AS d, {_LABEL} AS label FROM documents d LEFT JOIN labels l USING (doc_id)")
def optional_two_hops(spark, sf_dir):
    t = graph(spark, sf_dir, "documents", "labels")
    right = patterns.bgp(t, ("?d", "ex:hasLabel", "?l"), ("?l", "rdfs:label", "?label")).select("d", "label")
    return patterns.optional(patterns.pattern(t, "?d", TYPE, "ex:Document"), right)


@query(f"SELECT {_O} AS o, {_C} AS c, c_name AS name, n_name AS nation FROM orders LEFT JOIN (customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey = 1) ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING'")
def optional_nested(spark, sf_dir):
    t = graph(spark, sf_dir, "orders", "customer", "nation")
    c = patterns.bgp(t, ("?c", "ex:segment", "BUILDING"), ("?c", "ex:name", "?name"), ("?c", "ex:hasNation", "?k"))
    inner = patterns.optional(c, patterns.bgp(t, ("?k", "ex:inRegion", "ex:region/1"), ("?k", "ex:name", "?nation"))).drop("k")
    left = patterns.bgp(t, ("?o", TYPE, "ex:Order"), ("?o", "ex:hasCustomer", "?_c"))
    return left.join(inner, F.col("_c") == F.col("c"), "left").drop("_c")


@query(f"SELECT {_N} AS n, coalesce(CASE WHEN n_regionkey = 0 THEN n_name END, r_name) AS v FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND (n_regionkey <> 0 OR r_name = n_name)")
def optional_shared_variable(spark, sf_dir):
    t = graph(spark, sf_dir, "nation", "region")
    all_ = patterns.pattern(t, "?n", TYPE, "ex:Nation")
    first = patterns.optional(all_, patterns.bgp(t, ("?n", "ex:inRegion", "ex:region/0"), ("?n", "ex:name", "?v")))
    return patterns.optional(first, patterns.bgp(t, ("?n", "ex:inRegion", "?r"), ("?r", "ex:name", "?v")).drop("r"), ("v",))


@query("SELECT 'ex:document/' || doc_id AS inst FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def not_exists_label(spark, sf_dir):
    return service.missing(graph(spark, sf_dir, "documents", "labels"), "ex:Document", "ex:hasLabel")


@query(f"SELECT {_C} AS s, c_mktsegment AS v FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def filter_in(spark, sf_dir):
    return patterns.pattern(graph(spark, sf_dir, "customer"), "?s", "ex:segment", "?v").where(F.col("v").isin("BUILDING", "MACHINERY"))


@query(f"SELECT 'ex:hasNation' AS p, count(*) AS n FROM customer UNION ALL SELECT '{TYPE}', count(*) FROM customer")
def filter_isiri(spark, sf_dir):
    return graph(spark, sf_dir, "customer").where("o_kind = 'iri'").groupBy("p").agg(F.count("*").alias("n"))


@query(f"SELECT p, o FROM (SELECT '{TYPE}' AS p, 'ex:Customer' AS o UNION ALL SELECT 'ex:name', c_name FROM customer WHERE c_custkey = 1 UNION ALL SELECT 'ex:segment', c_mktsegment FROM customer WHERE c_custkey = 1 UNION ALL SELECT 'ex:hasNation', 'ex:nation/' || c_nationkey FROM customer WHERE c_custkey = 1)")
def predicate_variable(spark, sf_dir):
    return patterns.pattern(graph(spark, sf_dir, "customer"), "ex:customer/1", "?p", "?o")


@query("SELECT c_name AS name FROM customer WHERE c_custkey = 7")
def bound_parameter(spark, sf_dir):
    t = graph(spark, sf_dir, "customer")
    return spark.sql("SELECT o AS name FROM {t} WHERE s = :inst AND p = 'ex:name'", args={"inst": "ex:customer/7"}, t=t)


@query("SELECT EXISTS (SELECT 1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS answer")
def ask_missing_label(spark, sf_dir):
    return patterns.ask(not_exists_label(spark, sf_dir))


@query("SELECT EXISTS (SELECT 1 FROM customer WHERE c_nationkey IS NULL) AS answer")
def ask_missing_nation(spark, sf_dir):
    return patterns.ask(service.missing(graph(spark, sf_dir, "customer"), "ex:Customer", "ex:hasNation"))


@query("SELECT 'ex:document/' || doc_id AS s, 'ex:hasLabel' AS p, 'ex:label/unknown' AS o FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def construct_label(spark, sf_dir):
    return service.set_value(graph(spark, sf_dir, "documents", "labels"), "ex:Document", "ex:hasLabel", "ex:label/unknown").select("s", "p", "o")


def _addresses(spark, sf_dir):
    t = graph(spark, sf_dir, "supplier", "nation")
    found = patterns.bgp(t, ("?s", TYPE, "ex:Supplier"), ("?s", "ex:hasNation", "?k"), ("?k", "ex:name", "?nation"), ("?s", "ex:name", "?own"))
    return found.select("s", F.concat_ws(", ", "nation", "own").alias("address"))


@query("SELECT 'ex:supplier/' || x.s_suppkey AS a, 'ex:supplier/' || y.s_suppkey AS b FROM supplier x JOIN supplier y USING (s_nationkey) WHERE 'ex:supplier/' || x.s_suppkey < 'ex:supplier/' || y.s_suppkey")
def construct_same_place(spark, sf_dir):
    return service.same_place(_addresses(spark, sf_dir))


@query(f"SELECT lower(n_name) AS toponym, count(*) AS n, min({_S}) AS first, list_sort(list({_S})) AS members FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1 HAVING count(*) > 1")
def groups_same_place(spark, sf_dir):
    return service.place_groups(_addresses(spark, sf_dir))


@query("SELECT 'ex:turn/' || x.conv_id || '-' || x.turn AS a, 'ex:turn/' || y.conv_id || '-' || y.turn AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND x.turn < y.turn")
def path_plus_turns(spark, sf_dir):
    return patterns.path_plus(patterns.pattern(graph(spark, sf_dir, "conversations"), "?a", "ex:nextTurn", "?b"))


@query("WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey + 1) % 25 AS b FROM nation), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, b FROM r")
def path_plus_cyclic(spark, sf_dir):
    return patterns.path_plus(_read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") + 1) % 25).alias("b")))


@query(f"SELECT 'ex:order/' || o_orderkey AS root, {_O} AS s, 'ex:hasCustomer' AS p, 'ex:customer/' || o_custkey AS o, 1 AS hop FROM orders UNION ALL SELECT {_O}, 'ex:customer/' || o_custkey, 'ex:hasNation', 'ex:nation/' || c_nationkey, 2 FROM orders JOIN customer ON c_custkey = o_custkey")
def two_hop_neighbourhood(spark, sf_dir):
    t = graph(spark, sf_dir, "orders", "customer")
    return patterns.neighbourhood(t, patterns.pattern(t, "?root", TYPE, "ex:Order"), ["ex:hasCustomer", "ex:hasNation"])


_LON, _LAT = "((s_suppkey * 37) % 360 - 180)", "((s_suppkey * 53) % 180 - 90)"


@query(f"WITH p AS (SELECT {_S} AS id, CAST({_LON} AS DOUBLE) AS lon, CAST({_LAT} AS DOUBLE) AS lat FROM supplier), x AS (SELECT * FROM p WHERE id = 'ex:supplier/1') SELECT p.id, round(2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(p.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - x.lon) / 2), 2)))), 2) AS km FROM p, x WHERE p.id <> x.id ORDER BY km, p.id LIMIT 5")
def nearby_top5(spark, sf_dir):
    places = _read(spark, sf_dir, "supplier").select(iri("supplier", "s_suppkey").alias("id"), F.expr(f"'POINT(' || {_LON} || ' ' || {_LAT} || ')'").alias("wkt"))
    return service.nearby(places, "ex:supplier/1")


_SHOP = ("customer", "supplier", "nation", "region", "orders")


@query(f"{_SHOP_SQL} SELECT p, role, cls, n FROM roles")
def property_domain_range(spark, sf_dir):
    return induction.domain_range(graph(spark, sf_dir, *_SHOP))


_CONF = """SELECT 'ex:hasNation' AS p, 'domain' AS role, 'ex:Customer' AS cls, round(c / (c + s), 6) AS confidence FROM x UNION ALL SELECT 'ex:hasNation', 'range', 'ex:Nation', 1.0 FROM x
UNION ALL SELECT 'ex:name', 'domain', 'ex:Customer', round(c / (c + s), 6) FROM x UNION ALL SELECT 'ex:segment', 'domain', 'ex:Customer', 1.0 FROM x"""
_CS = "WITH x AS (SELECT (SELECT count(*) FROM customer)::DOUBLE AS c, (SELECT count(*) FROM supplier)::DOUBLE AS s)"


def _people(spark, sf_dir):
    return union([graph(spark, sf_dir, "customer", "supplier"), graph(spark, sf_dir, "nation").where(F.col("p") == TYPE)])


@query(f"{_CS} {_CONF}")
def property_confidence(spark, sf_dir):
    return induction.confidence(_people(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query(f"{_CS} SELECT p, role, cls FROM ({_CONF}) WHERE confidence > 0.75")
def domain_axioms(spark, sf_dir):
    return induction.accepted(induction.confidence(_people(spark, sf_dir))).select("p", "role", "cls")


def _urgent(spark, sf_dir):
    urgent = _read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey").distinct()
    return union([graph(spark, sf_dir, "customer").where(F.col("p") == TYPE), facts(urgent, iri("customer", "o_custkey"), TYPE, F.lit("ex:UrgentCustomer"), "iri")])


_URGENT = f"WITH {mapped(more="SELECT 'ex:customer/' || o_custkey, 'rdf:type', 'ex:UrgentCustomer', 'iri', '', '' FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'ex:customer/' || c_custkey, 'rdf:type', 'ex:Customer', 'iri', '', '' FROM customer")}, {COUNTED}"


_U = "WITH x AS (SELECT (SELECT count(*) FROM customer)::DOUBLE AS c, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderpriority = '1-URGENT')::DOUBLE AS u)"


@query(f"{_U} SELECT 'ex:UrgentCustomer' AS a, 'ex:Customer' AS b, 1.0::DOUBLE AS overlap FROM x UNION ALL SELECT 'ex:Customer', 'ex:UrgentCustomer', round(u / c, 6) FROM x")
def class_overlap(spark, sf_dir):
    return induction.overlaps(_urgent(spark, sf_dir)).withColumn("overlap", F.round("overlap", 6))


@query(f"{_URGENT} SELECT child, parent FROM sub")
def subclass_axioms(spark, sf_dir):
    return induction.subclasses(_urgent(spark, sf_dir))


_EDGES = "SELECT 'ex:hasCustomer' AS p, 'o' || o_orderkey AS s, 'c' || o_custkey AS o FROM orders UNION SELECT 'ex:contains', 'o' || l_orderkey, 'p' || l_partkey FROM lineitem UNION SELECT 'ex:suppliedBy', 'o' || l_orderkey, 's' || l_suppkey FROM lineitem"


@query(f"WITH e AS ({_EDGES}), f AS (SELECT p, max(n) <= 1 AS functional FROM (SELECT p, s, count(*) AS n FROM e GROUP BY p, s) GROUP BY p), g AS (SELECT p, max(n) <= 1 AS inverse_functional FROM (SELECT p, o, count(*) AS n FROM e GROUP BY p, o) GROUP BY p) SELECT p, functional, inverse_functional FROM f JOIN g USING (p)")
def functional_properties(spark, sf_dir):
    return induction.functional(graph(spark, sf_dir, "orders", "lineitem", repeats=True))


@query(f"WITH {mapped('customer')}, {COUNTED} SELECT p, functional FROM fdata")
def functional_data_properties(spark, sf_dir):
    return induction.functional_data(graph(spark, sf_dir, "customer"))


def _relations(spark, sf_dir):
    c, n, s = (_read(spark, sf_dir, x) for x in ("customer", "nation", "supplier"))
    part = [facts(c, iri("customer", "c_custkey"), "ex:partOf", iri("nation", "c_nationkey"), "iri"), facts(n, iri("nation", "n_nationkey"), "ex:partOf", iri("region", "n_regionkey"), "iri")]
    short = facts(c.join(n, F.col("c_nationkey") == F.col("n_nationkey")), iri("customer", "c_custkey"), "ex:partOf", iri("region", "n_regionkey"), "iri")
    pair = s.select("s_nationkey", F.col("s_suppkey").alias("a")).join(s.select("s_nationkey", F.col("s_suppkey").alias("b")), "s_nationkey").where("a != b AND abs(a - b) < 100")
    return union([*part, short, facts(pair, iri("supplier", "a"), "ex:near", iri("supplier", "b"), "iri"), facts(c, iri("nation", "c_nationkey"), "ex:hasMember", iri("customer", "c_custkey"), "iri"), facts(c, iri("customer", "c_custkey"), "ex:memberOf", iri("nation", "c_nationkey"), "iri")])


@query(f"{_RELATIONS} SELECT p, \"symmetric\" FROM sym")
def symmetric_properties(spark, sf_dir):
    return induction.symmetric(_relations(spark, sf_dir))


@query(f"{_RELATIONS} SELECT p, transitive FROM tra")
def transitive_properties(spark, sf_dir):
    return induction.transitive(_relations(spark, sf_dir))


@query(f"{_RELATIONS} SELECT p, q FROM invp")
def inverse_properties(spark, sf_dir):
    return induction.inverse_pairs(_relations(spark, sf_dir))


@query("SELECT min(n) AS min_n, max(n) AS max_n FROM (SELECT o_orderkey, count(DISTINCT l_partkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)")
def cardinality_restrictions(spark, sf_dir):
    return induction.cardinalities(graph(spark, sf_dir, "orders", "lineitem", repeats=True), "ex:contains", "ex:Order")


@query("SELECT replace(p_type, ' ', '_') AS local, 'http://a.example/' || replace(p_type, ' ', '_') AS canonical, 2 AS n FROM (SELECT DISTINCT p_type FROM part)")
def equivalent_classes(spark, sf_dir):
    local = F.replace(F.col("p_type"), F.lit(" "), F.lit("_"))
    part = _read(spark, sf_dir, "part")
    return induction.equivalent_classes(part.select(F.concat(F.lit("http://a.example/"), local).alias("cls")).union(part.select(F.concat(F.lit("http://b.example#"), local).alias("cls"))))


@query(f"{_SHOP_SQL} SELECT a, b FROM dis")
def disjoint_classes(spark, sf_dir):
    return induction.disjoint_classes(graph(spark, sf_dir, *_SHOP))


@query(f"""WITH {mapped('orders', 'customer')}, n AS (SELECT s FROM t WHERE p = 'rdf:type' AND o = 'ex:Customer')
SELECT s, p, o, k AS o_kind FROM t WHERE s NOT IN (SELECT s FROM n) AND (k = 'literal' OR o NOT IN (SELECT s FROM n)) UNION
SELECT h.s, x.p, x.o, x.k FROM t h JOIN t x ON h.o = x.s WHERE h.p = 'ex:hasCustomer' AND x.p = 'ex:segment'""")
def flatten_customer(spark, sf_dir):
    return rewrites.flatten(graph(spark, sf_dir, "orders", "customer"), "ex:hasCustomer", "ex:Customer", ["ex:segment"]).select("s", "p", "o", "o_kind")


@query("SELECT 'ex:part/' || p_partkey AS s, min('ex:part/' || p_partkey) OVER (PARTITION BY p_name, p_brand, p_type) AS canonical FROM part")
def dedup_parts(spark, sf_dir):
    return rewrites.canonical_individuals(graph(spark, sf_dir, "part"), "ex:Part")


@query(f"""WITH {mapped('part', 'lineitem')}, c AS (SELECT 'ex:part/' || p_partkey AS s, min('ex:part/' || p_partkey) OVER (PARTITION BY p_name, p_brand, p_type) AS c FROM part)
SELECT DISTINCT coalesce(a.c, t.s) AS s, p, coalesce(b.c, o) AS o, k AS o_kind FROM t LEFT JOIN c a ON a.s = t.s LEFT JOIN c b ON b.s = t.o AND k = 'iri'""")
def dedup_redirects(spark, sf_dir):
    return rewrites.dedup_individuals(graph(spark, sf_dir, "part", "lineitem", repeats=True), "ex:Part").select("s", "p", "o", "o_kind")


@query("SELECT lower(trim(p_name)) AS label, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_labels(spark, sf_dir):
    return validation.duplicate_labels(patterns.pattern(graph(spark, sf_dir, "part"), "?s", "ex:name", "?label"))


@query(f"""WITH {mapped('nation', 'region')} SELECT s, p, o, k AS o_kind FROM t WHERE s LIKE 'ex:nation/%' AND p <> 'ex:inRegion' UNION
SELECT h.s, x.p, x.o, x.k FROM t h JOIN t x ON x.s = h.o WHERE h.p = 'ex:inRegion' AND x.p <> 'rdf:type' UNION
SELECT s, p, o, k FROM t WHERE s LIKE 'ex:region/%' AND s NOT IN (SELECT o FROM t WHERE p = 'ex:inRegion')""")
def merge_region(spark, sf_dir):
    return rewrites.merge_nodes(graph(spark, sf_dir, "nation", "region"), "ex:inRegion").select("s", "p", "o", "o_kind")


@query(f"WITH {mapped('orders')} SELECT s, p, o, k AS o_kind FROM t UNION SELECT o, 'ex:customerOf', s, 'iri' FROM t WHERE p = 'ex:hasCustomer'")
def inverse_materialised(spark, sf_dir):
    pairs = spark.range(1).select(F.lit("ex:hasCustomer").alias("p"), F.lit("ex:customerOf").alias("q"))
    return rewrites.materialise_inverses(graph(spark, sf_dir, "orders"), pairs).select("s", "p", "o", "o_kind")


@query("SELECT 'ex:supplier/' || s_suppkey AS s, 'ex:nation/' || n_nationkey AS whole FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def part_of_prefix(spark, sf_dir):
    t = graph(spark, sf_dir, "supplier", "nation")
    nation = patterns.bgp(t, ("?s", TYPE, "ex:Nation"), ("?s", "ex:name", "?label"))
    own = patterns.bgp(t, ("?s", "ex:hasNation", "?k"), ("?k", "ex:name", "?head"), ("?s", "ex:name", "?rest"))
    return rewrites.part_of(nation.unionByName(own.select("s", F.concat_ws(" - ", "head", "rest").alias("label"))))


_RULES = [("urgent", "now"), ("high", "soon"), ("low", "late")]


@query(f"""WITH {mapped('orders')} SELECT s, p, CASE WHEN p <> 'ex:priority' THEN o ELSE 'ex:level/' || CASE WHEN lower(o) LIKE '%urgent%' THEN 'now' WHEN lower(o) LIKE '%high%' THEN 'soon' WHEN lower(o) LIKE '%low%' THEN 'late' ELSE 'some' END END AS o,
CASE WHEN p = 'ex:priority' THEN 'iri' ELSE k END AS o_kind FROM t""")
def collapse_levels(spark, sf_dir):
    out = rewrites.collapse(graph(spark, sf_dir, "orders"), "ex:priority", terms.classify(F.col("o"), _RULES, "some"), "ex:level/")
    return out.select("s", "p", "o", "o_kind")


@query(f"WITH {mapped('customer')} SELECT s, CASE WHEN p = 'ex:name' THEN 'ex:title' ELSE p END AS p, o, k AS o_kind FROM t")
def rename_predicate(spark, sf_dir):
    return rewrites.rename_predicate(graph(spark, sf_dir, "customer"), "ex:name", "ex:title").select("s", "p", "o", "o_kind")


@query(f"WITH {mapped('customer')} SELECT s, p, CASE WHEN p = 'rdf:type' THEN 'ex:Party' ELSE o END AS o, k AS o_kind FROM t")
def retype(spark, sf_dir):
    return rewrites.retype(graph(spark, sf_dir, "customer"), "ex:Customer", "ex:Party").select("s", "p", "o", "o_kind")


def _part_tree(spark, sf_dir):
    words = F.split("p_type", " ")
    part = _read(spark, sf_dir, "part").select(words.alias("w"))
    up = part.where("size(w) > 1").select(F.concat_ws(" ", "w").alias("child"), F.element_at("w", 1).alias("parent"))
    return up.union(part.select(F.element_at("w", 1).alias("child"), F.lit("Part").alias("parent"))).distinct()


_TREE = "WITH e AS (SELECT DISTINCT p_type AS child, split_part(p_type, ' ', 1) AS parent FROM part WHERE p_type LIKE '% %' UNION SELECT DISTINCT split_part(p_type, ' ', 1), 'Part' FROM part), r AS (SELECT 'Part' AS cls, 0 AS depth UNION ALL SELECT DISTINCT child, 1 FROM e WHERE parent = 'Part' UNION ALL SELECT child, 2 FROM e WHERE parent <> 'Part')"


@query(f"""{_TREE}, b AS (SELECT count(*) AS n FROM r GROUP BY depth) SELECT 1 AS roots, (SELECT round(avg(depth), 6) FROM r) AS average_depth, (SELECT max(depth) FROM r) AS max_depth, (SELECT round(avg(n), 6) FROM b) AS average_breadth, (SELECT max(n) FROM b) AS max_breadth,
(SELECT count(*) FROM (SELECT child FROM e EXCEPT SELECT parent FROM e)) AS leaves, (SELECT count(*) FROM (SELECT child FROM e UNION SELECT parent FROM e)) AS nodes, (SELECT count(*) FROM e) AS edges""")
def hierarchy_metrics(spark, sf_dir):
    return validation.hierarchy(_part_tree(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("average_depth", "average_breadth")})


@query("SELECT DISTINCT p_type AS cls FROM part UNION SELECT DISTINCT split_part(p_type, ' ', 1) FROM part UNION SELECT 'Part'")
def prune_empty_classes(spark, sf_dir):
    part = _read(spark, sf_dir, "part").select(F.col("p_type").alias("cls"))
    return rewrites.prune_classes(part, _part_tree(spark, sf_dir))


@query(f"""WITH {mapped('customer', more="SELECT 'ex:customer/' || c_custkey, 'ex:note', c_name || ' of ' || c_mktsegment, 'literal', '', '' FROM customer")},
v AS (SELECT p, count(*)::DOUBLE AS n, count(DISTINCT o)::DOUBLE AS d, avg(length(o)) AS size FROM t WHERE k = 'literal' GROUP BY p), c AS (SELECT count(*)::DOUBLE AS c FROM customer)
SELECT p, n / c AS coverage, round(d / n, 6) AS uniqueness, round(0.3::DOUBLE * n / c + 0.5::DOUBLE * d / n + 0.1::DOUBLE * greatest(0, 1 - size / 250) + CASE WHEN p = 'ex:name' THEN 0.2::DOUBLE ELSE 0 END, 6) AS score
FROM v, c WHERE n / c >= 0.5 AND size <= 250 AND d / n >= 0.4""")
def auto_label_property(spark, sf_dir):
    c = _read(spark, sf_dir, "customer")
    note = facts(c, iri("customer", "c_custkey"), "ex:note", F.concat_ws(" of ", "c_name", "c_mktsegment"))
    out = rewrites.label_scores(graph(spark, sf_dir, "customer").unionByName(note), "ex:Customer")
    return out.select("p", "coverage", F.round("uniqueness", 6).alias("uniqueness"), F.round("score", 6).alias("score"))


@query("SELECT count(*) AS n FROM customer")
def hash_names(spark, sf_dir):
    c = _read(spark, sf_dir, "customer")
    names = c.select(F.md5(F.col("c_custkey").cast("string")).alias("x")).union(c.select("c_name"))
    return names.where(terms.is_hash_name(F.col("x"))).agg(F.count("*").alias("n"))


@query("SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 5) AS similarity FROM embeddings x JOIN embeddings y ON x.vec_id % 100 = 0 AND x.vec_id <> y.vec_id")
def cosine_search(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings")
    return vectors.cosines(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 5)  # the stated query set


@query("SELECT url, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages")
def url_hosts(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("url", terms.url_host(F.col("url")).alias("host"))


@query("SELECT url, CASE WHEN contains(url, '#') THEN split(url, '#')[-1] ELSE split(url, '/')[-1] END AS local FROM pages")
def local_names(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("url", terms.local_name(F.col("url")).alias("local"))


@query("SELECT p_name, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^0-9a-zà-ÿ]+'), lambda x: len(x) >= 4))) AS tokens FROM part")
def name_tokens(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_name", F.array_sort(terms.tokens(F.col("p_name"), 4)).alias("tokens"))


@query("SELECT c_name FROM customer")
def clean_literals(spark, sf_dir):
    dirty = F.concat(F.lit(' ""'), "c_name", F.lit('""; '))
    return _read(spark, sf_dir, "customer").select(terms.clean_literal(dirty).alias("c_name"))


@query("SELECT s, p, o FROM (SELECT *, row_number() OVER (PARTITION BY s, p ORDER BY o) AS k FROM (SELECT DISTINCT 'ex:order/' || l_orderkey AS s, 'ex:contains' AS p, 'ex:part/' || l_partkey AS o FROM lineitem)) WHERE k <= 2")
def top_per_predicate(spark, sf_dir):
    return service.first_values(graph(spark, sf_dir, "lineitem", repeats=True), "ex:contains", 2)


@query("SELECT s FROM (SELECT 'ex:part/' || p_partkey AS s, min('ex:part/' || p_partkey) OVER (PARTITION BY p_name, p_brand, p_type) AS c FROM part) WHERE s <> c")
def coverage_missing(spark, sf_dir):
    t = graph(spark, sf_dir, "part")
    return validation.missing_individuals(t, rewrites.dedup_individuals(t, "ex:Part"))


@query("SELECT DISTINCT 'ex:customer/' || o_custkey AS s, 'ex:Customer' AS a, 'ex:UrgentCustomer' AS b FROM orders WHERE o_orderpriority = '1-URGENT'")
def consistency_clashes(spark, sf_dir):
    return validation.clashes(_urgent(spark, sf_dir), spark.createDataFrame([("ex:Customer", "ex:UrgentCustomer")], "a string, b string"))
