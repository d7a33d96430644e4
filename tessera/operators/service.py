"""The query service's answers as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import allowed_edition, before, clean_name, distinctive_tokens, haversine_km, path_name, readable_label, repair, short_id, short_label, tokens, valid_id, wkt_point
from ..sources.triples import COLUMNS, LABEL, TYPE
from .patterns import ask, bgp, construct, cut, dealt, merged, neighbourhood, not_exists, optional, path_plus, pattern
from .refine import Names


def stats(t: DataFrame, cls: str, p: str, none: str) -> DataFrame:
    """(label, n): members of a class by the label of what p points to, those without one under none."""
    all_ = pattern(t, "?inst", "rdf:type", cls)
    label = bgp(t, ("?inst", p, "?node"), ("?node", LABEL, "?label")).select("inst", "label")
    return optional(all_, label).groupBy(F.coalesce("label", F.lit(none)).alias("label")).agg(F.countDistinct("inst").alias("n"))


def listing(t: DataFrame, cls: str, p: str = "ex:name") -> DataFrame:
    found = bgp(t, ("?inst", "rdf:type", cls), ("?inst", p, "?name"))
    return found.select(short_id(F.col("inst")).alias("id"), "name").orderBy("name", "id")


def missing(t: DataFrame, cls: str, p: str) -> DataFrame:
    return not_exists(pattern(t, "?inst", "rdf:type", cls), pattern(t, "?inst", p, "?any").select("inst"))


def set_value(t: DataFrame, cls: str, p: str, node: str) -> DataFrame:
    """The triples that give p a node where a member of cls has none."""
    return construct(missing(t, cls, p), (F.col("inst"), p, F.lit(node), "iri"))


def nearby(places: DataFrame, root: str, n: int = 5) -> DataFrame:
    """(id, km) of the n places (id, wkt) nearest to root, by kilometres of two decimals, ties by id; the origin is a single row."""
    at = places.select("id", wkt_point(F.col("wkt")).alias("at"))
    origin = at.where(F.col("id") == root).agg(F.min("at").alias("origin"))
    far = haversine_km(F.col("origin.lat"), F.col("origin.lon"), F.col("at.lat"), F.col("at.lon"))
    own = at.where((F.col("id") != root) & F.col("at").isNotNull()).crossJoin(F.broadcast(origin))
    return own.select("id", F.round(far, 2).alias("km")).where("km IS NOT NULL").orderBy("km", "id").limit(n)


def toponym(address: Column) -> Column:
    """What stands before the first comma, lower-cased; empty if there is none."""
    return F.lower(before(address, ","))


def same_place(addresses: DataFrame) -> DataFrame:
    """(a, b) with a < b of (s, address): equal, non-empty toponyms. As many rows as pairs; place_members tells the same in one row a member."""
    own = addresses.select("s", toponym(F.col("address")).alias("key")).where("key != ''")
    return own.select("key", F.col("s").alias("a")).join(own.select("key", F.col("s").alias("b")), "key").where("a < b").select("a", "b")


def place_members(addresses: DataFrame) -> DataFrame:
    """(s, first, n): of every member of a shared toponym the smallest member and how many there are; links without pairs."""
    own = addresses.select("s", toponym(F.col("address")).alias("key")).where("key != ''")
    groups = own.groupBy("key").agg(F.min("s").alias("first"), F.count("*").alias("n")).where("n > 1")
    return own.join(groups, "key").select("s", "first", "n")


def place_groups(addresses: DataFrame) -> DataFrame:
    """(toponym, n, first, members) of toponyms with two members or more, the largest first; members in order, a list a place."""
    own = addresses.select("s", toponym(F.col("address")).alias("toponym")).where("toponym != ''")
    out = own.groupBy("toponym").agg(F.count("*").alias("n"), F.min("s").alias("first"), F.sort_array(F.collect_list("s")).alias("members")).where("n > 1")
    return out.orderBy(F.desc("n"), "toponym")


def zone_counts(addresses: DataFrame) -> DataFrame:
    """(toponym, n), the largest first, then by name."""
    return addresses.select(toponym(F.col("address")).alias("toponym")).groupBy("toponym").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "toponym")


def autocomplete(names: DataFrame, text: str, n: int = 8) -> DataFrame:
    """The first n of (id, name), by name, that hold text, whatever its case."""
    return names.where(F.lower("name").contains(text.lower())).orderBy("name", "id").limit(n)


def resolve(t: DataFrame, ids: DataFrame, cls: str, bases: list[str]) -> DataFrame:
    """(id, s): of each valid id the member of cls with that name in the first of the bases that has it."""
    tried = ids.where(valid_id(F.col("id"))).select("id", F.posexplode(F.array(*[F.concat(F.lit(b), "id") for b in bases])).alias("k", "s"))
    found = tried.join(pattern(t, "?s", TYPE, cls), "s", "left_semi")
    return found.groupBy("id").agg(F.min(F.struct("k", "s")).getField("s").alias("s"))


def contacts(t: DataFrame, p: str, kinds: dict[str, str]) -> DataFrame:
    """(s, type, value): what is reached by p, once or more often, and is of one of the types (type: property of its value)."""
    reached = path_plus(pattern(t, "?a", p, "?b")).select(F.col("a").alias("s"), F.col("b").alias("c"))
    typed = reached.join(pattern(t, "?c", TYPE, "?type").where(F.col("type").isin(*kinds)), "c")
    for k, value in enumerate(kinds.values()):
        typed = optional(typed, pattern(t, "?c", value, "?value"), ("value",) if k else ())
    return typed.where("value IS NOT NULL").select("s", "type", "value").distinct()


def details(t: DataFrame, names: Names = Names()) -> DataFrame:
    """One row of every member of the main class that has a name: id, name, texts, address, place, access, contacts.

    Where a property has several values the smallest is shown; contacts are sorted lists, one member's each.
    """
    one = lambda df, v: df.groupBy("s").agg(F.min(v).alias(v))
    own = names.own
    name = one(pattern(t, "?s", TYPE, names.main).join(pattern(t, "?s", "l0:name", "?name"), "s"), "name")
    access = optional(bgp(t, ("?s", names.has_access, "?ac"), ("?ac", LABEL, "?accessLabel")), pattern(t, "?ac", names.description, "?accessDescription"))
    access = access.groupBy("s").agg(F.min(F.struct("accessLabel", "accessDescription")).alias("x")).select("s", "x.*")
    address = bgp(t, ("?s", f"{own}hasAddress", "?addr"), ("?addr", "clv:fullAddress", "?address")).select("s", "address")
    place = bgp(t, ("?s", f"{own}haCoordinate", "?g"), ("?g", names.wkt, "?wkt")).select("s", "wkt")
    for right in (one(pattern(t, "?s", "arco:description", "?description"), "description"), one(pattern(t, "?s", f"{own}accessibilityNote", "?note"), "note"), one(address, "address"), one(place, "wkt"), access):
        name = name.join(right, "s", "left")
    found = contacts(t, f"{own}haContatti", {names.website: "sm:URL", names.contacts[0]: "sm:emailAddress", names.contacts[1]: "sm:telephoneNumber"})
    lists = [F.sort_array(F.collect_set(F.when(F.col("type") == k, F.col("value")))).alias(n) for k, n in zip((names.website, *names.contacts), ("websites", "emails", "phones"))]
    name = name.join(found.groupBy("s").agg(*lists), "s", "left")
    at = wkt_point(F.col("wkt"))
    texts = [repair(F.col(c)).alias(c) for c in ("name", "description", "note", "address", "accessLabel", "accessDescription")]
    return name.select(short_id(F.col("s")).alias("id"), *texts, at["lat"].alias("lat"), at["lon"].alias("lon"), *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("websites", "emails", "phones")])


def neighbourhood_graph(t: DataFrame, start: DataFrame, properties: list[str], kinds: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of two hops around start (root): (root, id, label, kind) and (root, from, to, label).

    kinds: what a node's type is called; a node without any of them is of kind Other. Labels are shortened.
    """
    edges = neighbourhood(t, start, properties)
    ids = start.select("root", F.col("root").alias("id")).union(edges.select("root", "o")).distinct()
    label = t.where(F.col("p") == LABEL).groupBy(F.col("s").alias("id")).agg(F.min("o").alias("label"))
    table = t.sparkSession.createDataFrame(list(kinds.items()), "o string, kind string")
    kind = t.where(F.col("p") == TYPE).join(F.broadcast(table), "o").groupBy(F.col("s").alias("id")).agg(F.min("kind").alias("kind"))
    nodes = ids.join(label, "id", "left").join(kind, "id", "left")
    nodes = nodes.select("root", "id", short_label(F.coalesce("label", short_id(F.col("id")))).alias("label"), F.coalesce("kind", F.lit("Other")).alias("kind"))
    return nodes, edges.select("root", F.col("s").alias("from"), F.col("o").alias("to"), path_name(F.col("p")).alias("label"))


def class_targets(t: DataFrame) -> DataFrame:
    """(term, cls): the classes that a domain or range stands for: itself, or the members of an anonymous union."""
    named = t.where(F.col("p").isin("rdfs:domain", "rdfs:range") & (F.col("o_kind") == "iri")).select(F.col("o").alias("term"), F.col("o").alias("cls"))
    head = t.where("p = 'owl:unionOf'").select(F.col("s").alias("term"), F.col("o").alias("cell"))
    on = path_plus(t.where("p = 'rdf:rest' AND o != 'rdf:nil'").select(F.col("s").alias("a"), F.col("o").alias("b")))
    cells = head.union(head.join(on, head["cell"] == on["a"]).select("term", F.col("b").alias("cell")))
    inside = cells.join(t.where("p = 'rdf:first' AND o_kind = 'iri'").select(F.col("s").alias("cell"), F.col("o").alias("cls")), "cell").select("term", "cls")
    return named.union(inside).distinct()


def ontology_view(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a schema: (id, label) of classes, (from, to, label, dashes, bidirectional) of subclasses and properties.

    A property and its inverse are one edge in both directions, named after both, the smaller property first.
    """
    label = t.where(F.col("p") == LABEL).groupBy("s").agg(F.min("o").alias("label"))
    sub = t.where("p = 'rdfs:subClassOf' AND o_kind = 'iri'").select(F.col("s").alias("from"), F.col("o").alias("to"), F.lit("subClassOf").alias("label"), F.lit(True).alias("dashes"), F.lit(False).alias("bidirectional"))
    props = pattern(t, "?s", TYPE, "owl:ObjectProperty").distinct().join(label, "s", "left").select("s", F.coalesce("label", path_name(F.col("s"))).alias("label"))
    said = pattern(t, "?p", "owl:inverseOf", "?q")
    inverse = said.union(said.select(F.col("q").alias("p"), F.col("p").alias("q"))).groupBy("p").agg(F.min("q").alias("q"))
    other = props.select(F.col("s").alias("q"), F.col("label").alias("other"))
    whole = props.join(inverse.withColumnRenamed("p", "s"), "s", "left").join(other, "q", "left").where("other IS NULL OR s <= q")
    targets = class_targets(t)
    ends = lambda p, name: t.where(F.col("p") == p).select("s", F.col("o").alias("term")).join(targets, "term").select("s", F.col("cls").alias(name)).distinct()
    drawn = whole.join(ends("rdfs:domain", "from"), "s").join(ends("rdfs:range", "to"), "s")
    drawn = drawn.select("from", "to", F.concat_ws(" / ", "label", "other").alias("label"), F.lit(False).alias("dashes"), F.col("other").isNotNull().alias("bidirectional"))
    edges = sub.unionByName(drawn)
    ids = pattern(t, "?id", TYPE, "owl:Class").where(~F.col("id").startswith("_:")).union(edges.select("from")).union(edges.select("to")).distinct()
    return ids.join(label.withColumnRenamed("s", "id"), "id", "left").select("id", F.coalesce("label", path_name(F.col("id"))).alias("label")), edges


def population_view(t: DataFrame, pairs: DataFrame, cls: str, label: str = "stessa ubicazione") -> tuple[DataFrame, DataFrame]:
    """ontology_view with the members of cls that pairs (a, b) link, their type and these links."""
    nodes, edges = ontology_view(t)
    own = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    edge = lambda df, a, b, text, dashes: df.select(a.alias("from"), b.alias("to"), F.lit(text).alias("label"), F.lit(dashes).alias("dashes"), F.lit(False).alias("bidirectional"))
    edges = edges.unionByName(edge(own, F.col("id"), F.lit(cls), "rdf:type", True)).unionByName(edge(pairs, F.col("a"), F.col("b"), label, False))
    name = t.where(F.col("p") == "l0:name").groupBy(F.col("s").alias("id")).agg(F.min("o").alias("name"))
    people = own.join(name, "id", "left").select("id", F.coalesce(repair(F.col("name")), short_id(F.col("id"))).alias("label"))
    more = t.sparkSession.createDataFrame([(cls, cls)], "id string, c string").select("id", path_name(F.col("c")).alias("label"))
    return nodes.unionByName(people).unionByName(more.join(nodes, "id", "left_anti")), edges


class Refused(ValueError):
    """A request that the service answers with a status of its own."""

    def __init__(self, status: int, text: str):
        super().__init__(text)
        self.status = status


def give_access(t: DataFrame, inst: str, keyword: str, allowed: list[str], names: Names = Names()) -> DataFrame:
    """The triples that give an institute the condition of access labelled keyword; 400 for other keywords, 409 if it has one."""
    if keyword not in allowed:
        raise Refused(400, f"{keyword} is no level of access")
    if not pattern(t, inst, names.has_access, "?any").isEmpty():
        raise Refused(409, f"{inst} has a condition of access")
    node = bgp(t, ("?access", TYPE, names.access), ("?access", LABEL, "?label")).where(F.lower("label") == keyword.lower())
    own = pattern(t, "?inst", TYPE, names.main).where(F.col("inst") == inst)
    return construct(own.crossJoin(node.select("access").distinct()), (F.col("inst"), names.has_access, F.col("access"), "iri"))  # one institute


def complete(t: DataFrame, cls: str, key: str, properties: dict[str, tuple[str, str]]) -> DataFrame:
    """One row (property, description, existsMissing, complete); 400 for a key that properties (property, description) lacks."""
    if key not in properties:
        raise Refused(400, f"{key} is no property that can be asked for")
    p, text = properties[key]
    found = ask(missing(t, cls, p), "existsMissing")
    return found.select(F.lit(key).alias("property"), F.lit(text).alias("description"), "existsMissing", (~F.col("existsMissing")).alias("complete"))


def with_overlay(t: DataFrame, path: str) -> DataFrame:
    """t and the statements that were saved under path, if there are any."""
    spark = t.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return merged(t, spark.read.parquet(path)) if there else t


def save_overlay(t: DataFrame, path: str) -> None:
    """Appends statements; the graph that they add to is never written."""
    t.select(COLUMNS).write.mode("append").parquet(path)


def exact_candidates(world: DataFrame, names: DataFrame, base: str, langs: tuple[str, ...] = ("it", "en")) -> DataFrame:
    """(id, s, rank) of (id, name): for each language the smallest resource of base with that label."""
    said = world.where((F.col("p") == LABEL) & F.col("s").startswith(base) & F.col("o_lang").isin(*langs)).groupBy(F.col("o").alias("name"), "o_lang").agg(F.min("s").alias("s"))
    return names.join(said, "name").select("id", "s", F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("o_lang")).cast("int").alias("rank"))


def fuzzy_candidates(world: DataFrame, names: DataFrame, base: str) -> DataFrame:
    """(id, s, rank): resources whose own name shares a distinctive token with the cleaned name; more shared ones come first."""
    asked = names.select("id", F.explode(distinctive_tokens(clean_name(F.col("name")))).alias("token"))
    known = world.where((F.col("p") == LABEL) & F.col("s").startswith(base)).select("s").distinct()
    known = known.select("s", F.explode(tokens(readable_label(F.col("s")))).alias("token"))
    return asked.join(known, "token").groupBy("id", "s").agg((F.lit(1000) - F.count("*")).cast("int").alias("rank"))


def first_fuzzy(world: DataFrame, names: DataFrame, base: str) -> DataFrame:
    """(id, s): of fuzzy_candidates the one of the lowest rank, the smallest of these.

    Names of equal tokens are looked up once, and so are resources of which the same tokens are asked for: only the smallest
    of these is met.
    """
    asked = names.select("id", F.explode(distinctive_tokens(clean_name(F.col("name")))).alias("token")).groupBy("id").agg(F.sort_array(F.collect_list("token")).alias("asked"))
    sets = asked.select("asked").distinct()
    words = sets.select("asked", F.explode("asked").alias("token"))
    known = world.where((F.col("p") == LABEL) & F.col("s").startswith(base)).select("s").distinct()
    known = known.select("s", F.explode(tokens(readable_label(F.col("s")))).alias("token")).join(words.select("token").distinct(), "token", "left_semi")
    alike = known.groupBy("s").agg(F.sort_array(F.collect_list("token")).alias("known")).groupBy("known").agg(F.min("s").alias("s"))  # one name's tokens
    met = words.join(alike.select("s", F.explode("known").alias("token")), "token").groupBy("asked", "s").agg((-F.count("*")).alias("k"))
    best = met.groupBy("asked").agg(F.min(F.struct("k", "s")).getField("s").alias("s"))
    return asked.join(best, "asked").select("id", "s")


def about(world: DataFrame, nodes: list[str], words: list[str]) -> DataFrame:
    """(s): resources that point to one of nodes, say one of words, or point to an IRI that holds the first of them."""
    said = F.lit(False)
    for w in words:
        said = said | F.col("o").contains(w)
    hit = F.col("o").isin(*nodes) | ((F.col("o_kind") == "literal") & said) | ((F.col("o_kind") == "iri") & F.col("o").contains(words[0]))
    return world.where(hit).select("s").distinct()


def linked(world: DataFrame, names: DataFrame, base: str, related: DataFrame) -> DataFrame:
    """(id, s) of (id, name): the first candidate that is related (s): exact labels before fuzzy ones, then smaller names.

    Fuzzy candidates are looked for where no exact one is related, and among related resources alone.
    """
    related = cut(related.select("s").distinct())
    exact = exact_candidates(world, names, base).join(related, "s", "left_semi")
    exact = cut(exact.groupBy("id").agg(F.min(F.struct("rank", "s")).getField("s").alias("s")))
    left = cut(names.join(exact.select(F.col("id").alias("_id")), F.col("id").eqNullSafe(F.col("_id")), "left_anti"))
    return exact if left.isEmpty() else exact.unionByName(first_fuzzy(world.join(related, "s", "left_semi"), left, base))


#: Concepts that say nothing of a thing, and ones that are right but broad.
GENERIC = ["Agent", "Organisation", "Organization", "Person", "Place", "Location", "Thing", "Entity"]
BROAD = ["Building", "Structure", "ArchitecturalStructure", "Work"]


def general_concepts(world: DataFrame, resources: DataFrame, types: str, base: str, limit: int = 3) -> DataFrame:
    """(s, concept, label): a resource's types, as resources of the same name with an English label; broad ones last, limit each."""
    ty = world.where((F.col("p") == TYPE) & F.col("o").startswith(types)).join(resources.select("s"), "s", "left_semi")
    name = F.substr("o", F.lit(len(types) + 1))
    found = ty.select("s", name.alias("name")).where(~F.col("name").isin(GENERIC)).select("s", "name", F.concat(F.lit(base), "name").alias("concept")).distinct()
    label = world.where((F.col("p") == LABEL) & (F.col("o_lang") == "en")).groupBy(F.col("s").alias("concept")).agg(F.min("o").alias("label"))
    return _first(found.join(label, "concept"), "s", [F.col("name").isin(BROAD), F.col("concept")], limit).select("s", "concept", "label")


def related_concepts(world: DataFrame, concepts: DataFrame, link: str, base: str, limit: int = 4) -> DataFrame:
    """(concept, s, label): resources that a concept and that link to each other, with an English label; limit each."""
    edges = world.where((F.col("p") == link) & F.col("o").startswith(base) & ~F.col("o").contains("Category:")).select("s", "o").distinct()
    out = edges.join(concepts.select(F.col("concept").alias("s")).distinct(), "s", "left_semi").select(F.col("s").alias("concept"), F.col("o").alias("s"))
    both = out.join(world.where(F.col("p") == link).select("s", F.col("o").alias("concept")).distinct(), ["s", "concept"], "left_semi")
    label = world.where((F.col("p") == LABEL) & (F.col("o_lang") == "en")).groupBy("s").agg(F.min("o").alias("label"))
    return _first(both.join(label, "s"), "concept", [F.col("s")], limit).select("concept", "s", "label")


def _first(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first n rows of each key; Spark keeps no more than n rows a key before the shuffle."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def first_values(t: DataFrame, p: str, n: int) -> DataFrame:
    """(s, p, o): the first n different values of p, by name, of every subject.

    Statements are dealt once, by subject, and sorted there; repeats stand side by side and are left out without a set.
    """
    at = Window.partitionBy("s").orderBy("o")
    first = dealt(t.where(F.col("p") == p).select("s", "o"), "s").withColumn("_k", F.dense_rank().over(at)).where(F.col("_k") <= n)
    return first.withColumn("_o", F.lag("o").over(at)).where(F.col("_o").isNull() | (F.col("_o") != F.col("o"))).select("s", F.lit(p).alias("p"), "o")


def described(world: DataFrame, links: DataFrame, caps: dict[str, int]) -> DataFrame:
    """(id, s, p, o) of linked resources (id, s): up to caps[p] objects of each property, without editions in other languages."""
    own = world.where(F.col("p").isin(*caps) & ((F.col("o_kind") == "literal") | allowed_edition(F.col("o")))).join(links, "s").select("id", "s", "p", "o").distinct()
    nth = F.row_number().over(Window.partitionBy("id", "p").orderBy("o"))
    cap = F.lit(0)
    for p, n in caps.items():
        cap = F.when(F.col("p") == p, n).otherwise(cap)
    return own.withColumn("_n", nth).where(F.col("_n") <= cap).drop("_n")
