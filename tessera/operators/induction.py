"""A schema from facts, by counting: types, domains, ranges, confidence, characteristics, cardinalities, hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import datatype, local_name, plain_name
from ..sources.triples import TYPE
from .patterns import cut, dealt
from ..sources.vocabulary import FORCED_DATA, META, PREFERRED, SKIPPED

#: What is asserted must be above these.
TAU_SUBCLASS, TAU_SIMILAR, TAU_DOMAIN = 0.7, 0.6, 0.75


def types(t: DataFrame) -> DataFrame:
    """(s, cls) of individuals; blank nodes are none."""
    return t.where((F.col("p") == TYPE) & (F.col("o_kind") == "iri") & ~F.col("o").isin(META) & ~F.col("s").startswith("_:")).select("s", F.col("o").alias("cls"))


def links(t: DataFrame) -> DataFrame:
    """Statements that tell about the schema, with `kind` object or data; those from or to blank nodes tell nothing."""
    own = t.where(~F.col("p").isin(SKIPPED) & ~F.col("s").startswith("_:") & (F.col("o_kind") != "bnode"))
    return own.withColumn("kind", F.when((F.col("o_kind") == "literal") | F.col("p").isin(FORCED_DATA), "data").otherwise("object"))


#: Between the parts of a tag: what a node is to a statement, the statement's kind, its object's kind, datatype and language, its property.
_MARK = "\x1f"


def _tag(role: str, kind, name: str, *more: Column) -> Column:
    return F.concat_ws(_MARK, F.lit(role), kind, *(more or [F.lit("")] * 3), F.col(name))


def profile(t: DataFrame) -> DataFrame:
    """(sid, nodes, role, kind, datatype, p, n): what is said of nodes, counted once for all nodes of which the same is said.

    A row says that of the nodes of profile sid, of which there are `nodes`, each is n times subject (role out) or object
    (in) of p, or is of class p (is). Everything is dealt once, by node; a statement counts once however often t has it.
    Objects are told apart by 64-bit hashes, among the statements of one node, property and kind alone.
    """
    own, ty = links(t), types(t)
    plain, none = F.col("kind") == "object", F.lit("")
    literal = [F.when(plain, none).otherwise(F.coalesce(c, none)) for c in ("o_kind", "o_dt", "o_lang")]
    out = own.select(F.col("s").alias("node"), _tag("out", F.col("kind"), "p", *literal).alias("tag"), F.xxhash64("o").alias("v"))
    into = own.where(plain).select(F.col("o").alias("node"), _tag("in", F.col("kind"), "p").alias("tag"), F.xxhash64("s").alias("v"))
    kinds = ty.select(F.col("s").alias("node"), _tag("is", none, "cls").alias("tag"), F.lit(0).cast("long").alias("v"))
    said = dealt(out.union(into).union(kinds), "node").distinct().groupBy("node", "tag").agg(F.count("*").alias("n"))
    alike = said.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("tag", "n"))).alias("said"))  # as long as a node's properties are many
    alike = cut(alike.groupBy("said").agg(F.count("*").alias("nodes")))
    part = F.split("x.tag", _MARK, 6)
    rows = alike.select(F.sha2(F.to_json("said"), 256).alias("sid"), "nodes", F.explode("said").alias("x")).withColumn("w", part)
    w = lambda k: F.element_at("w", k)
    kind = F.when(w(3) == "iri", "xsd:anyURI").otherwise(datatype(w(4), w(5)))
    return cut(rows.select("sid", "nodes", w(1).alias("role"), w(2).alias("kind"), F.when(w(2) == "data", kind).alias("datatype"), w(6).alias("p"), F.col("x.n").alias("n")))


def _classed(seen: DataFrame, role: str) -> DataFrame:
    return seen.where(F.col("role") == role).join(seen.where("role = 'is'").select("sid", F.col("p").alias("cls")), "sid")


def class_sizes(seen: DataFrame) -> DataFrame:
    """(cls, n) of a profile."""
    return seen.where("role = 'is'").groupBy(F.col("p").alias("cls")).agg(F.sum("nodes").alias("n"))


def domain_range(t: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(p, role, cls, n): how many statements have a subject or object of a class."""
    seen = profile(t) if seen is None else seen
    sides = [_classed(seen, a).groupBy("p", F.lit(b).alias("role"), "cls").agg(F.sum(F.col("nodes") * F.col("n")).alias("n")) for a, b in (("out", "domain"), ("in", "range"))]
    return sides[0].unionByName(sides[1])


def data_ranges(t: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(p, datatype, n) of data properties."""
    seen = profile(t) if seen is None else seen
    return seen.where("role = 'out' AND kind = 'data'").groupBy("p", "datatype").agg(F.sum(F.col("nodes") * F.col("n")).alias("n"))


def confidence(t: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(p, role, cls, confidence): the commonest class of each role and its share; ties go to the smaller name.

    A graph is a set: statements are counted once, so an object property's are its distinct pairs.
    """
    seen = profile(t) if seen is None else seen
    total = seen.where("role = 'out'").groupBy("p").agg(F.sum(F.col("nodes") * F.col("n")).alias("total"))
    best = domain_range(t, seen).groupBy("p", "role").agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("cls"))).alias("b"))
    return best.join(total, "p").select("p", "role", F.col("b.cls").alias("cls"), (-F.col("b.k") / F.col("total")).alias("confidence"))


def accepted(conf: DataFrame, tau: float = TAU_DOMAIN) -> DataFrame:
    return conf.where(F.col("confidence") > F.lit(tau))


def functional(t: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(p, functional, inverse_functional) of object properties: no node has two values, no value has two nodes.

    Repeats do no harm. Without a profile only the smallest and the largest hash of a node's values are kept, so a property
    would be missed only if the values of each of its nodes that has several had one 64-bit hash.
    """
    if seen is not None:
        most = lambda role, name: seen.where((F.col("role") == role) & (F.col("kind") == "object")).groupBy("p").agg((F.max("n") <= 1).alias(name))
        return most("out", "functional").join(most("in", "inverse_functional"), "p")
    own = links(t).where("kind = 'object'")
    ways = own.select("p", F.lit(True).alias("out"), F.col("s").alias("node"), F.xxhash64("o").alias("v")).union(own.select("p", F.lit(False), "o", F.xxhash64("s")))
    one = dealt(ways, "node", "p", "out").groupBy("node", "p", "out").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    both = one.groupBy("p", "out").agg(F.min(F.col("a") == F.col("b")).alias("one")).groupBy("p")
    return both.agg(F.min(F.when(F.col("out"), F.col("one"))).alias("functional"), F.min(F.when(~F.col("out"), F.col("one"))).alias("inverse_functional"))


def functional_data(t: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(p, functional) of data properties. A value counts once, whatever its datatype and language."""
    own = links(t).where("kind = 'data'")
    if seen is not None:
        by = seen.where("role = 'out' AND kind = 'data'").groupBy("sid", "p").agg(F.max("n").alias("n"), F.count("*").alias("kinds"))
        by = cut(by.groupBy("p").agg((F.max("n") <= 1).alias("functional"), F.max("kinds").alias("kinds")))
        open_ = [r["p"] for r in by.where("functional AND kinds > 1").collect()]  # properties, not facts
        if not open_:
            return by.select("p", "functional")
        return by.where(~F.col("p").isin(open_)).select("p", "functional").union(functional_data(t.where(F.col("p").isin(open_))))
    pairs = own.groupBy("p", "s").agg(F.min(F.xxhash64("o")).alias("a"), F.max(F.xxhash64("o")).alias("b"))
    return pairs.groupBy("p").agg(F.min(F.col("a") == F.col("b")).alias("functional"))


#: Properties whose pairs are looked at together: two bits each of one number.
MASK_PROPERTIES = 31


def turned(t: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((p, symmetric), (p, q)): what symmetric and inverse_pairs give, comparing only properties whose counts allow it.

    Properties with as many statements, from nodes like those that the other leads to, are compared pair by pair: a number
    of two bits a property says of each pair of nodes in which directions which properties link it.
    """
    counts = [("all", lambda c: F.sum(c(F.col("nodes") * F.col("n")))), ("nodes", lambda c: F.bit_xor(c(F.xxhash64("sid", "n"))))]  # the profiles that hold p, and how often
    sides = seen.where("kind = 'object'").groupBy("p").agg(*[f(lambda x, role=role: F.when(F.col("role") == role, x)).alias(f"{role}_{k}") for role in ("out", "in") for k, f in counts])
    size = [tuple(r) for r in sides.collect()]  # one row a property
    by: dict[tuple, list[str]] = {}
    for p, *x in size:
        by.setdefault(tuple(x[2:] + x[:2]), []).append(p)
    pairs = sorted((p, q) for p, *x in size for q in by.get(tuple(x), []) if p <= q)
    good: set[tuple[str, str]] = set()
    while pairs:
        names: list[str] = []
        now = []
        for pair in pairs:
            if len({*names, *pair}) <= MASK_PROPERTIES:
                names += [x for x in pair if x not in names]
                now.append(pair)
        pairs = [x for x in pairs if x not in now]
        good |= _turned(t, names, now)
    spark = t.sparkSession
    marked = spark.createDataFrame([(p, (p, p) in good) for p, *_ in size], "p string, symmetric boolean")
    return marked, spark.createDataFrame([x for x in sorted(good) if x[0] != x[1]], "p string, q string")


def _turned(t: DataFrame, names: list[str], pairs: list[tuple[str, str]]) -> set[tuple[str, str]]:
    """Those of pairs (p, q) of which p links a to b just where q links b to a."""
    e = links(t.where(F.col("p").isin(names))).where("kind = 'object'")
    bit = F.lit(0).cast("long")
    for k, p in enumerate(names):
        bit = F.when(F.col("p") == p, F.lit(1 << 2 * k).cast("long")).otherwise(bit)
    way = F.when(F.col("s") < F.col("o"), 1).when(F.col("s") > F.col("o"), 2).otherwise(3)
    e = e.select(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b"), (bit * way).alias("bits"))
    masks = dealt(e, "a", "b").groupBy("a", "b").agg(F.bit_or("bits").alias("mask")).select("mask").distinct()
    left = set(pairs)
    swap = (0, 2, 1, 3)
    for mask in [r["mask"] for r in cut(masks).toLocalIterator()]:
        said = {p: mask >> 2 * k & 3 for k, p in enumerate(names)}
        left -= {(p, q) for p, q in left if said[p] != swap[said[q]]}
    return left


def symmetric(edges: DataFrame) -> DataFrame:
    """(p, symmetric) of (s, p, o): every pair stands the other way round too."""
    own = edges.select("p", "s", "o").distinct()
    odd = own.join(own.select("p", F.col("o").alias("s"), F.col("s").alias("o"), F.lit(1).alias("back")), ["p", "s", "o"], "left")
    return odd.groupBy("p").agg((F.count("*") == F.count("back")).alias("symmetric"))


def chained(t: DataFrame, seen: DataFrame) -> DataFrame:
    """(p, transitive) as transitive gives it, joining only properties that have a node as subject and as object."""
    by = seen.where("kind = 'object'").groupBy("p", "sid").agg(F.countDistinct("role").alias("n")).groupBy("p").agg((F.max("n") > 1).alias("some"))
    names = by.collect()  # one row a property
    spark, maybe = t.sparkSession, [r["p"] for r in names if r["some"]]
    none = spark.createDataFrame([(r["p"], False) for r in names if not r["some"]], "p string, transitive boolean")
    return none.union(transitive(links(t.where(F.col("p").isin(maybe))).where("kind = 'object'"))) if maybe else none


def transitive(edges: DataFrame) -> DataFrame:
    """(p, transitive) of (s, p, o): some a, b, c with a to b, b to c and a to c, a and c not the same."""
    own = edges.select("p", "s", "o").distinct()
    two = own.select("p", F.col("s").alias("a"), F.col("o").alias("b")).join(own.select("p", F.col("s").alias("b"), F.col("o").alias("c")), ["p", "b"]).where("a != c")
    hit = two.join(own.select("p", F.col("s").alias("a"), F.col("o").alias("c")), ["p", "a", "c"], "left_semi").select("p").distinct()
    return own.select("p").distinct().join(hit.withColumn("hit", F.lit(True)), "p", "left").select("p", F.coalesce("hit", F.lit(False)).alias("transitive"))


def inverse_pairs(edges: DataFrame) -> DataFrame:
    """(p, q) with p < q whose pairs are each other's, turned round."""
    own = edges.select("p", "s", "o").distinct()
    size = own.groupBy("p").agg(F.count("*").alias("n"))
    both = own.join(own.select(F.col("p").alias("q"), F.col("o").alias("s"), F.col("s").alias("o")), ["s", "o"]).where("p < q").groupBy("p", "q").agg(F.count("*").alias("both"))
    sized = both.join(size, "p").join(size.select(F.col("p").alias("q"), F.col("n").alias("m")), "q")
    return sized.where("both = n AND both = m").select("p", "q")


def cardinalities(t: DataFrame, p: str, cls: str) -> DataFrame:
    """(min_n, max_n) of values of p over all members of cls, those without any included.

    Members and statements are dealt once, by subject; a member's values are told apart by 64-bit hashes.
    """
    members = types(t).where(F.col("cls") == cls).select("s", F.lit(None).cast("long").alias("v"))
    said = t.where(F.col("p") == p).select("s", F.xxhash64("o").alias("v"))
    by = dealt(members.union(said), "s").distinct().groupBy("s").agg(F.count("v").alias("n"), F.max(F.col("v").isNull()).alias("member"))
    return by.where("member").agg(F.min("n").alias("min_n"), F.max("n").alias("max_n"))


def overlaps(t: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(a, b, overlap): the share of a's members that are b's too, of classes that share any."""
    if seen is None:
        ty = types(t).distinct().withColumn("nodes", F.lit(1))
    else:
        ty = seen.where("role = 'is'").select(F.col("sid").alias("s"), F.col("p").alias("cls"), "nodes")
    size = ty.groupBy("cls").agg(F.sum("nodes").alias("n"))
    both = ty.select("s", F.col("cls").alias("a"), "nodes").join(ty.select("s", F.col("cls").alias("b")), "s").where("a != b").groupBy("a", "b").agg(F.sum("nodes").alias("both"))
    return both.join(size.withColumnRenamed("cls", "a"), "a").select("a", "b", (F.col("both") / F.col("n")).alias("overlap"))


def restrictions(t: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(cls, p, min_n, max_n) of every class and object property that some member has; members without it count as zero."""
    seen = profile(t) if seen is None else seen
    size = class_sizes(seen).withColumnRenamed("n", "members")
    found = _classed(seen, "out").where("kind = 'object'").groupBy("cls", "p").agg(F.sum("nodes").alias("having"), F.min("n").alias("least"), F.max("n").alias("max_n")).join(size, "cls")
    return found.select("cls", "p", F.when(F.col("having") < F.col("members"), 0).otherwise(F.col("least")).alias("min_n"), "max_n")


def subclasses(t: DataFrame, tau: float = TAU_SUBCLASS, similarity: DataFrame | None = None, tau_similar: float = TAU_SIMILAR, seen: DataFrame | None = None) -> DataFrame:
    """(child, parent): overlap above tau, and similarity of the names (a, b, similarity) above tau_similar where it is given.

    Of two that hold both ways, the child is the class in more properties' domains, then of the longer local name, then
    of the larger name.
    """
    seen = profile(t) if seen is None else seen
    own = overlaps(t, seen).where(F.col("overlap") > F.lit(tau)).select("a", "b")
    if similarity is not None:
        own = own.join(similarity.where(F.col("similarity") > F.lit(tau_similar)).select("a", "b"), ["a", "b"], "left_semi")
    uses = domain_range(t, seen).where("role = 'domain'").groupBy("cls").agg(F.countDistinct("p").alias("props"))
    rank = lambda c: F.struct(F.coalesce(f"props_{c}", F.lit(0)), F.length(plain_name(F.col(c))), F.col(c))
    both = own.join(own.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1).alias("back")), ["a", "b"], "left")
    for c in ("a", "b"):
        both = both.join(uses.select(F.col("cls").alias(c), F.col("props").alias(f"props_{c}")), c, "left")
    return both.where(F.col("back").isNull() | (rank("a") > rank("b"))).select(F.col("a").alias("child"), F.col("b").alias("parent"))


def _named(classes: DataFrame, preferred: list[str]) -> DataFrame:
    """(cls, local, later): later is false for classes of preferred namespaces."""
    later = ~F.col("cls").rlike("|".join(x.replace(".", "[.]") for x in preferred)) if preferred else F.lit(False)
    return classes.select("cls", local_name(F.col("cls")).alias("local"), later.alias("later")).distinct()


def equivalent_classes(classes: DataFrame, preferred: list[str] = PREFERRED) -> DataFrame:
    """(local, canonical, n) of local names that several classes (column cls) share; those of preferred namespaces come first."""
    named = _named(classes, preferred)
    return named.groupBy("local").agg(F.min(F.struct("later", "cls")).getField("cls").alias("canonical"), F.count("*").alias("n")).where("n > 1")


def aliases(classes: DataFrame, preferred: list[str] = PREFERRED) -> DataFrame:
    """(s, canonical) of classes that another one of the same local name stands for."""
    named = _named(classes, preferred)
    return named.join(equivalent_classes(classes, preferred), "local").where("cls != canonical").select(F.col("cls").alias("s"), "canonical")


def folded(t: DataFrame, alias: DataFrame) -> DataFrame:
    """t with aliased classes (s, canonical) replaced by the canonical ones wherever they are objects."""
    own = alias.select(F.col("s").alias("o"), F.col("canonical").alias("_o"))
    out = t.join(own, "o", "left")
    return out.select("s", "p", F.when(F.col("o_kind") == "iri", F.coalesce("_o", "o")).otherwise(F.col("o")).alias("o"), "o_kind", "o_dt", "o_lang").distinct()


def disjoint_classes(t: DataFrame, parents: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """(a, b) with a < b: classes with properties, none shared, neither a subclass of the other (child, parent). Pairs of classes, not of rows."""
    seen = profile(t) if seen is None else seen
    sets = domain_range(t, seen).where("role = 'domain'").groupBy("cls").agg(F.collect_set("p").alias("ps"))  # one row a class, as long as its properties
    a, b = sets.select(F.col("cls").alias("a"), F.col("ps").alias("x")), sets.select(F.col("cls").alias("b"), F.col("ps").alias("y"))
    pairs = a.join(b, (F.col("a") < F.col("b")) & ~F.arrays_overlap("x", "y")).select("a", "b")
    parents = subclasses(t, seen=seen) if parents is None else parents
    return pairs.join(parents.select(F.least("child", "parent").alias("a"), F.greatest("child", "parent").alias("b")), ["a", "b"], "left_anti")
