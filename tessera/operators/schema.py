"""An OWL schema as triples: induced from facts, stripped from facts, merged with facts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import confidence_text, is_hash_name, plain_name
from ..sources.triples import COLUMNS, LABEL, TYPE
from ..sources.vocabulary import KNOWN_TRANSITIVE, META, PROVENANCE, SCHEMA_PREDICATES, SCHEMA_TYPES, SKIPPED
from . import induction
from .patterns import cut, merged
from .rewrites import redirected

SUBCLASS, COMMENT, THING = "rdfs:subClassOf", "rdfs:comment", "owl:Thing"
#: Predicates that make a restriction what it is.
CONSTRAINTS = [
    "owl:someValuesFrom", "owl:allValuesFrom", "owl:hasValue", "owl:cardinality", "owl:minCardinality", "owl:maxCardinality",
    "owl:qualifiedCardinality", "owl:minQualifiedCardinality", "owl:maxQualifiedCardinality",
]
#: Names of properties that tell an individual from others, the best first.
TELLING = ["fullAddress", "label", "name", "nome", "email", "mbox", "telephone", "telefono", "title", "identifier"]
SEEN = "Istanze osservate nella ABox: "


def rows(df: DataFrame, s, p, o, kind: str = "iri", dt="", lang="") -> DataFrame:
    """Triples of a template; what is no column is a constant."""
    term = lambda x: x if isinstance(x, Column) else F.lit(x)
    out = df.select(term(s).alias("s"), term(p).alias("p"), term(o).cast("string").alias("o"), F.lit(kind).alias("o_kind"), term(dt).alias("o_dt"), term(lang).alias("o_lang"))
    return out.where("s IS NOT NULL AND o IS NOT NULL")


@dataclass
class Analysis:
    """What induction counts, each a small table: by class, by property or by both."""

    graph: DataFrame
    alias: DataFrame
    classes: DataFrame  # cls, n
    props: DataFrame  # p, kind
    roles: DataFrame  # p, role, cls, n
    datatypes: DataFrame  # p, datatype, n
    confidence: DataFrame  # p, role, cls, confidence
    marks: DataFrame  # p, functional, inverse_functional, symmetric, transitive
    functional_data: DataFrame  # p, functional
    inverse: DataFrame  # p, q: one inverse of each property that has any
    parents: DataFrame  # child, parent
    disjoint: DataFrame  # a, b
    restrictions: DataFrame  # cls, p, min_n, max_n


def analyse(t: DataFrame, tau: float = induction.TAU_SUBCLASS, similarity: DataFrame | None = None) -> Analysis:
    """All that build_tbox needs. Classes of one local name are folded into one first, so everything counts them as one.

    t is dealt once, to a profile of its nodes from which all is counted; statements of properties that may be inverse,
    symmetric or transitive are read again.
    """
    alias = cut(induction.aliases(induction.types(t).select("cls").distinct()))
    t = induction.folded(t, alias) if not alias.isEmpty() else t
    seen = induction.profile(t)
    marked, pairs = induction.turned(t, seen)
    inverse = pairs.union(pairs.select(F.col("q").alias("p"), F.col("p").alias("q"))).groupBy("p").agg(F.min("q").alias("q"))
    marks = induction.functional(t, seen).join(marked, "p").join(induction.chained(t, seen), "p")
    parents = cut(induction.subclasses(t, tau, similarity, seen=seen))
    return Analysis(
        graph=t, alias=alias, classes=cut(induction.class_sizes(seen)), props=cut(seen.where("role = 'out'").select("p", "kind").distinct()), roles=cut(induction.domain_range(t, seen)),
        datatypes=cut(induction.data_ranges(t, seen)), confidence=cut(induction.confidence(t, seen)), marks=cut(marks), functional_data=cut(induction.functional_data(t, seen)), inverse=cut(inverse), parents=parents,
        disjoint=cut(induction.disjoint_classes(t, parents, seen)), restrictions=cut(induction.restrictions(t, seen).where("min_n > 0 OR max_n < 999")),
    )


def non_simple(a: Analysis) -> DataFrame:
    """(p) that are transitive, by count, declaration, chain or name, and their inverses, until nothing is added."""
    t = a.graph
    found = a.marks.where("transitive").select("p")
    found = found.union(t.where((F.col("p") == TYPE) & (F.col("o") == "owl:TransitiveProperty")).select("s")).union(t.where("p = 'owl:propertyChainAxiom'").select("s"))
    found = cut(found.union(t.sparkSession.createDataFrame([(x,) for x in KNOWN_TRANSITIVE], "p string")).distinct())
    n = found.count()
    while True:
        found = cut(found.union(a.inverse.join(found.withColumnRenamed("p", "q"), "q").select("p")).distinct())
        now = found.count()
        if now == n:
            return found
        n = now


def labels(a: Analysis, terms: DataFrame) -> DataFrame:
    """Of each term (s): its labels in the graph, else its local name in English."""
    said = a.graph.where(F.col("p") == LABEL).join(terms, "s", "left_semi").select(COLUMNS)
    bare = terms.join(said.select("s").distinct(), "s", "left_anti")
    return said.unionByName(rows(bare, F.col("s"), LABEL, plain_name(F.col("s")), "literal", "", "en"))


def class_axioms(a: Analysis) -> DataFrame:
    """Declarations with labels and counts, subclasses, disjointness."""
    cls = F.col("cls")
    out = rows(a.classes, cls, TYPE, "owl:Class").unionByName(labels(a, a.classes.select(cls.alias("s"))))
    out = out.unionByName(rows(a.classes, cls, COMMENT, F.concat(F.lit(SEEN), F.col("n").cast("string")), "literal"))
    out = out.unionByName(rows(a.parents, F.col("child"), SUBCLASS, F.col("parent")))
    return out.unionByName(rows(a.disjoint, F.col("a"), "owl:disjointWith", F.col("b")))


def declared_ranges(a: Analysis, tau: float) -> DataFrame:
    """(p, cls) of ranges that are asserted: of object properties those above tau; of data properties their one datatype.

    A data property of several has xsd:string where all are strings, else xsd:anySimpleType.
    """
    texts = F.col("datatype").isin("xsd:string", "rdf:langString")
    data = a.datatypes.groupBy("p").agg(F.count("*").alias("n"), F.min("datatype").alias("one"), F.min(texts).alias("texts"))
    data = data.select("p", F.when(F.col("n") == 1, F.col("one")).when(F.col("texts"), "xsd:string").otherwise("xsd:anySimpleType").alias("cls"))
    return a.confidence.where((F.col("role") == "range") & (F.col("confidence") > F.lit(tau))).select("p", "cls").union(data)


def property_axioms(a: Analysis, hard: DataFrame, tau: float) -> DataFrame:
    """Declarations, labels, domains, ranges, characteristics and inverses; hard: non-simple properties (p)."""
    p, kind = F.col("p"), F.when(F.col("kind") == "data", "owl:DatatypeProperty").otherwise("owl:ObjectProperty")
    out = rows(a.props, p, TYPE, kind).unionByName(labels(a, a.props.select(p.alias("s")).distinct()))
    sure = a.confidence.where(F.col("confidence") > F.lit(tau))
    note = F.concat("role", F.lit(": "), plain_name(F.col("cls")), F.lit(" (confidence: "), confidence_text(F.col("confidence")), F.lit(")"))
    out = out.unionByName(rows(sure, p, COMMENT, note, "literal")).unionByName(rows(sure.where("role = 'domain'"), p, "rdfs:domain", F.col("cls")))
    out = out.unionByName(rows(declared_ranges(a, tau), p, "rdfs:range", F.col("cls")))
    simple = a.marks.join(hard, "p", "left_anti")
    for df, mark, cls in ((simple, "functional", "Functional"), (simple, "inverse_functional", "InverseFunctional"), (a.marks, "symmetric", "Symmetric"), (a.marks, "transitive", "Transitive"), (a.functional_data, "functional", "Functional")):
        out = out.unionByName(rows(df.where(F.col(mark)), p, TYPE, f"owl:{cls}Property"))
    return out.unionByName(rows(a.inverse, p, "owl:inverseOf", F.col("q")))


def restriction_axioms(a: Analysis, hard: DataFrame, tau: float) -> DataFrame:
    """Restrictions on non-simple properties are left out. A node's name is a hash of what it says, so equal ones are one."""
    one = a.roles.where("role = 'range'").groupBy("p").agg(F.count("*").alias("k"), F.min("cls").alias("only")).where("k = 1").select("p", "only")
    said = declared_ranges(a, tau).where(F.col("cls") != THING).select("p", F.col("cls").alias("on"))
    own = a.restrictions.join(hard, "p", "left_anti").join(one, "p", "left").join(said, "p", "left")
    q = F.when(F.col("on").isNotNull(), "Qualified").otherwise("")
    name = lambda n: F.concat(F.lit(f"owl:{n}"), q, F.lit("Cardinality"))
    exact = F.col("min_n") == F.col("max_n")
    whole = F.when(F.col("on").isNotNull(), "owl:qualifiedCardinality").otherwise("owl:cardinality")
    parts = F.array(
        F.when(exact, F.struct(whole.alias("p"), F.col("max_n").alias("n"))),
        F.when(~exact & (F.col("min_n") > 0), F.struct(name("min").alias("p"), F.col("min_n").alias("n"))),
        F.when(~exact & (F.col("max_n") < 999), F.struct(name("max").alias("p"), F.col("max_n").alias("n"))),
    )
    counted = own.withColumn("parts", F.filter(parts, lambda x: x.isNotNull()))
    text = F.array_join(F.transform("parts", lambda x: F.concat(x["p"], F.lit("="), x["n"].cast("string"))), " ")
    counted = counted.withColumn("node", _node(F.col("p"), text, F.coalesce("on", F.lit(""))))
    node, number = F.col("node"), "xsd:nonNegativeInteger"
    some = own.where("min_n >= 1 AND only IS NOT NULL").withColumn("node", _node(F.col("p"), F.lit("some"), F.col("only")))
    out = rows(counted, F.col("cls"), SUBCLASS, node, "bnode").unionByName(rows(counted, node, "owl:onClass", F.col("on")))
    out = out.unionByName(rows(counted.select("node", F.explode("parts").alias("x")), node, F.col("x.p"), F.col("x.n"), "literal", number))
    out = out.unionByName(rows(some, F.col("cls"), SUBCLASS, node, "bnode")).unionByName(rows(some, node, "owl:someValuesFrom", F.col("only")))
    for df in (counted, some):
        out = out.unionByName(rows(df, node, TYPE, "owl:Restriction")).unionByName(rows(df, node, "owl:onProperty", F.col("p")))
    return out


def _node(*parts: Column) -> Column:
    return F.concat(F.lit("_:r"), F.sha2(F.concat_ws("|", *parts).cast("binary"), 256))


def header(spark, iri: str, meta: dict[str, str]) -> DataFrame:
    """The ontology and its title, creator, date, description and the like."""
    said = [(iri, TYPE, "owl:Ontology", "iri", "", "")] + [(iri, k if ":" in k else f"dc:{k}", v, "literal", "", "") for k, v in meta.items()]
    return spark.createDataFrame(said, ", ".join(f"{c} string" for c in COLUMNS))


def build_tbox(a: Analysis, iri: str = "https://example.org/tbox/generated", meta: dict[str, str] | None = None, tau: float = induction.TAU_DOMAIN) -> DataFrame:
    """The whole schema as triples."""
    hard = non_simple(a)
    out = header(a.graph.sparkSession, iri, meta or {"title": "TBox", "creator": "tessera", "description": ""})
    return cut(merged(out, class_axioms(a), property_axioms(a, hard, tau), restriction_axioms(a, hard, tau)))


def well_formed_restrictions(tbox: DataFrame) -> DataFrame:
    """tbox without restrictions that lack a property or any constraint, and without what refers to them."""
    nodes = tbox.where((F.col("p") == TYPE) & (F.col("o") == "owl:Restriction")).select("s").distinct()
    whole = tbox.where("p = 'owl:onProperty'").select("s").join(tbox.where(F.col("p").isin(CONSTRAINTS)).select("s"), "s", "left_semi")
    gone = nodes.join(whole, "s", "left_anti")
    out = tbox.join(gone, "s", "left_anti")
    return out.join(gone.select(F.col("s").alias("o"), F.lit(SUBCLASS).alias("p")), ["p", "o"], "left_anti").select(COLUMNS)


def dedup_restrictions(tbox: DataFrame) -> DataFrame:
    """tbox with each group of restrictions that say the same made one, the smallest; subclass statements follow."""
    nodes = tbox.where((F.col("p") == TYPE) & (F.col("o") == "owl:Restriction")).select("s").distinct()
    said = tbox.where(F.col("p").isin("owl:onProperty", "owl:onClass", *CONSTRAINTS)).join(nodes, "s", "left_semi")
    prints = said.groupBy("s").agg(F.sort_array(F.collect_set(F.struct("p", "o"))).alias("print"))
    renames = prints.join(prints.groupBy("print").agg(F.min("s").alias("canonical")), "print").where("s != canonical").select("s", "canonical")
    return redirected(tbox, renames)


def strip_tbox(abox: DataFrame, tbox: DataFrame, alias: DataFrame) -> DataFrame:
    """The facts of abox: no provenance, no schema types, nothing that tbox says of its terms, no class expressions; aliased types are canonical."""
    known = tbox.where(~F.col("s").startswith("_:")).select("s").distinct()
    shapes = abox.where(F.col("p").isin("owl:onProperty", "owl:unionOf", "owl:intersectionOf") & F.col("s").startswith("_:")).select("s").distinct()
    t = abox.where(~F.col("p").isin(PROVENANCE) & ~((F.col("p") == TYPE) & F.col("o").isin(SCHEMA_TYPES)))
    of_schema = t.where(F.col("p").isin(SCHEMA_PREDICATES)).join(known, "s", "left_anti")
    t = of_schema.unionByName(t.where(~F.col("p").isin(SCHEMA_PREDICATES))).join(shapes, "s", "left_anti")
    types = induction.folded(t.where(F.col("p") == TYPE), alias)
    return merged(types, t.where(F.col("p") != TYPE))


def build_merged(tbox: DataFrame, abox: DataFrame, alias: DataFrame) -> DataFrame:
    """Schema and facts in one graph, individuals declared as such, hash-named ones with labels that can be read."""
    facts = cut(strip_tbox(abox, tbox, alias))
    people = facts.where((F.col("p") == TYPE) & (F.col("o_kind") == "iri") & ~F.col("o").isin(META) & ~F.col("s").startswith("_:")).select("s").distinct()
    return label_individuals(merged(tbox, facts, rows(people, F.col("s"), TYPE, "owl:NamedIndividual")))


def label_individuals(t: DataFrame) -> DataFrame:
    """t with labels 'Class — Parent (detail)' for individuals whose name is a hash and whose label is missing, one too, or short.

    The parent is the smallest node that points here and has a label to read; the detail, where several members of a class
    share the parent, is the best telling literal of up to 80 characters.
    """
    t = cut(t)  # read several times
    ty = induction.types(t).distinct()
    words = t.where((F.col("p") == LABEL) & (F.col("o_kind") == "literal")).groupBy("s").agg(F.max(F.struct(F.length("o"), F.col("o"))).getField("o").alias("label"))
    words = cut(words)
    classes = ty.groupBy("s").agg(F.min(plain_name(F.col("cls"))).alias("cls"))
    poor = classes.join(words, "s", "left").where(is_hash_name(plain_name(F.col("s"))) & (F.col("label").isNull() | is_hash_name(F.col("label")) | (F.length("label") <= 2)))
    poor = cut(poor.select("s", "cls"))
    clear = words.where(~is_hash_name(F.col("label")) & (F.length("label") > 1)).select(F.col("s").alias("parent"), "label")
    points = t.where((F.col("o_kind") == "iri") & ~F.col("p").isin(SKIPPED) & ~F.col("s").startswith("_:")).select(F.col("s").alias("parent"), F.col("o").alias("s")).distinct()
    above = points.join(poor, "s", "left_semi").join(clear, "parent").groupBy("s").agg(F.min(F.struct("parent", "label")).alias("x")).select("s", "x.parent", F.col("x.label").alias("above"))
    shared = points.join(ty, "s").groupBy("parent", "cls").agg(F.count("*").alias("n")).where("n > 1").select("parent", F.col("cls").alias("of"))
    crowded = above.join(ty.select("s", F.col("cls").alias("of")), "s").join(shared, ["parent", "of"], "left_semi").select("s").distinct().withColumn("crowded", F.lit(True))
    name, score = F.lower(plain_name(F.col("p"))), F.lit(99)
    for k, word in reversed(list(enumerate(TELLING))):
        score = F.when(name.contains(word), k).otherwise(score)
    value = F.trim("o")
    said = t.where("o_kind = 'literal'").join(poor, "s", "left_semi").where((value != "") & (F.length(value) <= 80))
    detail = said.groupBy("s").agg(F.min(F.struct(score.alias("k"), F.length(value).alias("n"), value.alias("v"))).getField("v").alias("detail"))
    full = poor.join(above, "s", "left").join(crowded, "s", "left").join(detail, "s", "left")
    base = F.concat_ws(" — ", "cls", "above")
    text = F.when(F.col("above").isNotNull() & F.col("crowded") & F.col("detail").isNotNull(), F.concat(base, F.lit(" ("), "detail", F.lit(")"))).otherwise(base)
    kept = t.where(F.col("p") != LABEL).unionByName(t.where(F.col("p") == LABEL).join(poor, "s", "left_anti").select(COLUMNS))
    return merged(kept, rows(full, F.col("s"), LABEL, text, "literal"))
