"""What a rewrite lost, which labels repeat, and where facts contradict a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import datatype, plain_name
from ..sources.triples import LABEL, TYPE
from ..sources.vocabulary import PROVENANCE
from .patterns import cut
from .rewrites import TYPES
from .schema import Analysis

#: Properties that need no declaration.
BUILT_IN = ["rdfs:label", "rdfs:comment", "rdfs:seeAlso", "rdfs:isDefinedBy", "rdfs:subClassOf", "rdfs:domain", "rdfs:range"]


def individual_types(t: DataFrame) -> DataFrame:
    """(s, cls) of individuals, those of schema types left out; blank nodes are none."""
    return t.where((F.col("p") == TYPE) & (F.col("o_kind") == "iri") & ~F.col("o").isin(TYPES) & ~F.col("s").startswith("_:")).select("s", F.col("o").alias("cls")).distinct()


def individual_values(t: DataFrame) -> DataFrame:
    """(s, p, o) of individuals; types, sameAs and blank nodes left out."""
    said = t.where(~F.col("p").isin(TYPE, "owl:sameAs") & (F.col("o_kind") != "bnode"))
    return said.join(individual_types(t).select("s").distinct(), "s", "left_semi").select("s", "p", "o").distinct()


def coverage(before: DataFrame, after: DataFrame, excluded: list[str] = PROVENANCE, excluded_classes: list[str] = []) -> DataFrame:  # noqa: B006
    """(check, s, p, o): what before has and after lacks.

    individual: s of a type o; value: s, p, o of individuals that are still there; type: s, o likewise; class, property:
    those that after does not declare; excluded: values of properties that are left out on purpose.
    """
    old, new = cut(individual_types(before)), cut(individual_types(after))
    there = new.select("s").distinct()
    values, kept = individual_values(before), individual_values(after)
    row = lambda df, check, s, p, o: df.select(F.lit(check).alias("check"), s.alias("s"), p.alias("p"), o.alias("o"))
    none, s, p, o, cls = F.lit(None).cast("string"), F.col("s"), F.col("p"), F.col("o"), F.col("cls")
    still = cut(values.join(there, "s", "left_semi"))
    declared = lambda *kinds: after.where((p == TYPE) & o.isin(*kinds)).select("s").distinct()
    classes = old.select("cls").distinct().where(~cls.isin(excluded_classes)).join(declared("owl:Class").withColumnRenamed("s", "cls"), "cls", "left_anti")
    props = values.select("p").distinct().where(~p.isin(excluded + BUILT_IN)).join(declared("owl:ObjectProperty", "owl:DatatypeProperty").withColumnRenamed("s", "p"), "p", "left_anti")
    out = row(old.join(there, "s", "left_anti").groupBy("s").agg(F.min("cls").alias("cls")), "individual", s, none, cls)
    out = out.unionByName(row(still.where(~p.isin(excluded)).join(kept, ["s", "p", "o"], "left_anti"), "value", s, p, o))
    out = out.unionByName(row(old.join(there, "s", "left_semi").join(new, ["s", "cls"], "left_anti"), "type", s, none, cls))
    out = out.unionByName(row(classes, "class", cls, none, none)).unionByName(row(props, "property", p, none, none))
    return out.unionByName(row(still.where(p.isin(excluded)), "excluded", s, p, o))


def coverage_summary(found: DataFrame) -> DataFrame:
    """(check, n) of coverage, every check with a row; `ok` is a check of its own: 1 if nothing was lost."""
    checks = found.sparkSession.createDataFrame([(x,) for x in ("individual", "value", "type", "class", "property", "excluded")], "check string")
    counts = checks.join(found.groupBy("check").agg(F.count("*").alias("n")), "check", "left").select("check", F.coalesce("n", F.lit(0)).alias("n"))
    ok = counts.where("check != 'excluded'").agg((F.sum("n") == 0).cast("long").alias("n")).select(F.lit("ok").alias("check"), "n")
    return counts.unionByName(ok)


def duplicate_pairs(t: DataFrame, p: str = LABEL) -> DataFrame:
    """(label, a, b, p, x, y): of labels of just two nodes the properties in which these differ, with each side's smallest value."""
    own = t.where((F.col("p") == p) & (F.col("o_kind") == "literal")).select(F.lower(F.trim("o")).alias("label"), "s").distinct()
    two = cut(own.groupBy("label").agg(F.min("s").alias("a"), F.max("s").alias("b"), F.count("*").alias("n")).where("n = 2").drop("n"))
    values = t.where(~F.col("p").isin(TYPE, LABEL)).groupBy("s", "p").agg(F.min("o").alias("v"))
    x = two.join(values.withColumnRenamed("s", "a"), "a").select("label", "a", "b", "p", F.col("v").alias("x"))
    y = two.join(values.withColumnRenamed("s", "b"), "b").select("label", "a", "b", "p", F.col("v").alias("y"))
    return x.join(y, ["label", "a", "b", "p"], "full").where(~F.col("x").eqNullSafe(F.col("y")))


def literal_clashes(t: DataFrame, functional: DataFrame, ranges: DataFrame) -> DataFrame:
    """(s, p, why): individuals with two values of a functional data property (p), or a value outside its declared datatype (p, cls)."""
    said = t.where("o_kind = 'literal'")
    many = said.join(functional.select("p"), "p", "left_semi").groupBy("s", "p").agg(F.countDistinct("o").alias("n")).where("n > 1").select("s", "p", F.lit("values").alias("why"))
    kind = datatype(F.col("o_dt"), F.col("o_lang"))
    typed = ranges.where(F.col("cls").startswith("xsd:") & (F.col("cls") != "xsd:anySimpleType"))
    odd = said.select("s", "p", kind.alias("dt")).join(typed, "p").where("dt != cls").select("s", "p", F.lit("datatype").alias("why")).distinct()
    return many.unionByName(odd)


def report(a: Analysis, tau: float) -> DataFrame:
    """(section, item, detail, n): what induction found, one row a fact; confidence as thousandths."""
    name = lambda c: plain_name(F.col(c))
    row = lambda df, section, item, detail, n: df.select(F.lit(section).alias("section"), item.alias("item"), detail.alias("detail"), n.cast("long").alias("n"))
    none, one = F.lit(""), F.lit(1)
    out = row(a.classes, "class", name("cls"), none, F.col("n"))
    out = out.unionByName(row(a.props, "property", name("p"), F.col("kind"), one)).unionByName(row(a.roles, "role", name("p"), F.concat_ws(" ", "role", name("cls")), F.col("n")))
    for mark in ("functional", "inverse_functional", "symmetric", "transitive"):
        out = out.unionByName(row(a.marks.where(F.col(mark)), "mark", name("p"), F.lit(mark), one))
    out = out.unionByName(row(a.functional_data.where("functional"), "mark", name("p"), F.lit("functional"), one)).unionByName(row(a.inverse, "inverse", name("p"), name("q"), one))
    out = out.unionByName(row(a.datatypes, "datatype", name("p"), F.col("datatype"), F.col("n"))).unionByName(row(a.parents, "subclass", name("child"), name("parent"), one))
    out = out.unionByName(row(a.disjoint, "disjoint", name("a"), name("b"), one))
    limits = F.when(F.col("min_n") == F.col("max_n"), F.concat(F.lit("exact "), "min_n")).otherwise(F.concat(F.lit("min "), "min_n", F.lit(" max "), "max_n"))
    out = out.unionByName(row(a.restrictions, "restriction", F.concat_ws(".", name("cls"), name("p")), limits, one))
    sure = F.when(F.col("confidence") > F.lit(tau), "accepted").otherwise("below")
    return out.unionByName(row(a.confidence, "confidence", F.concat_ws(".", name("p"), "role"), sure, F.round(F.col("confidence") * 1000)))


def missing_individuals(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select("s").distinct().join(after.select("s").distinct(), "s", "left_anti")


def lost_values(before: DataFrame, after: DataFrame) -> DataFrame:
    """(s, p, o) of individuals that are still there, but not with that value."""
    still = before.select("s", "p", "o").distinct().join(after.select("s").distinct(), "s", "left_semi")
    return still.join(after.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_anti")


def undeclared(t: DataFrame, declared: DataFrame) -> DataFrame:
    """Properties (p) in use that declared (column p) does not hold."""
    return t.select("p").distinct().join(declared, "p", "left_anti")


def duplicate_labels(labels: DataFrame) -> DataFrame:
    """(label, n) of (s, label): labels, trimmed and lower-cased, of more than one node."""
    return labels.groupBy(F.lower(F.trim("label")).alias("label")).agg(F.countDistinct("s").alias("n")).where("n > 1")


def clashes(t: DataFrame, disjoint: DataFrame) -> DataFrame:
    """(s, a, b): individuals of two classes that are disjoint (a, b)."""
    ty = t.where(F.col("p") == TYPE).select("s", F.col("o").alias("cls")).distinct()
    return ty.select("s", F.col("cls").alias("a")).join(disjoint, "a").join(ty.select("s", F.col("cls").alias("b")), ["s", "b"]).select("s", "a", "b")


def hierarchy(parents: DataFrame) -> DataFrame:
    """One row of (roots, leaves, average_depth, max_depth, average_breadth, max_breadth, nodes, edges) of (child, parent).

    Roots are the most general classes; a class's depth is its shortest way to one; breadth is the number of classes of a
    depth. Classes on cycles that no root reaches have no depth.
    """
    edges = cut(parents.select("child", "parent").distinct())
    roots = edges.select(F.col("parent").alias("cls")).join(edges.select(F.col("child").alias("cls")), "cls", "left_anti").distinct()
    depth = cut(roots.withColumn("depth", F.lit(0)))
    at, level = depth, 0
    while not at.isEmpty():
        level += 1
        at = edges.join(at.select(F.col("cls").alias("parent")), "parent").select(F.col("child").alias("cls")).distinct()
        at = cut(at.join(depth, "cls", "left_anti").withColumn("depth", F.lit(level)))
        depth = cut(depth.unionByName(at))
    leaves = edges.select(F.col("child").alias("cls")).join(edges.select(F.col("parent").alias("cls")), "cls", "left_anti").distinct()
    breadth = depth.groupBy("depth").agg(F.count("*").alias("n")).agg(F.avg("n").alias("average_breadth"), F.max("n").alias("max_breadth"))
    deep = depth.agg(F.sum((F.col("depth") == 0).cast("long")).alias("roots"), F.avg("depth").alias("average_depth"), F.max("depth").alias("max_depth"))
    nodes = edges.select("child").union(edges.select("parent")).agg(F.countDistinct("child").alias("nodes"))
    whole = nodes.crossJoin(edges.agg(F.count("*").alias("edges")))  # all of these are single rows
    return deep.crossJoin(leaves.agg(F.count("*").alias("leaves"))).crossJoin(breadth).crossJoin(whole)
