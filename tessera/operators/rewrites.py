"""Rewrites of graphs; each is triples in, triples out, as joins and anti-joins over the set of statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.triples import COLUMNS, LABEL, TYPE
from ..sources.vocabulary import LABEL_HINTS, META
from ..functions.terms import path_name
from .patterns import cut, dealt, merged

#: Types that are no classes of individuals, those of properties included.
TYPES = [*META, *(f"owl:{x}" for x in ("InverseFunctionalProperty", "TransitiveProperty", "SymmetricProperty", "Restriction"))]


def rename_predicate(t: DataFrame, old: str, new: str) -> DataFrame:
    return t.withColumn("p", F.when(F.col("p") == old, new).otherwise(F.col("p"))).distinct()


def retype(t: DataFrame, old: str, new: str) -> DataFrame:
    return t.withColumn("o", F.when((F.col("p") == TYPE) & (F.col("o") == old), new).otherwise(F.col("o"))).distinct()


def drop_nodes(t: DataFrame, nodes: DataFrame) -> DataFrame:
    """t without the statements from or to nodes (column s)."""
    gone = nodes.select(F.col("s").alias("_n")).distinct()
    return t.join(gone, F.col("s") == F.col("_n"), "left_anti").join(gone, (F.col("o") == F.col("_n")) & (F.col("o_kind") != "literal"), "left_anti")


def flatten(t: DataFrame, via: str, cls: str, properties: list[str]) -> DataFrame:
    """e -via-> n -sub-> v becomes e -sub-> v for nodes n of a class; those nodes go with all their statements."""
    nodes = t.where((F.col("p") == TYPE) & (F.col("o") == cls)).select("s").distinct()
    hop = t.where(F.col("p") == via).select(F.col("s").alias("e"), F.col("o").alias("s")).join(nodes, "s", "left_semi")
    sub = t.where(F.col("p").isin(properties)).join(hop, "s").drop("s").withColumnRenamed("e", "s")
    return merged(drop_nodes(t, nodes), sub)


def canonical_individuals(t: DataFrame, cls: str) -> DataFrame:
    """(s, canonical) of a class's individuals that have the same properties and values; those without any are left out."""
    own = t.where((F.col("p") == TYPE) & (F.col("o") == cls)).select("s").distinct()
    said = t.where(~F.col("p").isin(TYPE, LABEL, "owl:sameAs")).join(own, "s", "left_semi").distinct()
    prints = said.groupBy("s").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("p", "o", "o_kind", "o_dt", "o_lang")))), 256).alias("print"))
    least = prints.groupBy("print").agg(F.min("s").alias("canonical"))
    return prints.join(least, "print").select("s", "canonical")


def dedup_individuals(t: DataFrame, cls: str) -> DataFrame:
    """t with each group of equal individuals made one, its smallest; references follow."""
    return redirected(t, canonical_individuals(t, cls).where("s != canonical"))


def class_order(t: DataFrame) -> list[str]:
    """The classes of t's individuals, those that others' individuals refer to first; a cycle goes on with its smallest.

    An individual of several classes stands for the first in name, and for all of them where it refers to others.
    """
    typed = t.where((F.col("p") == TYPE) & (F.col("o_kind") == "iri") & ~F.col("o").isin(TYPES)).where(~F.col("s").startswith("_:")).select("s", F.col("o").alias("cls")).distinct()
    first = typed.groupBy(F.col("s").alias("o")).agg(F.min("cls").alias("to"))
    edges = t.where("o_kind = 'iri'").select("s", "o").join(typed, "s").join(first, "o").where("cls != to").select("cls", "to").distinct().collect()  # classes, not individuals
    left = {r["cls"]: set() for r in typed.select("cls").distinct().collect()}
    for r in edges:
        left[r["cls"]].add(r["to"])
    order: list[str] = []
    while left:
        ready = sorted(c for c, to in left.items() if not to & left.keys()) or [min(left)]
        order += ready
        for c in ready:
            del left[c]
    return order


def dedup_all_individuals(t: DataFrame) -> DataFrame:
    """dedup_individuals for every class in class_order, so that references are equal before those that hold them are compared."""
    for cls in class_order(t):
        t = cut(dedup_individuals(t, cls))
    return t


def redirected(t: DataFrame, renames: DataFrame) -> DataFrame:
    """t with the nodes of renames (s, canonical) replaced wherever they stand."""
    return dealt(renamed(t, renames), "s", "p", "o").distinct()


def renamed(t: DataFrame, renames: DataFrame, moved: Column | None = None) -> DataFrame:
    """redirected, with what has become a repeat; of renamed subjects only the statements of which moved is true, if it is given."""
    a, b = renames.select("s", F.col("canonical").alias("_s")), renames.select(F.col("s").alias("o"), F.col("canonical").alias("_o"))
    own = t.join(a, "s", "left")
    own = own.where(F.col("_s").isNull() | moved) if moved is not None else own
    literal = own.where("NOT coalesce(o_kind != 'literal', false)").select(F.coalesce("_s", "s").alias("s"), "p", "o", "o_kind", "o_dt", "o_lang")
    node = own.where("o_kind != 'literal'").join(b, "o", "left").select(F.coalesce("_s", "s").alias("s"), "p", F.coalesce("_o", "o").alias("o"), "o_kind", "o_dt", "o_lang")
    return literal.unionByName(node)


def materialise_inverses(t: DataFrame, inverses: DataFrame) -> DataFrame:
    """t and, for every (p, q) of inverses, the statements turned round, both ways; literals have no inverse."""
    both = inverses.select("p", "q").union(inverses.select(F.col("q").alias("p"), F.col("p").alias("q"))).distinct()
    turned = t.where("o_kind != 'literal'").join(both, "p").select(F.col("o").alias("s"), F.col("q").alias("p"), F.col("s").alias("o"), F.lit("iri").alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang"))
    return merged(t, turned)


def merge_nodes(t: DataFrame, via: str) -> DataFrame:
    """The statements of nodes behind via, copied to each of their holders; the nodes and via go."""
    held = t.where(F.col("p") == via).select(F.col("s").alias("e"), F.col("o").alias("s"))
    copies = t.where(F.col("p") != TYPE).join(held, "s").drop("s").withColumnRenamed("e", "s")
    return merged(drop_nodes(t, held), copies)


def part_of(labels: DataFrame) -> DataFrame:
    """(s, whole) of (s, label): a label 'name - rest' is part of the smallest node whose label is 'name'."""
    named = labels.groupBy(F.col("label").alias("head")).agg(F.min("s").alias("whole"))
    own = labels.where(F.col("label").contains(" - ")).select("s", F.trim(F.substring_index("label", " - ", 1)).alias("head"))
    return own.join(named, "head").where("s != whole").select("s", "whole")


def collapse(t: DataFrame, p: str, level: Column, prefix: str) -> DataFrame:
    """Literals of p replaced by a shared node of their level."""
    node = F.concat(F.lit(prefix), level)
    hit = F.col("p") == p
    return t.select("s", "p", F.when(hit, node).otherwise(F.col("o")).alias("o"), F.when(hit, "iri").otherwise(F.col("o_kind")).alias("o_kind"), "o_dt", "o_lang").distinct()


def prune_classes(used: DataFrame, parents: DataFrame) -> DataFrame:
    """Classes (cls) that have members (used) or keep a subclass (parents: child, parent): empty ones go until none is left."""
    kept = cut(used.select("cls").distinct())
    size = kept.count()
    while True:
        more = parents.join(kept.select(F.col("cls").alias("child")), "child").select(F.col("parent").alias("cls"))
        kept = cut(kept.union(more).distinct())
        now = kept.count()
        if now == size:
            return kept
        size = now


def label_scores(t: DataFrame, cls: str) -> DataFrame:
    """(p, coverage, uniqueness, score) of a class's data properties as labels.

    Those with values for half of the members, on average 250 characters or less, two fifths of them different; score is
    .3 coverage + .5 uniqueness + .1 shortness (1 - average / 250) and .2 for a name that hints at a label.
    """
    own = t.where((F.col("p") == TYPE) & (F.col("o") == cls)).select("s").distinct()
    n = own.agg(F.count("*").alias("n"))
    said = t.where((F.col("o_kind") == "literal") & ~F.col("p").isin(TYPE, LABEL)).join(own, "s", "left_semi")
    by = said.groupBy("p").agg(F.countDistinct("o").alias("values"), F.count("*").alias("all"), F.avg(F.length("o")).alias("size"))
    one = by.join(F.broadcast(n))  # a single row
    coverage, unique = F.col("all") / F.col("n"), F.col("values") / F.col("all")
    hint = F.lower(path_name(F.col("p"))).rlike("|".join(LABEL_HINTS)).cast("int") * F.lit(0.2)
    score = 0.3 * coverage + 0.5 * unique + 0.1 * F.greatest(F.lit(0.0), 1 - F.col("size") / 250) + hint
    fit = one.where((coverage >= 0.5) & (F.col("size") <= 250) & (unique >= 0.4))
    return fit.select("p", coverage.alias("coverage"), unique.alias("uniqueness"), score.alias("score"))


def inserted(t: DataFrame, more: DataFrame) -> DataFrame:
    return merged(t, more.select(COLUMNS))
