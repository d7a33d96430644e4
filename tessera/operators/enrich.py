"""Enrichment of an analysis by a language model that the caller plugs in; without one nothing changes.

A provider takes a list of prompts and gives a list of answers. What answers may hold is read from the first JSON object in
them; an answer without one counts as none. Answers name classes and properties by their local names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import plain_name, salvaged_json
from ..sources.triples import COLUMNS, LABEL, TYPE
from .patterns import merged
from .schema import COMMENT, Analysis, rows

Provider = Callable[[list[str]], list[str]]
ENRICH = """Describe these classes and properties of an ontology. Answer with one JSON object alone:
{"dc_meta": {"title", "description", "creator"}, "class_enrichments": {name: {"label_it", "label_en", "comment"}},
"property_enrichments": {name: {"label_it", "label_en", "comment", "functional", "symmetric", "transitive", "inverse_functional"}},
"extra_subclassof": [[child, parent]], "extra_disjoint": [{"classA", "classB", "reason"}]}
Classes: %s
Properties: %s"""
REVIEW = """Judge these axioms, each with the share of facts that bear it out. Answer with one JSON object alone:
{"property.role": {"decision": "ACCEPT" or "REJECT", "reason"}}
%s"""


def enrich_prompt(a: Analysis) -> str:
    """Names of classes and properties alone, so its length grows with the schema, not with the facts."""
    classes = [r[0] for r in a.classes.select(plain_name(F.col("cls"))).distinct().sort(F.asc(plain_name(F.col("cls")))).collect()]
    props = [r[0] for r in a.props.select(plain_name(F.col("p")).alias("n")).distinct().sort("n").collect()]
    return ENRICH % (", ".join(classes), ", ".join(props))


def enriched(a: Analysis, said: dict | None) -> tuple[Analysis, DataFrame, dict[str, str]]:
    """(analysis with what the answer adds, triples of labels and comments, metadata); pairs of unknown classes are left out.

    Characteristics that the answer affirms are set, none is taken away; disjoint pairs are added to the counted ones.
    """
    spark = a.graph.sparkSession
    said = said or {}
    empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in COLUMNS))
    names = a.classes.select(plain_name(F.col("cls")).alias("name"), F.col("cls").alias("iri")).union(a.props.select(plain_name(F.col("p")), "p")).distinct()
    texts = []
    for part in ("class_enrichments", "property_enrichments"):
        for name, x in (said.get(part) or {}).items():
            texts += [(name, p, str(x[k]), lang) for k, p, lang in (("label_it", LABEL, "it"), ("label_en", LABEL, "en"), ("comment", COMMENT, "")) if x.get(k)]
    words = empty
    if texts:
        found = spark.createDataFrame(texts, "name string, p string, o string, lang string").join(names, "name")
        words = rows(found, F.col("iri"), F.col("p"), F.col("o"), "literal", "", F.col("lang"))
    classes = a.classes.select(plain_name(F.col("cls")).alias("name"), "cls")

    def pairs(found: list[tuple[str, str]], x: str, y: str) -> DataFrame:
        df = spark.createDataFrame(found, "n string, m string")
        return df.join(classes.select(F.col("name").alias("n"), F.col("cls").alias(x)), "n").join(classes.select(F.col("name").alias("m"), F.col("cls").alias(y)), "m").select(x, y)

    parents, disjoint, marks = a.parents, a.disjoint, a.marks
    extra = [(str(x[0]), str(x[1])) for x in said.get("extra_subclassof") or [] if len(x) == 2 and x[0] != x[1]]
    if extra:
        parents = parents.union(pairs(extra, "child", "parent")).distinct()
    apart = [(str(x["classA"]), str(x["classB"])) for x in said.get("extra_disjoint") or [] if x.get("classA") and x.get("classB")]
    if apart:
        both = pairs(apart, "a", "b").where("a != b")
        disjoint = disjoint.union(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    for mark in ("functional", "inverse_functional", "symmetric", "transitive"):
        yes = [n for n, x in (said.get("property_enrichments") or {}).items() if x.get(mark) is True]
        if yes:
            marks = marks.withColumn(mark, F.col(mark) | plain_name(F.col("p")).isin(yes))
    meta = {k: v for k, v in (said.get("dc_meta") or {}).items() if v}
    return replace(a, parents=parents, disjoint=disjoint, marks=marks), words, meta


def reviewed(a: Analysis, said: dict | None, tau: float) -> Analysis:
    """a without the roles that are below tau and that the answer rejects: a rejected role gives no axiom at all."""
    gone = [(k,) for k, x in (said or {}).items() if isinstance(x, dict) and str(x.get("decision", "")).upper() == "REJECT"]
    if not gone:
        return a
    rejected = a.graph.sparkSession.createDataFrame(gone, "key string")
    conf = a.confidence.withColumn("key", F.concat_ws(".", plain_name(F.col("p")), "role"))
    low = conf.where(F.col("confidence") < F.lit(tau)).join(rejected, "key", "left_semi")
    return replace(a, confidence=conf.join(low.select("p", "role"), ["p", "role"], "left_anti").drop("key"))


def review_prompt(a: Analysis, tau: float) -> str:
    low = a.confidence.where(F.col("confidence") < F.lit(tau)).select(F.concat_ws(".", plain_name(F.col("p")), "role").alias("k"), plain_name(F.col("cls")).alias("c"), "confidence").sort("k").collect()  # a row a property
    return REVIEW % "\n".join(f"{r['k']}: {r['c']} ({r['confidence']:.3f})" for r in low) if low else ""


def ask(provider: Provider | None, prompt: str) -> dict | None:
    """The object in the provider's answer; None without a provider, a prompt or an answer that can be read."""
    return salvaged_json(provider([prompt])[0]) if provider and prompt else None


def with_labels(tbox: DataFrame, words: DataFrame) -> DataFrame:
    """tbox with labels and comments of words in place of all labels, and of counts, of the terms that have any."""
    both = words.select("s", "p").distinct()
    kept = tbox.join(both, ["s", "p"], "left_anti").select(COLUMNS)
    return merged(kept, words)


__all__ = ["TYPE", "Provider", "ask", "enrich_prompt", "enriched", "review_prompt", "reviewed", "with_labels"]
