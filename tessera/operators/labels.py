"""Labels of individuals and classes by configuration or by counting, and individuals made one by what a text is classified as."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import path_name
from ..sources.triples import COLUMNS, LABEL, TYPE
from ..sources.workers import ship
from .patterns import cut, dealt, merged
from .rewrites import TYPES, label_scores, renamed
from .schema import rows


@dataclass
class Config:
    """What a configuration file says: flatten rules, labels of individuals by class, labels of classes, classification of texts."""

    flatten: list[dict] = field(default_factory=list)
    fix_labels: dict[str, dict] = field(default_factory=dict)
    class_labels: dict[str, dict[str, str]] = field(default_factory=dict)
    extract_desc: dict = field(default_factory=dict)


def load_config(near: str, name: str = "postprocess_config.json") -> Config:
    """From the folder of the file `near`, else from the working folder; an empty one if neither has it."""
    for folder in (os.path.dirname(near), "."):
        path = os.path.join(folder, name)
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                said = json.load(f)
            return Config(**{k: v for k, v in said.items() if k in Config.__dataclass_fields__})
    return Config()


def members(t: DataFrame, cls: str) -> DataFrame:
    return t.where((F.col("p") == TYPE) & (F.col("o") == cls) & ~F.col("s").startswith("_:")).select("s").distinct()


def relabelled(t: DataFrame, new: DataFrame) -> DataFrame:
    """t with the labels of new (s, label) in place of all others of s."""
    new = cut(new.where("label IS NOT NULL AND label != ''").select("s", "label"))
    old = t.where(F.col("p") == LABEL).join(new.select("s"), "s", "left_anti").select(COLUMNS)
    kept = t.where(F.col("p") != LABEL).select(COLUMNS).unionByName(old)
    return dealt(kept.unionByName(rows(new, F.col("s"), LABEL, F.col("label"), "literal")), "s", "p", "o").distinct()


def from_property(t: DataFrame, cls: str, p: str, as_uri: bool = False) -> DataFrame:
    """t with the smallest value of p as label of a class's members; as_uri makes that value, if an IRI, a literal of type xsd:anyURI."""
    said = t.where(F.col("p") == p).join(members(t, cls), "s", "left_semi")
    best = cut(said.groupBy("s").agg(F.min(F.struct("o", "o_kind", "o_dt", "o_lang")).alias("x")).select("s", "x.*"))
    out = relabelled(t, best.select("s", F.trim("o").alias("label")))
    if not as_uri:
        return out
    turned = best.where((F.col("o_kind") == "iri") & (F.trim("o") != ""))
    old = turned.select("s", F.lit(p).alias("p"), "o", "o_kind")
    return merged(out.join(old, ["s", "p", "o", "o_kind"], "left_anti").select(COLUMNS), rows(turned, F.col("s"), p, F.col("o"), "literal", "xsd:anyURI"))


def _referred(t: DataFrame, of: DataFrame) -> DataFrame:
    """(s, p, o, label): the smallest label of each node that members of `of` refer to."""
    names = t.where((F.col("p") == LABEL) & (F.col("o_kind") == "literal")).groupBy(F.col("s").alias("o")).agg(F.min(F.trim("o")).alias("label")).where("label != ''")
    return t.where("o_kind = 'iri'").join(of, "s", "left_semi").select("s", "p", "o").distinct().join(names, "o")


def composed(t: DataFrame, cls: str, properties: list[str], separator: str = " | ") -> DataFrame:
    """t with a class's members labelled by the labels of what properties point to, in the order of properties, then of nodes."""
    place = F.array_position(F.array(*[F.lit(p) for p in properties]), F.col("p"))
    found = _referred(t.where(F.col("p").isin(*properties) | (F.col("p") == LABEL)), members(t, cls))
    texts = found.groupBy("s").agg(F.sort_array(F.collect_list(F.struct(place.alias("k"), F.col("o"), F.col("label")))).alias("xs"))  # a node's own references
    return relabelled(t, texts.select("s", F.array_join(F.transform("xs", lambda x: x["label"]), separator).alias("label")))


def configured(t: DataFrame, config: Config) -> DataFrame:
    """t with the labels that a configuration asks for, of classes and of individuals."""
    spark, texts = t.sparkSession, [(c, x, lang) for c, said in config.class_labels.items() for lang in ("it", "en") if (x := said.get(lang))]
    if config.class_labels:
        named = spark.createDataFrame([(c, LABEL) for c in config.class_labels], "s string, p string")
        new = spark.createDataFrame(texts, "s string, o string, lang string")
        t = merged(t.join(named, ["s", "p"], "left_anti").select(COLUMNS), rows(new, F.col("s"), LABEL, F.col("o"), "literal", "", F.col("lang")))
    for cls, said in config.fix_labels.items():
        if "compose_from_labels_of" in said:
            t = cut(composed(t, cls, said["compose_from_labels_of"], said.get("separator", " | ")))
        else:
            t = cut(from_property(t, cls, said["property"], said.get("convert_to_anyuri", False)))
    return t


def auto_labelled(t: DataFrame, cls: str) -> DataFrame:
    """t with members of a class labelled by its best data property, else by the labels of what they refer to.

    A class of fewer than two members stays as it is, and so does a label that is shorter than the new one or as long.
    """
    own = cut(members(t, cls))
    if len(own.take(2)) < 2:
        return t
    best = label_scores(t, cls).agg(F.min(F.struct((-F.col("score")).alias("k"), F.col("p"))).getField("p").alias("p")).first()["p"]
    if best:
        new = t.where((F.col("p") == best) & (F.col("o_kind") == "literal")).join(own, "s", "left_semi").groupBy("s").agg(F.min(F.trim("o")).alias("label"))
    else:
        found = _referred(t.where(~((F.col("p") == TYPE) & F.col("o").isin(TYPES))), own).where(F.length("label") <= 120)
        new = found.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("p", "o", "label"))).alias("xs")).select("s", F.array_join(F.transform("xs", lambda x: x["label"]), " | ").alias("label"))
    now = t.where(F.col("p") == LABEL).groupBy("s").agg(F.min(F.trim("o")).alias("now"))
    better = new.join(now, "s", "left").where("now IS NULL OR now = '' OR length(label) < length(now)")
    return relabelled(t, better.select("s", "label"))


def text_lengths(t: DataFrame) -> DataFrame:
    """(cls, p, n, size): the average length of a class's texts by property; an individual of several classes counts for the smallest."""
    first = t.where((F.col("p") == TYPE) & (F.col("o_kind") == "iri") & ~F.col("o").isin(TYPES) & ~F.col("s").startswith("_:")).groupBy("s").agg(F.min("o").alias("cls"))
    said = t.where((F.col("o_kind") == "literal") & ~F.col("p").isin(TYPE, LABEL)).join(first, "s")
    return said.groupBy("cls", "p").agg(F.count("*").alias("n"), F.avg(F.length("o")).alias("size"))


def classifier(f: Callable[[list[str]], list[str]]) -> Callable[[Column], Column]:
    """A column function of a plug-in that names the class of each of a list of texts; called with one Arrow batch at a time."""

    ship()

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(f(values.tolist()))

    return run


def merged_by_class(t: DataFrame, cls: str, p: str, classify: Callable[[Column], Column]) -> DataFrame:
    """t with a class's members whose text (the smallest value of p) is classified alike made one, the smallest.

    It is labelled with the class's name and has all their texts; references follow, and what else is said of the others goes.
    """
    texts = t.where(F.col("p") == p).join(members(t, cls), "s", "left_semi").groupBy("s").agg(F.min("o").alias("text"))
    found = cut(texts.select("s", F.trim(F.regexp_replace(F.trim(classify(F.col("text"))), "^[\"']+|[\"']+$", "")).alias("kind")))
    least = found.groupBy("kind").agg(F.min("s").alias("canonical"))
    renames = cut(found.join(least, "kind").where("s != canonical").select("s", "canonical"))
    return relabelled(renamed(t, renames, F.col("p") == p), least.select(F.col("canonical").alias("s"), F.col("kind").alias("label")))


def short_name(c: Column) -> Column:
    return F.element_at(F.split(path_name(c), ":"), -1)
