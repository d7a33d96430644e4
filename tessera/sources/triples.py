"""Triples: the schema, the direct mapping of relational tables, and N-Triples files.

A mapped graph is a union with one branch for each property. The property is a constant of its branch, so a filter on
`p` folds the other branches away and the scan that is left reads the subject's and the object's columns alone.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workers import ship

SCHEMA = "s string, p string, o string, o_kind string, o_dt string, o_lang string"
COLUMNS = ["s", "p", "o", "o_kind", "o_dt", "o_lang"]
TYPE, LABEL = "rdf:type", "rdfs:label"
#: Formats by extension.
FORMATS = {"ttl": "turtle", "turtle": "turtle", "rdf": "xml", "owl": "xml", "xml": "xml", "nt": "nt", "ntriples": "nt", "jsonld": "json-ld", "json": "json-ld", "n3": "n3"}


def detect_format(path: str) -> str:
    """By extension; turtle where it says nothing."""
    return FORMATS.get(path.rsplit(".", 1)[-1].lower(), "turtle")


def iri(kind: str, *keys: str) -> Column:
    return F.concat(F.lit(f"ex:{kind}/"), F.concat_ws("-", *[F.col(k).cast("string") for k in keys]))


def facts(df: DataFrame, s: Column, p: str, o: Column, kind: str = "literal", dt: str = "") -> DataFrame:
    """One branch: the triples (s, p, o) of the rows of df whose s and o are not null."""
    out = df.select(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).alias("o_dt"), F.lit("").alias("o_lang"))
    return out.where("s IS NOT NULL AND o IS NOT NULL")


def union(graphs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, graphs)


def graph(spark: SparkSession, sf_dir: str, *tables: str, repeats: bool = False) -> DataFrame:
    """The direct mapping of tables to triples; keys make all but the edges of lineitem distinct.

    repeats: these stay as often as the table has them, for operators that make a set of their statements anyway.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    out: list[DataFrame] = []

    def typed(df, s, cls):
        out.append(facts(df, s, TYPE, F.lit(f"ex:{cls}"), "iri"))

    for t in tables:
        df = read(t)
        if t == "documents":
            s = iri("document", "doc_id")
            typed(df, s, "Document")
            out += [facts(df, s, "ex:lang", F.col("lang")), facts(df, s, "ex:source", F.col("source"))]
        elif t == "labels":
            node = F.concat(F.lit("ex:label/q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))
            text = F.concat(F.lit("quality "), F.col("quality").cast("string"), F.lit(" toxic "), F.col("toxic").cast("string"))
            out += [facts(df, iri("document", "doc_id"), "ex:hasLabel", node, "iri")]
            out += [facts(df.select("quality", "toxic").distinct(), node, LABEL, text)]
        elif t == "conversations":
            s = iri("turn", "conv_id", "turn")
            typed(df, s, "Turn")
            out += [facts(df, s, "ex:role", F.col("role")), facts(df, s, "ex:inConversation", iri("conversation", "conv_id"), "iri")]
            after = df.select("conv_id", (F.col("turn") - 1).alias("turn")).where("turn >= 0")
            out += [facts(after.join(df.select("conv_id", "turn"), ["conv_id", "turn"]), iri("turn", "conv_id", "turn"), "ex:nextTurn", F.concat(F.lit("ex:turn/"), F.concat_ws("-", F.col("conv_id"), F.col("turn") + 1)), "iri")]
        elif t in ("customer", "supplier"):
            c = t[0]
            s = iri(t, f"{c}_{'cust' if c == 'c' else 'supp'}key")
            typed(df, s, t.capitalize())
            out += [facts(df, s, "ex:name", F.col(f"{c}_name")), facts(df, s, "ex:hasNation", iri("nation", f"{c}_nationkey"), "iri")]
            if c == "c":
                out += [facts(df, s, "ex:segment", F.col("c_mktsegment"))]
        elif t == "nation":
            s = iri("nation", "n_nationkey")
            typed(df, s, "Nation")
            out += [facts(df, s, "ex:name", F.col("n_name")), facts(df, s, "ex:inRegion", iri("region", "n_regionkey"), "iri")]
        elif t == "region":
            s = iri("region", "r_regionkey")
            typed(df, s, "Region")
            out += [facts(df, s, "ex:name", F.col("r_name"))]
        elif t == "part":
            s = iri("part", "p_partkey")
            typed(df, s, "Part")
            out += [facts(df, s, f"ex:{n}", F.col(f"p_{n}")) for n in ("name", "brand", "type")]
        elif t == "orders":
            s = iri("order", "o_orderkey")
            typed(df, s, "Order")
            out += [facts(df, s, "ex:hasCustomer", iri("customer", "o_custkey"), "iri"), facts(df, s, "ex:status", F.col("o_orderstatus")), facts(df, s, "ex:priority", F.col("o_orderpriority"))]
        elif t == "lineitem":
            s = iri("order", "l_orderkey")
            for p, kind, key in (("ex:contains", "part", "l_partkey"), ("ex:suppliedBy", "supplier", "l_suppkey")):
                pairs = df.select("l_orderkey", key)
                out.append(facts(pairs if repeats else pairs.distinct(), s, p, iri(kind, key), "iri"))  # of keys, which are narrower than terms
        else:
            raise ValueError(f"no mapping for table {t}")
    return union(out)


_TERM = r'(<[^>]*>|_:[^\s<>"]+)'
_LINE = rf'^\s*{_TERM}\s*<([^>]*)>\s*(?:{_TERM}|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*\.\s*(?:#.*)?$'
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def unescaped(text: str) -> str:
    """Escapes decoded in one pass from left to right, those of code points included."""
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPED.get(m[3], m[3]), text) if "\\" in text else text


def _unescape(c: Column) -> Column:
    ship()
    return F.pandas_udf(_unescaped, "string")(c)


def _unescaped(values: pd.Series) -> pd.Series:
    return values.map(unescaped, na_action="ignore")


def _plain(c: Column) -> Column:
    return F.regexp_replace(c, "^<|>$", "")


def parse_ntriples(lines: DataFrame, column: str = "value") -> DataFrame:
    """Triples of N-Triples lines, batch or stream; blank lines and comments are left out, and so is what rejected_lines gives."""
    part = lambda k: F.regexp_extract(column, _LINE, k)
    rows = lines.where(F.col(column).rlike(_LINE))
    found = rows.select(part(1).alias("s"), part(2).alias("p"), part(3).alias("node"), part(4).alias("text"), part(5).alias("o_dt"), part(6).alias("o_lang"))
    node = F.col("node")
    escaped = F.concat("s", "p", "node", "text").contains("\\")
    raw = found.select(
        _plain(F.col("s")).alias("s"), "p", F.when(node != "", _plain(node)).otherwise(F.col("text")).alias("o"),
        F.when(node.startswith("_:"), "bnode").when(node != "", "iri").otherwise("literal").alias("o_kind"), "o_dt", "o_lang", escaped.alias("escaped"),
    )
    return raw.select(*[F.when(F.col("escaped"), _unescape(F.col(c))).otherwise(F.col(c)).alias(c) if c in "spo" else F.col(c) for c in COLUMNS])


def rejected_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """The lines that are neither a statement nor blank nor a comment."""
    return lines.where(~F.col(column).rlike(_LINE) & ~F.col(column).rlike(r"^\s*(#.*)?$"))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return parse_ntriples(spark.read.text(path))


def format_ntriples(t: DataFrame) -> DataFrame:
    """One column `value` of N-Triples lines."""
    node = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    body = F.regexp_replace("o", r"\\", r"\\\\")
    for a, b in (('"', r'\\"'), ("\n", r"\\n"), ("\t", r"\\t"), ("\r", r"\\r")):
        body = F.regexp_replace(body, a, b)
    mark = F.when(F.col("o_lang") != "", F.concat(F.lit("@"), "o_lang")).when(F.col("o_dt") != "", F.concat(F.lit("^^<"), "o_dt", F.lit(">"))).otherwise("")
    o = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), body, F.lit('"'), mark)).otherwise(node(F.col("o")))
    return t.select(F.concat_ws(" ", node(F.col("s")), F.concat(F.lit("<"), "p", F.lit(">")), o, F.lit(".")).alias("value"))


def write_ntriples(t: DataFrame, path: str, mode: str = "errorifexists") -> None:
    format_ntriples(t).write.mode(mode).text(path)
