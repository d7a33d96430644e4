"""A training corpus from `documents`: quality, lines, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and reads all that its predecessor kept; run() writes each stage's rows to the
shared folder and reads them back, so a lost executor costs no earlier stage. All stages but the last return the columns
of `documents`, other columns of docs included; n_chars follows where a text has become shorter. Null and empty texts,
null and repeated ids and empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import op1_near_dedup, op2_packing, op3_line_dedup, op4_quality, op8_decontamination
from tessera.llm.common import settle, table


def _sized(out: DataFrame, docs: DataFrame, changed: str | None = None) -> DataFrame:
    """The columns of docs, n_chars set to what is left of a changed text."""
    size = F.length("text").cast("long")
    if changed:
        size = F.when(F.expr(changed), size).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else size
    return out.select(*[size.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" and changed else F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine does not reject."""
    machine = op4_quality.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return op4_quality.keep_good(docs, machine)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of which a near duplicate stays elsewhere."""
    return _sized(op3_line_dedup.dedup_lines(docs), docs, "n_dropped > 0")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return op1_near_dedup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of `benchmark`; one of which nothing else is left goes."""
    out = op8_decontamination.without_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return _sized(out, docs, "n_chars IS DISTINCT FROM length(text)" if "n_chars" in docs.columns else None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences of at most 1024 tokens."""
    return op2_packing.pack(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]
#: The quality model's arithmetic and the packing are beyond SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
