"""Rendezvous hashing of stable record keys over weighted shards, in DataFrame functions alone.

Law `key`: doc_id and the number of shards decide the shard. A record's draw for shard s is -ln(u) / weight with u from
a hash of (doc_id, s), and the smallest draw wins; as the draws do not depend on the number of shards, one more shard
takes records only into itself. A null doc_id is a key of its own, so all such rows share a shard; a null text has no
bytes and crc32 0. Repeated rows each get a slot. An empty table gives an empty result.

A slot is a record's place in its shard. Records are dealt by a hash of their content into chunks of a shard, the
chunks' sizes are summed up in order, and a record's slot is its chunk's start plus its place in the chunk; so no window
spans a shard, and what is summed up in order is a few rows a chunk. Rows that are equal in everything may be many and
fall into one chunk: they are counted first and numbered by explode, not by a window; more than BLOCK_ROWS of them in
blocks, which are dealt to all tasks. Only the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table

SHARDS, CHUNK_ROWS, BLOCK_ROWS, OVERHEAD = 24, 50_000, 10_000, 8


def _draw(key: Column, shard: Column, weight: Column) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, shard), 11)
    return -F.log((bits.cast("double") + 0.5) * F.lit(2.0**-53)) / weight


def rendezvous(key: Column, weights: list[float], first: int = 0) -> Column:
    """struct(draw, shard) of the winning one of the shards first, first + 1, ..."""
    shards = F.array(*[F.struct(F.lit(first + k).cast("int").alias("shard"), F.lit(float(w)).alias("weight")) for k, w in enumerate(weights)])
    return F.array_min(F.transform(shards, lambda s: F.struct(_draw(key, s["shard"], s["weight"]).alias("draw"), s["shard"].alias("shard"))))


def shard(docs: DataFrame, weights: list[float], grown: list[float] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard): grown are the weights of shards added to those of weights."""
    body = F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_column).alias("doc_id"), (F.octet_length(body) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows = rows.withColumn("best", rendezvous(F.col("doc_id"), weights))
    if grown:
        rows = rows.withColumn("best_grown", F.least("best", rendezvous(F.col("doc_id"), grown, len(weights))))
    else:
        rows = rows.withColumn("best_grown", F.col("best"))
    rows = rows.select("doc_id", "size", "text_crc32", F.col("best.shard").alias("shard"), F.col("best_grown.shard").alias("grown_shard"))
    counted = settle(rows.groupBy("doc_id", "size", "text_crc32", "shard", "grown_shard").agg(F.count("*").alias("n")))
    chunks = max(1, -(-counted.count() // (CHUNK_ROWS * len(weights))))
    counted = counted.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(chunks)).cast("int"))
    sizes = counted.groupBy("shard", "chunk").agg(F.sum("n").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("shard", "chunk", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.sum("n").over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1))
    placed = counted.withColumn("inside", F.coalesce(inside, F.lit(0))).join(sizes, ["shard", "chunk"])
    placed = settle(placed.select("doc_id", "size", "text_crc32", "shard", "grown_shard", (F.col("start") + F.col("inside")).alias("from"), "n"), counted)
    own = ["doc_id", "size", "text_crc32", "shard", "grown_shard"]
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    blocks = placed.where(F.col("n") > BLOCK_ROWS).select("*", upto(F.ceil(F.col("n") / BLOCK_ROWS)).alias("block"))
    blocks = blocks.select(*own, (F.col("from") + F.col("block") * BLOCK_ROWS).alias("from"), F.least(F.lit(BLOCK_ROWS).cast("long"), F.col("n") - F.col("block") * BLOCK_ROWS).alias("n"))
    blocks = blocks.repartition(F.xxhash64("from", "shard"))
    every = placed.where(F.col("n") <= BLOCK_ROWS).select(*own, "from", "n").union(blocks)
    out = every.select(*own, "from", upto(F.col("n")).alias("nth"))
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("from") + F.col("nth")).alias("slot"), "grown_shard")


def op7_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0])
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
