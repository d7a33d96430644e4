"""Near-duplicate documents by BagMinHash: signatures of weighted shingle sets, bands, and exact verification.

A document's shingles are its runs of five words (op8's words), with their counts; one of fewer words has one shingle.
Two documents are near duplicates if their multisets' Jaccard similarity is 0.8 or more; classes are the connected
components of that relation. Texts without a word, null and empty ones among them, have no shingles and are near
duplicates only of equal texts (null equals empty). Rows of one doc_id are documents of their own, null ids too.
Of a class the row with the smallest doc_id stays, null ids last; between rows of one doc_id, the first written.
Whole texts are compared, however long. An empty table gives an empty result. near_duplicates reads the id and the text
alone; drop_near_duplicates keeps all other columns, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash
from .common import bags, hashed_words, numbered, overlap, settle, shingle_sets, ship, table, text_slices
from .components import bucket_pairs, completed

WORDS, SIMILARITY = 5, 0.8
#: 32 bands of 6 places find a pair of similarity 0.8 with a probability of 0.99994, one of 0.4 with 0.12.
BANDS, ROWS = 32, 6
NO_ID = -(2**63)


def _digests(hashes, first, data, offsets) -> list[bytes]:
    """Of each row's words; of its bytes, and marked so, if it has none."""
    out = []
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        own = hashes[a:b].tobytes() if b > a else b"raw" + data[offsets[k] : offsets[k + 1]].tobytes()
        out.append(hashlib.blake2b(own, digest_size=16, person=b"words" if b > a else b"bytes").digest())
    return out


def _sign(batches):
    seen: set[bytes] = set()
    for batch in batches:
        for at, n, offsets, data in text_slices(batch.column(1)):
            hashes, first, _, _ = hashed_words(offsets, data)
            digests = _digests(hashes, first, data, offsets)
            new = []
            for k, d in enumerate(digests):
                if d not in seen:
                    new.append(k)
                    if len(seen) < 200_000:
                        seen.add(d)
            sorted_hashes, bounds = shingle_sets(hashes, first, WORDS)
            element, weight, row = bags(sorted_hashes, bounds)
            want = np.zeros(n, bool)
            want[new] = True
            use = want[row]
            keys = bagminhash.bands(bagminhash.signatures(element[use], weight[use], row[use], n, BANDS * ROWS), ROWS)
            count = np.diff(bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, n), batch.column(2).slice(at, n), pa.array(digests, pa.binary()), pa.array(count, pa.int64()), pa.array([keys[k] if want[k] and count[k] else None for k in range(n)], pa.list_(pa.int64()))],
                ["doc_id", "md5", "digest", "n", "bands"],
            )


def _shingled(batches):
    for batch in batches:
        for at, n, offsets, data in text_slices(batch.column(1)):
            hashes, first, _, _ = hashed_words(offsets, data)
            sorted_hashes, bounds = shingle_sets(hashes, first, WORDS)
            sets = numbered(sorted_hashes, bounds)
            uid, digest = batch.column(0).slice(at, n), batch.column(2).slice(at, n).to_pylist()
            own = _digests(hashes, first, data, offsets)
            yield pa.RecordBatch.from_arrays(
                [uid, pa.array([sets[a:b].tobytes() if x == y else None for a, b, x, y in zip(bounds[:-1], bounds[1:], own, digest)], pa.binary())],
                ["uid", "shingles"],
            )


def similar(similarity: float):
    """For mapInArrow: of (a, b, x, y) the pairs (a, b) whose sets x and y have at least that Jaccard similarity."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = overlap(x, y)
                keep.append(both >= similarity * (x.size + y.size - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], ["a", "b"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """pairs (a, b) whose sets, by uid, are similar; the sets meet pair by pair, never group by group."""
    left = pairs.join(sets.select(F.col("uid").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("uid").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(similar(similarity), "a long, b long")


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("uid")).union(pairs.select(F.col("b").alias("uid"))).distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(uid, doc_id, class_uid, keeper, n_shingles) of every row: the row of number keeper stays of each class."""
    ship(docs.sparkSession)
    ids = F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID))
    text = F.col(text_column).cast("string")
    signed = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"), _md5(text).alias("md5"))
    signed = signed.mapInArrow(_sign, "doc_id long, md5 string, digest binary, n long, bands array<long>")
    signed = settle(signed.withColumn("uid", F.monotonically_increasing_id()))
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("uid"), F.col("md5"))
    same = signed.groupBy("digest").agg(F.min(own).alias("first"), F.max("n").alias("n"), F.count("*").alias("copies"), F.max("bands").alias("bands"))
    same = settle(same.select("digest", "first.doc_id", "first.uid", "first.md5", "n", "copies", "bands"))
    pairs, members = bucket_pairs(same.where("bands IS NOT NULL").select("uid", "n", "copies", F.col("bands").alias("keys")))

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(uid, shingles); one row of each digest meets the rows of its own id and text, so repeated ids bring no others."""
        wanted = same.join(wanted, "uid").select("uid", "digest", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "md5")
        texts = docs.select(ids.alias("id"), text.alias("text"), _md5(text).alias("md5")).join(wanted, ["id", "md5"])
        found = texts.select("uid", "text", "digest").mapInArrow(_shingled, "uid long, shingles binary").where("shingles IS NOT NULL")
        return settle(found.dropDuplicates(["uid"]))

    def verify(some: DataFrame) -> DataFrame:
        sets = sets_of(ends_of(some))
        return settle(verified(some, sets, similarity), sets)

    def rows_of(inside: DataFrame) -> DataFrame:
        sets = sets_of(inside.select("uid").distinct())
        return settle(inside.join(sets, "uid"), sets)

    parts = completed(pairs, verify(pairs), members, similarity, similarity, rows_of, verify)
    classes = same.join(parts.withColumnRenamed("node", "uid"), "uid", "left").select("digest", F.coalesce("component", "uid").alias("class_uid"))
    rows = settle(signed.select("uid", "doc_id", "md5", "digest", "n").join(classes, "digest"), signed, same, parts)
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("uid"))
    first = rows.groupBy("class_uid").agg(F.min(own).alias("first"), F.count("*").alias("class_size"))
    first = settle(first.select("class_uid", F.col("first.uid").alias("keeper"), F.col("first.doc_id").alias("class_id"), "class_size"))
    return rows.join(first, "class_uid").select("uid", "doc_id", "md5", "class_uid", "keeper", "class_id", "class_size", F.col("n").alias("n_shingles"))


def _md5(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def op1_bagminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: doc_id, class_id (its class's smallest doc_id), class_size, n_shingles, kept."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", "n_shingles", (F.col("uid") == F.col("keeper")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with one row of each class and all its columns; rows of one id and one text count as one."""
    key = [F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("_id"), _md5(F.col(text_column).cast("string")).alias("_md5")]
    found = near_duplicates(docs.select(key[0], F.col(text_column).cast("string").alias("text")), "_id", "text")
    kept = found.where("uid = keeper").select(F.col("doc_id").alias("_id"), "md5").groupBy("_id", F.col("md5").alias("_md5")).agg(F.count("*").alias("_kept"))
    rows = found.groupBy(F.col("doc_id").alias("_id"), F.col("md5").alias("_md5")).agg(F.count("*").alias("_rows"))
    kept = settle(kept.join(rows, ["_id", "_md5"]))
    whole = docs.select(*key, *[F.col(f"`{c}`") for c in docs.columns]).join(kept, ["_id", "_md5"])
    out = whole.where("_rows = 1")
    if not kept.where("_rows > 1").isEmpty():
        out = out.union(whole.where("_rows > 1").dropDuplicates(["_id", "_md5"]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
