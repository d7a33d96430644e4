"""Exact duplicates by composable polynomial fingerprints, confirmed by comparing chunk with chunk.

Texts are equal if they are identical after each run of white space ([\\x20\\x09-\\x0D]+) becomes one space; null counts
as empty. Of equal texts the row with the smallest doc_id stays (null ids come last; of rows of one id, the first
written). Repeated rows are rows of their own. An empty table gives an empty result. Only the id and the text are read,
so other columns may have any names.

A text's bytes are cut into chunks; each chunk's polynomial hash is taken modulo two primes, and the chunks' hashes
combine as hash(A + B) = hash(A) * r^len(B) + hash(B), so chunks may be hashed in any order, on any machine. Texts of more
than HUGE characters become rows of HUGE characters, which all tasks hash in parallel; an aggregate joins their hashes,
and where white space meets at a seam takes one of the two spaces away again. Rows whose fingerprint and length agree
are compared with the group's first row chunk by chunk: the join is on (first row, chunk, salt), where a group has a salt
for every SALT_ROWS rows, so no task holds a group, all copies of a chunk, or a whole text. Rows that differ in spite of
an equal fingerprint form groups of their own.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, ship, table

CHUNK, HUGE, SALT_ROWS = 1 << 16, 1 << 22, 500
PRIMES, BASES = (2147483647, 2147483629), (1103515245, 1220703125)
_WHITE = re.compile(rb"[\x09-\x0d][\x20\x09-\x0d]*|\x20[\x20\x09-\x0d]+")
_BLOCK = 4096


def normalised(text: bytes) -> bytes:
    return _WHITE.sub(b" ", text)


class Fingerprint:
    """Hashes of byte strings modulo the primes, and of their concatenation."""

    def __init__(self, primes=PRIMES, bases=BASES):
        self.primes, self.bases = primes, bases
        self.powers = []
        for p, r in zip(primes, bases):
            row = np.empty(_BLOCK, np.uint64)
            x = 1
            for k in range(_BLOCK - 1, -1, -1):
                row[k] = x
                x = x * r % p
            self.powers.append(row)

    def of(self, data: bytes) -> tuple[int, ...]:
        """Of one chunk; blocks of 4096 bytes are hashed together and combined."""
        raw = np.frombuffer(data, np.uint8)
        head = raw.size % _BLOCK
        out = []
        for p, r, powers in zip(self.primes, self.bases, self.powers):
            h = int((raw[:head].astype(np.uint64) @ powers[_BLOCK - head :]) % p) if head else 0
            if raw.size > head:
                step = pow(r, _BLOCK, p)
                for block in ((raw[head:].reshape(-1, _BLOCK).astype(np.uint64) * powers).sum(axis=1) % p).tolist():
                    h = (h * step + block) % p
            out.append(h)
        return tuple(out)

    def joined(self, left: tuple[int, ...], right: tuple[int, ...], right_length: int) -> tuple[int, ...]:
        return tuple((a * pow(r, right_length, p) + b) % p for a, b, p, r in zip(left, right, self.primes, self.bases))

    def whole(self, data: bytes) -> tuple[int, ...]:
        out = tuple(0 for _ in self.primes)
        for at in range(0, len(data), CHUNK):
            part = data[at : at + CHUNK]
            out = self.joined(out, self.of(part), len(part))
        return out


def _digest(primes, bases):
    def run(batches):
        fingerprint = Fingerprint(primes, bases)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                data = normalised(text.as_buffer().to_pybytes() if text.is_valid else b"")
                first, second = fingerprint.whole(data)
                rows.append((first, second, len(data), hashlib.sha256(data).hexdigest()))
            first, second, size, sha = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(size, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "f1", "f2", "size", "sha"])

    return run


def _piece_hashes(primes, bases):
    """(text_no, nth, size, head, tail, and for each prime hash f, power p = r^size, power q = r^(size - 1)) of pieces."""

    def run(batches):
        fingerprint = Fingerprint(primes, bases)
        for batch in batches:
            rows = []
            for text_no, nth, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = normalised(piece.as_buffer().to_pybytes())
                powers = [x for h, p, r in zip(fingerprint.whole(data), primes, bases) for x in (h, pow(r, len(data), p), pow(r, len(data) - 1, p))]
                rows.append((text_no, nth, len(data), data[:1] == b" ", data[-1:] == b" ", *powers))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 11, kinds)], ["text_no", "nth", "size", "head", "tail", "f1", "p1", "q1", "f2", "p2", "q2"])

    return run


def _sha(batches):
    for batch in batches:
        sha = [hashlib.sha256(normalised(x.as_buffer().to_pybytes())).hexdigest() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sha, pa.string())], ["text_no", "sha"])


def _joined(primes):
    """Folds a text's sorted pieces into (f1, f2, size): each step appends a piece, without its first space at a seam of two."""
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("f1", "f2", "size")], F.lit(False).alias("tail"))

    def step(a, x):
        seam = (a["tail"] & x["head"]).cast("long")
        out = []
        for k, p in zip("12", primes):
            power = F.when(seam == 1, x[f"q{k}"]).otherwise(x[f"p{k}"])
            out.append(F.pmod(a[f"f{k}"] * power + x[f"f{k}"] - seam * ((F.lit(32) * x[f"q{k}"]) % F.lit(p)), F.lit(p)).alias(f"f{k}"))
        return F.struct(*out, (a["size"] + x["size"] - seam).alias("size"), x["tail"].alias("tail"))

    return F.aggregate("pieces", zero, step)


def _huge_digests(huge: DataFrame, primes, bases) -> DataFrame:
    """(doc_id, f1, f2, size, sha) of texts that are hashed piece by piece."""
    rows = settle(huge.withColumn("text_no", F.monotonically_increasing_id()))
    pieces = rows.select("text_no", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.length("text") - 1) / HUGE))).alias("nth"), "text")
    pieces = pieces.select("text_no", "nth", F.substring("text", (F.col("nth") * HUGE + 1).cast("int"), F.lit(HUGE)).alias("piece")).repartition("text_no", "nth")
    kinds = "text_no long, nth long, size long, head boolean, tail boolean, f1 long, p1 long, q1 long, f2 long, p2 long, q2 long"
    hashed = pieces.mapInArrow(_piece_hashes(primes, bases), kinds)
    each = F.struct("nth", *[c for c in hashed.columns if c not in ("text_no", "nth")])
    joined = hashed.groupBy("text_no").agg(F.array_sort(F.collect_list(each)).alias("pieces")).select("text_no", _joined(primes).alias("x"))
    sha = rows.select("text_no", "text").mapInArrow(_sha, "text_no long, sha string")
    return rows.select("doc_id", "text_no").join(joined, "text_no").join(sha, "text_no").select("doc_id", "x.f1", "x.f2", "x.size", "sha")


def _chunks(batches):
    """(uid, lead, nth, salt, chunk) of the rows (uid, lead, salts, text); the lead has its chunks under every salt."""
    for batch in batches:
        out, size = [], 0
        for uid, lead, salts, text in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
            data = normalised(text.as_buffer().to_pybytes() if text.is_valid else b"")
            own = range(salts) if uid == lead else (uid % salts,)
            for nth, at in enumerate(range(0, max(len(data), 1), CHUNK)):
                for salt in own:
                    out.append((uid, lead, nth, salt, data[at : at + CHUNK]))
                    size += len(out[-1][-1])
                    if size > 1 << 22:
                        yield _chunk_batch(out)
                        out, size = [], 0
        if out:
            yield _chunk_batch(out)


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["uid", "lead", "nth", "salt", "chunk"])


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", primes=PRIMES, bases=BASES) -> DataFrame:
    """(uid, doc_id, lead, f1, f2, size, sha) of every row; rows of one lead have equal texts.

    The row's text travels with the digests of its task until it is known whether another row has its fingerprint.
    """
    ship(docs.sparkSession)
    text = F.col(text_column).cast("string")
    rows = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    long_ = F.coalesce(F.length("text"), F.lit(0)) > HUGE
    digest = rows.where(~long_).mapInArrow(_digest(primes, bases), f"doc_id {kind}, f1 long, f2 long, size long, sha string")
    digest = digest.union(_huge_digests(rows.where(long_), primes, bases))
    digest = settle(digest.withColumn("uid", F.monotonically_increasing_id()))
    groups = digest.groupBy("f1", "f2", "size").agg(F.min("uid").alias("lead"), F.count("*").alias("n"))
    member = settle(digest.join(groups, ["f1", "f2", "size"]).select("uid", "doc_id", "f1", "f2", "size", "sha", "lead", "n"), digest)
    open_rows = member.where("n > 1")
    if open_rows.isEmpty():
        return member.drop("n")
    # The texts of rows that share a fingerprint, by (doc_id, sha): rows of one doc_id and sha are one text.
    wanted = open_rows.groupBy(F.col("doc_id").alias("id"), "sha").agg(F.min("uid").alias("text_uid"))
    none = F.lit("")
    plain = F.regexp_replace(F.coalesce(F.col("text"), none), "[\\x20\\x09-\\x0D]+", " ")
    texts = rows.join(wanted.select(F.col("id").alias("_i")).distinct(), F.col("doc_id").eqNullSafe(F.col("_i")), "left_semi")
    texts = texts.select(F.col("doc_id").alias("id"), F.sha2(plain.cast("binary"), 256).alias("sha"), "text")
    texts = texts.join(wanted.withColumnRenamed("id", "_i").withColumnRenamed("sha", "_s"), F.col("id").eqNullSafe(F.col("_i")) & (F.col("sha") == F.col("_s"))).select("text_uid", "text")
    texts = settle(texts.dropDuplicates(["text_uid"]))
    ids = open_rows.select("uid", "lead", "doc_id", "sha")
    sources = ids.join(wanted.withColumnRenamed("sha", "_s"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("_s"))).select("uid", "lead", "text_uid")
    sources = settle(sources)
    salts = F.ceil(F.col("members") / SALT_ROWS).alias("salts")
    settled = member.where("n = 1").drop("n")
    while True:
        sizes = sources.groupBy("lead").agg(F.count("*").alias("members")).select("lead", salts)
        chunks = sources.select("text_uid", "uid", "lead").join(sizes, "lead").join(texts, "text_uid").select("uid", "lead", "salts", "text")
        chunks = chunks.mapInArrow(_chunks, "uid long, lead long, nth int, salt long, chunk binary")
        first = chunks.where("uid = lead").select("lead", "nth", "salt", F.col("chunk").alias("other"))
        differ = settle(chunks.where("uid != lead").join(first, ["lead", "nth", "salt"]).where("chunk != other").select("uid").distinct())
        if differ.isEmpty():
            return settled.union(open_rows.select(settled.columns))
        settled = settle(settled.union(open_rows.join(differ, "uid", "left_anti").select(settled.columns)))
        apart = settle(open_rows.join(differ, "uid"))
        lead = apart.groupBy("lead").agg(F.min("uid").alias("next"))
        open_rows = settle(apart.join(lead, "lead").select("uid", "doc_id", "f1", "f2", "size", "sha", F.col("next").alias("lead")))
        sources = settle(sources.drop("lead").join(open_rows.select("uid", "lead"), "uid"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = settle(exact_groups(table(spark, sf_dir, "documents")))
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("uid"))
    first = rows.groupBy("lead").agg(F.min(own).alias("first"), F.count("*").alias("group_size"))
    out = rows.join(settle(first), "lead")
    return out.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("first.uid")).alias("kept"), F.col("sha").alias("text_sha256"))


OP5_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, CAST(count(*) OVER (PARTITION BY norm) AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
