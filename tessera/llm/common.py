"""What the operators share: settled tables, views of Arrow text, and hashing of byte spans in numpy."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
U = np.uint64
SLICE_BYTES = 2 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers that start from now on import this package; on a cluster give it with --py-files instead."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join(x for x in [ROOT, *paths] if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only in a local session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        found = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: While a table is settled: shuffle files go with the write; joins hash a side of which no partition has more than 16 MB.
_SETTLING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "16m"}


#: Rows of a small table that a task writes; of any other so many partitions at most, whose hash tables a task keeps to its end.
FILE_ROWS, FILE_PARTS = 1 << 16, 4


def few(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df in no more tasks than its cores and size call for; rows: how many narrow ones it has at most, if that is known.

    A file costs a task, its commit and, on a local file system, several processes that Hadoop starts for its permissions:
    each is for an instant a second copy of the executor in all that counts memory by process.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        return df.coalesce(max(cores, -(-rows // FILE_ROWS)))
    return df.coalesce(max(6 * cores, -(-int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // FILE_PARTS)))


def settle(df: DataFrame, *spent: DataFrame, rows: int | None = None) -> DataFrame:
    """df, written once to the shared folder and read back: lineage is cut, and a lost executor costs no recomputation.

    The shuffle files that writing took are deleted with its end, and so are the tables of spent: settled ones of which
    df was made and that nothing else reads any more. rows as for few.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _SETTLING}
    try:
        for k, v in _SETTLING.items():
            spark.conf.set(k, v)
        few(df, rows).write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    forget(*spent)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def forget(*spent: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more; other DataFrames are left alone."""
    for df in spent:
        path = getattr(df, "_settled", None)
        if path:
            jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(sizes: np.ndarray, most: int):
    """Slices of consecutive rows, each of at most that size in all, or of one row."""
    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (the finaliser of SplitMix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first row, rows, offsets, bytes + 8 zero bytes) of runs of rows with about `limit` bytes; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n, at + 20_000)
        part = data[offsets[at] : offsets[to]]
        yield at, to - at, offsets[at : to + 1] - offsets[at], np.concatenate([part, np.zeros(8, np.uint8)])
        at = to


_BYTES = np.arange(256)
#: Bytes of words: digits, letters and every byte of a character beyond ASCII.
WORD_BYTE = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES | 0x20) >= 0x61) & ((_BYTES | 0x20) <= 0x7A) | (_BYTES >= 0x80)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def run_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values, none of which crosses an offset."""
    if not inside.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.zeros(inside.size, bool)
    before[1:] = inside[:-1]
    cut = offsets[(offsets > 0) & (offsets < inside.size)]
    before[cut] = False
    after = np.zeros(inside.size, bool)
    after[:-1] = inside[1:]
    after[cut - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans of data, which ends in 8 spare bytes."""
    eights = np.ndarray((data.size - 7,), "<u8", data, 0, (1,))
    h = mix(lengths.astype(np.uint64) + U(0x9E3779B97F4A7C15 + seed))
    h = mix(h ^ (eights[starts] & _LOW_BYTES[np.minimum(lengths, 8)]))
    more = np.flatnonzero(lengths > 8)
    done = 8
    while more.size:
        left = np.minimum(lengths[more] - done, 8)
        h[more] = mix((h[more] * U(0x9E3779B97F4A7C15)) ^ (eights[starts[more] + done] & _LOW_BYTES[left]))
        done += 8
        more = more[lengths[more] > done]
    return h


def hashed_words(offsets: np.ndarray, data: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, index of each row's first word and the end, starts, ends) of the words of lower-cased texts.

    A word is a run of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased.
    """
    low = LOWER[data]
    starts, ends = run_spans(WORD_BYTE[data[:-8]], offsets)
    return hash_spans(low, starts, ends - starts, seed), np.searchsorted(starts, offsets), starts, ends


def shingle_sets(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes of each row and the rows' bounds; a row of fewer words has one shingle of all of them."""
    n, count = hashes.size, np.diff(first)
    shingles = np.where(count >= size, count - size + 1, count > 0)
    bounds = np.concatenate([[0], np.cumsum(shingles)])
    out = np.empty(bounds[-1], np.uint64)
    odd = [U((0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64 | 1) for k in range(size)]
    if n >= size:
        h = hashes[: n - size + 1] * odd[0]
        for k in range(1, size):
            h += hashes[k : n - size + 1 + k] * odd[k]
        row = np.repeat(np.arange(count.size), count)[: n - size + 1]
        ok = np.arange(n - size + 1) + size <= first[row + 1]
        out[(bounds[row] + np.arange(n - size + 1) - first[row])[ok]] = mix(h[ok])
    for k in range(1, size):
        rows = np.flatnonzero(count == k)
        if rows.size:
            h = np.full(rows.size, U(k))
            for j in range(k):
                h += hashes[first[rows] + j] * odd[j]
            out[bounds[rows]] = mix(h)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            out[a:b].sort()
    return out, bounds


def bags(sorted_hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, weight, row) of the multisets in sorted rows."""
    if not sorted_hashes.size:
        return sorted_hashes, np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(sorted_hashes.size, bool)
    new[1:] = sorted_hashes[1:] != sorted_hashes[:-1]
    new[bounds[:-1][np.diff(bounds) > 0]] = True
    at = np.flatnonzero(new)
    row = np.repeat(np.arange(bounds.size - 1), np.diff(bounds))
    return sorted_hashes[at], np.diff(np.append(at, sorted_hashes.size)), row[at]


def numbered(sorted_hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The same rows as sets: the k-th repeat of an element becomes an element of its own; rows stay sorted."""
    elements, weights, _ = bags(sorted_hashes, bounds)
    if not weights.size or weights.max() == 1:
        return sorted_hashes
    at = np.concatenate([[0], np.cumsum(weights)[:-1]])
    nth = (np.arange(sorted_hashes.size) - np.repeat(at, weights)).astype(np.uint64)
    out = np.where(nth > 0, mix(sorted_hashes + nth * U(0xD6E8FEB86659FD93)), sorted_hashes)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            out[a:b].sort()
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    if a.size > b.size:
        a, b = b, a
    if not a.size:
        return 0
    at = np.searchsorted(b, a)
    at[at == b.size] = 0
    return int(np.count_nonzero(b[at] == a))
