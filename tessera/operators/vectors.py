"""Similarity of vectors, block by block: all pairs of queries and rows, as many rows out as pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workers import ship

#: Vectors in a block of queries and in one of rows; a task holds one pair of blocks at a time.
QUERY_BLOCK, ROW_BLOCK = 256, 1024
_BLOCK = "n int, size int, ids binary, vectors binary"
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])


def blocks(df: DataFrame, key: str, vector: str, most: int) -> DataFrame:
    """(n, size, ids, vectors) of up to `most` rows of df with one number of components; -1 components: null, or with a null inside."""
    ship()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            if lists.flatten().null_count:
                sizes[[k for k, x in enumerate(lists.to_pylist()) if x is not None and None in x]] = -1
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                values = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(at.size, size) if size > 0 else np.zeros((at.size, 0))
                out = [(min(most, at.size - k), size, ids[at[k : k + most]].tobytes(), values[k : k + most].astype(np.float64).tobytes()) for k in range(0, at.size, most)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["n", "size", "ids", "vectors"])

    own = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL")
    return own.mapInArrow(run, _BLOCK)


def cosines(queries: DataFrame, rows: DataFrame, key: str, vector: str, digits: int) -> DataFrame:
    """(a, b, similarity) of every query a and every row b of another key: the cosine, rounded, halves away from zero.

    Null where a vector is null, holds a null or has another number of components; NaN for a vector of zeros.
    """
    spark, scale = rows.sparkSession, 10.0**digits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a, b = np.frombuffer(r["a_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                found = np.full((a.size, b.size), np.nan)
                known = r["a_size"] == r["size"] >= 0
                if known:
                    x, y = (np.frombuffer(r[c], np.float64).reshape(n, r["size"]) for c, n in (("a_vectors", a.size), ("vectors", b.size)))
                    with np.errstate(divide="ignore", invalid="ignore"):
                        found = np.clip((x @ y.T) / np.sqrt(np.outer((x * x).sum(1), (y * y).sum(1))), -1, 1) * scale
                    found = np.copysign(np.floor(np.abs(found) + 0.5), found) / scale
                at = a[:, None] != b[None, :]
                left, right = np.broadcast_to(a[:, None], at.shape)[at], np.broadcast_to(b[None, :], at.shape)[at]
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(found[at]) if known else pa.nulls(left.size, pa.float64())], schema=_PAIRS)

    asked = blocks(queries, key, vector, QUERY_BLOCK)
    asked = asked.select(*[F.col(c).alias(f"a_{c}") for c in asked.columns])
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = blocks(rows, key, vector, ROW_BLOCK).repartition(tasks).crossJoin(asked)  # of blocks
    return met.mapInArrow(run, "a long, b long, similarity double")
