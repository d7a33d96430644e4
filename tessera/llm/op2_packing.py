"""Packing of tokenised documents into sequences of at most 1024 tokens: bulk-synchronous best fit, longest first.

A document is its byte-level BPE ids and the id 2; a null text is an empty one, so every row has one token at least.
One of more than 1024 tokens is cut into pieces of 1024, of which the first may be shorter. Rows are packed one by one,
whatever their ids: repeated ids, null ids and equal texts are all packed. An empty table gives an empty result. Only
the id and the text are read, so other columns may have any names.

How it scales. In a superstep the pieces are dealt to tasks by a hash of their place in the input, about SHARD_PIECES to
a task. Each task sorts its own by length and sweeps: all pieces of one length, longest first, go to the successor among
the gaps (the least room that holds the length); which piece gets which of the gap's sequences is resolved by rank; the
gaps are updated, and so on until no piece is left. Pieces and gaps are kept run-length coded in the sweep, as counts by
length and runs of sequences by room. Between supersteps the sequences that a task could not fill are opened again, and
their pieces are dealt anew to fewer tasks, until one task has them all or a superstep would deal to as many tasks as the
last. No text and no piece passes through the driver; no task holds more than its share.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ids_of, tokenizer_path
from .common import settle, ship, table

ROOM, END = 1024, 2
SHARD_PIECES = 1 << 16
#: A sequence that is filled less than this is opened again in the next superstep.
FULL = 0.97


def pieces_of(total: int, room: int = ROOM) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones at the end, the shorter one first."""
    head = total % room
    out = [(0, head)] if head else []
    return out + [(k, room) for k in range(head, total, room)]


def _cut(path: str, room: int, end: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:

            for at, docs in ids_of(path, batch.column(1)):
                take, cols = [], []
                for k, ids in enumerate(docs):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    for j, (start, length) in enumerate(pieces_of(ids.size, room)):
                        rank = seen.get(length, 0)
                        seen[length] = rank + 1
                        take.append(at + k)
                        cols.append((j, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, rank))
                rows = list(zip(*cols))
                kinds = [pa.int32()] + [pa.int64()] * 5
                yield pa.RecordBatch.from_arrays([pc.take(batch.column(0), pa.array(take, pa.int64())), *(pa.array(c, t) for c, t in zip(rows, kinds))], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return run


def best_fit(counts: dict[int, int], room: int = ROOM) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, pieces to a sequence, offset) of every placement.

    counts: pieces of each length. gaps: for each room left the runs [first, end) of sequence numbers that have it.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    out, fresh = [], 0
    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            fit = min((g for g in gaps if g >= length), default=None)
            if fit is None:  # new sequences, as many as the pieces that are left can fill
                each = room // length
                fit, runs = room, [(fresh, fresh + -(-left // each))]
                fresh = runs[0][1]
            else:
                runs = gaps.pop(fit)
            each = fit // length
            while runs and left:
                first, end = runs.pop(0)
                full = min(end - first, left // each)
                if full:
                    out.append((length, rank, full * each, first, each, room - fit))
                    gaps.setdefault(fit - each * length, []).append((first, first + full)) if fit > each * length else None
                    rank, left, first = rank + full * each, left - full * each, first + full
                if left and first < end:  # fewer pieces than one sequence would hold
                    out.append((length, rank, left, first, left, room - fit))
                    gaps.setdefault(fit - left * length, []).append((first, first + 1)) if fit > left * length else None
                    rank, left, first = rank + left, 0, first + 1
                if first < end:
                    runs.insert(0, (first, end))
            if runs:
                gaps.setdefault(fit, []).extend(runs)
    return out


def placed(lengths: np.ndarray, room: int = ROOM) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces of these lengths; among pieces of one length their order is their rank."""
    order = np.argsort(lengths, kind="stable")
    own, counts = np.unique(lengths, return_counts=True)
    plan = np.array(sorted(best_fit(dict(zip(own.tolist(), counts.tolist())), room)), np.int64).reshape(-1, 6)
    _, _, n, first, each, offset = plan.T  # by length, then by rank: in the order of `order`
    at = np.repeat(np.arange(n.size), n)
    within = np.arange(lengths.size) - np.repeat(np.cumsum(n) - n, n)
    sequence, place = np.empty(lengths.size, np.int64), np.empty(lengths.size, np.int64)
    sequence[order] = first[at] + within // each[at]
    place[order] = offset[at] + within % each[at] * lengths[order]
    return sequence, place


def _swept(room: int, step: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("part", "ascending"), ("length", "ascending"), ("nth", "ascending")])  # whatever the order in which rows came
        lengths, shard = rows["length"].to_numpy(), rows["shard"][0].as_py()
        sequence, offset = placed(lengths, room)
        fill = np.bincount(sequence, lengths).astype(np.int64)[sequence]
        keep = rows.drop_columns(["shard"])
        return keep.append_column("sequence_id", pa.array(sequence + (step << 56) + (shard << 32))).append_column("offset", pa.array(offset)).append_column("fill", pa.array(fill))

    return run


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", room: int = ROOM, end: int = END, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    ship(docs.sparkSession)
    kept = f"doc_id {docs.schema[id_column].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    cut = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    left = settle(cut.mapInArrow(_cut(tokenizer or tokenizer_path(), room, end), f"{kept}, part long, nth long"))
    columns, out = left.columns, None
    shards, step = -(-left.count() // SHARD_PIECES), 0
    while shards:
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("part", "length", "nth", F.lit(step)), F.lit(shards)).cast("int"))
        found = settle(dealt.groupBy("shard").applyInArrow(_swept(room, step), f"{kept}, part long, nth long, sequence_id long, offset long, fill long"), left)
        again = found.where(F.col("fill") < int(room * FULL))
        fewer = -(-again.count() // SHARD_PIECES) if shards > 1 else 0
        open_ = 0 < fewer < shards
        done = (found.where(F.col("fill") >= int(room * FULL)) if open_ else found).drop("part", "nth", "fill")
        out = done if out is None else out.union(done)
        left, shards, step = again.select(columns), fewer if open_ else 0, step + 1
    return out if out is not None else docs.sparkSession.createDataFrame([], f"{kept}, sequence_id long, offset long")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
