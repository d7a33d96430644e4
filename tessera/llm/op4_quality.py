"""Text quality by a factorisation machine over hashed words, structure statistics and the text's size.

score = sigmoid(w0 + sum w x + 1/2 sum_f ((sum v_f x)^2 - sum v_f^2 x^2)), in time linear in a text's distinct words.
It is learned from labels.quality of rows whose crc32(doc_id as text) mod 3 is not 1; of more than MAX_TRAIN labels about
that many, chosen by a hash of doc_id, and one text of each doc_id, the smallest; label, language, source and doc_id are no inputs. Every text is read whole. A null text is an empty
one and gets the score of one; a null doc_id has the remainder 0 and is never learned from. A doc_id with several labels
counts as 1 if most of them are. Repeated rows are scored alike. Without any label every score is 0.5. An empty table
gives an empty result. score_quality reads the id and the text alone; keep_good keeps all columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, U, hashed_words, ship, table, text_slices

BUCKETS, RANK, MAX_TRAIN, EPOCHS = 4096, 6, 8000, 12
_BYTES = np.arange(256)
_GROUPS = [
    (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 97) & (_BYTES <= 122), (_BYTES >= 48) & (_BYTES <= 57), _BYTES >= 128, (_BYTES == 32) | (_BYTES == 9), _BYTES == 10,
    np.isin(_BYTES, list(b".,;:")), np.isin(_BYTES, list(b"!?")), np.isin(_BYTES, list(b"#$%&*@^~|<>={}[]\\_+/")), np.isin(_BYTES, list(b"\"'()-")),
]
_GROUP = np.full(256, len(_GROUPS), np.uint8)
for _k, _g in enumerate(_GROUPS):
    _GROUP[_g] = _k
STATS = len(_GROUPS) + 7


def held_out(id_column: Column) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def features(offsets: np.ndarray, data: np.ndarray):
    """(rows' bounds, buckets, values, statistics) of texts; values have the length 1 in each row."""
    rows = offsets.size - 1
    hashes, first, starts, ends = hashed_words(offsets, data)
    words = np.diff(first)
    row = np.repeat(np.arange(rows), words)
    size = np.diff(offsets)
    group = _GROUP[data[:-8]].astype(np.int64)
    group += np.repeat(np.arange(rows) * (len(_GROUPS) + 1), size)
    share = np.bincount(group, minlength=rows * (len(_GROUPS) + 1)).reshape(rows, -1)[:, :-1] / np.maximum(size, 1)[:, None]
    key, count = np.unique((row.astype(np.uint64) << U(40)) | (hashes >> U(24)), return_counts=True)
    own = (key >> U(40)).astype(np.int64)
    distinct = np.bincount(own, minlength=rows)
    most = np.zeros(rows)
    np.maximum.at(most, own, count)
    length = np.bincount(row, ends - starts, minlength=rows) / np.maximum(words, 1)
    low = LOWER[data]
    capital = np.bincount(row, low[starts] != data[starts], minlength=rows) / np.maximum(words, 1)
    again = np.bincount(row[1:][(hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])], minlength=rows) / np.maximum(words, 1)
    stats = np.column_stack([np.sqrt(again), np.sqrt(share), np.log1p(size), np.log1p(words), length, distinct / np.maximum(words, 1), most / np.maximum(words, 1), capital])
    slot = own * BUCKETS + ((key & U((1 << 40) - 1)) % U(BUCKETS)).astype(np.int64)
    bucket, back = np.unique(slot, return_inverse=True)
    value = np.log1p(np.bincount(back.reshape(-1), count, minlength=bucket.size))
    own = bucket // BUCKETS
    bounds = np.searchsorted(own, np.arange(rows + 1))
    norm = np.sqrt(np.bincount(own, value * value, minlength=rows))
    return bounds, (bucket % BUCKETS).astype(np.int32), (value / norm[own]).astype(np.float32), stats.astype(np.float32)


class Machine:
    """A factorisation machine over BUCKETS hashed words and STATS statistics."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = BUCKETS + STATS
        self.bias, self.w, self.v = 0.0, np.zeros(n, np.float32), rng.normal(0, 0.05, (n, RANK)).astype(np.float32)
        self.mean, self.scale = np.zeros(STATS, np.float32), np.ones(STATS, np.float32)

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4).astype(np.float32)

    def fit(self, bounds, buckets, values, stats, label) -> Machine:
        rows = label.size
        self.mean, self.scale = stats.mean(axis=0), stats.std(axis=0) + 1e-4
        stats = self.standard(stats)
        share = np.clip(label.mean(), 0.01, 0.99)
        self.bias = float(np.log(share / (1 - share)))
        theta = [np.array([self.bias], np.float32), self.w, self.v]
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in theta]
        rng, step = np.random.default_rng(11), 0
        for epoch in range(EPOCHS):
            order = rng.permutation(rows)
            for at in range(0, rows, 256):
                use = order[at : at + 256]
                x = np.zeros((use.size, BUCKETS + STATS), np.float32)
                for k, r in enumerate(use):
                    x[k, buckets[bounds[r] : bounds[r + 1]]] = values[bounds[r] : bounds[r + 1]]
                x[:, BUCKETS:] = stats[use]
                s = x @ self.v
                z = theta[0][0] + x @ self.w + 0.5 * (s * s - (x * x) @ (self.v * self.v)).sum(axis=1)
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[use]) / use.size
                grad_v = x.T @ (error[:, None] * s) - ((x * x).T @ error)[:, None] * self.v
                grads = [np.array([error.sum()]), x.T @ error + 1e-4 * self.w, grad_v + 1e-3 * self.v]
                step += 1
                rate = 0.02 * (1 - epoch / EPOCHS)
                for p, g, (m, q) in zip(theta, grads, moments):
                    m += 0.1 * (g - m)
                    q += 0.001 * (g * g - q)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
        self.bias = float(theta[0][0])
        return self

    def score(self, bounds, buckets, values, stats) -> np.ndarray:
        stats = self.standard(stats)
        own = np.repeat(np.arange(bounds.size - 1), np.diff(bounds))
        v, x = self.v[buckets], values[:, None]
        total = lambda y: np.bincount(own, y, minlength=bounds.size - 1)
        linear = self.bias + total(self.w[buckets] * values) + stats @ self.w[BUCKETS:]
        s = np.column_stack([total(c) for c in (v * x).T]) + stats @ self.v[BUCKETS:]
        squares = total(((v * x) ** 2).sum(axis=1)) + (stats * stats) @ (self.v[BUCKETS:] ** 2).sum(axis=1)
        z = linear + 0.5 * ((s * s).sum(axis=1) - squares)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _gathered(batches):
    for batch in batches:
        for at, n, offsets, data in text_slices(batch.column(0)):
            bounds, buckets, values, stats = features(offsets, data)
            cut = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(at, n), pa.array([buckets[a:b].astype(np.uint16).tobytes() for a, b in cut], pa.binary()), pa.array([values[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([s.tobytes() for s in stats], pa.binary())],
                ["label", "buckets", "values", "stats"],
            )


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Machine | None:
    """The machine of about MAX_TRAIN labelled rows that are not held out; their features alone reach the driver.

    A threshold on a hash chooses them, so no task sorts all labels; what is broadcast has about MAX_TRAIN rows.
    """
    ship(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    share = min(1.0, MAX_TRAIN / max(1, known.select("doc_id").distinct().count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    known = known.groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("label"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("x")).select("x.text", "x.label")
    rows = rows.mapInArrow(_gathered, "label int, buckets binary, values binary, stats binary").collect()
    if not rows:
        return None
    rows = sorted(rows, key=lambda r: (bytes(r["stats"]), r["label"]))  # whatever the order in which they came
    buckets = [np.frombuffer(r["buckets"], np.uint16) for r in rows]
    bounds = np.concatenate([[0], np.cumsum([b.size for b in buckets])])
    values = np.concatenate([np.frombuffer(r["values"], np.float32) for r in rows])
    stats = np.stack([np.frombuffer(r["stats"], np.float32) for r in rows])
    return Machine().fit(bounds, np.concatenate(buckets), values, stats, np.array([r["label"] for r in rows], np.float32))


def _scored(machine: Machine | None, column: int):
    def run(batches):
        for batch in batches:
            scores = []
            for _, n, offsets, data in text_slices(batch.column(column)):
                scores.append(machine.score(*features(offsets, data)) if machine else np.full(n, 0.5))
            keep = [c for k, c in enumerate(batch.columns) if k != column]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], [*(x for k, x in enumerate(batch.schema.names) if k != column), "score"])

    return run


def score_quality(docs: DataFrame, machine: Machine | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.mapInArrow(_scored(machine, 1), f"doc_id {kind}, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _accepted(machine: Machine | None, column: int):
    def run(batches):
        for batch in batches:
            scores = [machine.score(*features(o, d)) if machine else np.full(n, 0.5) for _, n, o, d in text_slices(batch.column(column))]
            yield batch.filter(pa.array(np.concatenate(scores) >= 0.5)) if scores else batch

    return run


def keep_good(docs: DataFrame, machine: Machine | None, text_column: str = "text") -> DataFrame:
    """The rows of docs that the machine does not reject, with all their columns."""
    ship(docs.sparkSession)
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    kept = plain.mapInArrow(_accepted(machine, names.index(text_column)), plain.schema)
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])


def op4_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, learn(docs, table(spark, sf_dir, "labels")))
