"""Language identification by multinomial naive Bayes over hashed character n-grams.

The n-grams are the runs of 1, 2 and 3 characters of the lower-cased text, with every run of characters that are no
letters as one blank; a blank alone is none. Counts come from text and lang of rows whose crc32(doc_id as text) mod 3 is
not 1 and whose lang and text are not null; of more than MAX_TRAIN about that many, chosen by a hash of doc_id; lang,
source and doc_id are no inputs. Each text is read whole. `score` is the posterior probability of the answer. Null texts and texts
without a letter are `und` with the score 0, and so is every text if there is nothing to learn from. A null doc_id has
the remainder 0 and is never learned from. Repeated rows are answered alike; ties go to the language first in order.
An empty table gives an empty result. Only the named columns are read, so others may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _kinds
from .common import U, mix, ship, table
from .op4_quality import held_out

BUCKETS, MAX_TRAIN, SMOOTHING, SLICE = 1 << 15, 20_000, 0.5, 1 << 19
_letter: list[np.ndarray] = []


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row, has a letter) of all n-grams of the texts."""
    if not _letter:
        _letter.append(_kinds() == 1)
    own = [" " + t.lower() + " " for t in texts]
    points = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(own)), [len(t) for t in own])
    letter = _letter[0][points]
    blank = ~letter
    keep = letter.copy()
    keep[1:] |= ~blank[:-1] | (row[1:] != row[:-1])  # the first blank of a run, and one at each end
    keep[:1] = True
    points, row, letter = np.where(letter, points, 32)[keep].astype(np.uint64), row[keep], letter[keep]
    has = np.bincount(row[letter], minlength=len(texts)) > 0
    one = mix(points + U(0x51ED27))
    out, rows = [(one % U(BUCKETS))[letter]], [row[letter]]
    h = points
    for n in (2, 3):
        h = h[: max(0, points.size - n + 1)] * U(0x110001) + points[n - 1 :]
        same = row[: h.size] == row[n - 1 :]
        if n == 2:
            same &= letter[: h.size] | letter[1:]
        out.append((mix(h + U(n * 0x9E3779B97F4A7C15 % 2**64)) % U(BUCKETS))[same])
        rows.append(row[: h.size][same])
    return np.concatenate(out).astype(np.int64), np.concatenate(rows), has


def _text_runs(column: pa.Array):
    texts, size, at = [], 0, 0
    for value in column:
        texts.append(value.as_py() or "")
        size += len(texts[-1])
        if size >= SLICE or len(texts) >= 20_000:
            yield at, texts
            at, texts, size = at + len(texts), [], 0
    if texts:
        yield at, texts


def _counted(batches):
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for at, texts in _text_runs(batch.column(1)):
            bucket, row, _ = grams(texts)
            langs = batch.column(0).slice(at, len(texts)).to_pylist()
            for lang in set(langs):
                own = np.array([x == lang for x in langs])
                counts.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                counts[lang] += np.bincount(bucket[own[row]], minlength=BUCKETS + 1)
                counts[lang][BUCKETS] += np.count_nonzero(own)
    for lang, count in counts.items():
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * at.size, pa.string()), pa.array(at, pa.int32()), pa.array(count[at], pa.int64())], ["lang", "bucket", "n"])


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, their log probabilities by bucket, priors last): as many columns as languages, BUCKETS + 1 rows.

    Which rows are learned from is a threshold on a hash, so no task sorts or gathers them; a repeated doc_id brings all
    of its rows, which are only counted.
    """
    ship(docs.sparkSession)
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    share = min(1.0, MAX_TRAIN / max(1, known.count()))
    rows = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    counts = rows.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in counts})
    place = {x: k for k, x in enumerate(langs)}
    table = np.zeros((BUCKETS + 1, len(langs)))
    for r in counts:
        table[r["bucket"], place[r["lang"]]] += r["n"]
    if not langs:
        return [], table
    grams_, prior = table[:BUCKETS] + SMOOTHING, table[BUCKETS] + 1.0
    return langs, np.vstack([np.log(grams_ / grams_.sum(axis=0)), np.log(prior / prior.sum())])


def _answered(langs, logs):
    def run(batches):
        table = np.ascontiguousarray(logs.value.T) if langs else None
        for batch in batches:
            names, scores = [], []
            for _, texts in _text_runs(batch.column(1)):
                if not langs:
                    names, scores = names + ["und"] * len(texts), scores + [0.0] * len(texts)
                    continue
                bucket, row, has = grams(texts)
                key, count = np.unique(row * BUCKETS + bucket, return_counts=True)
                row, bucket = key // BUCKETS, key % BUCKETS
                total = np.column_stack([np.bincount(row, count * t[bucket], minlength=len(texts)) + t[BUCKETS] for t in table])
                best = total.argmax(axis=1)
                odds = 1 / np.exp(total - total.max(axis=1)[:, None]).sum(axis=1)
                names += [langs[k] if h else "und" for k, h in zip(best.tolist(), has.tolist())]
                scores += np.where(has, odds, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, langs: list[str], logs: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; what is broadcast has BUCKETS + 1 numbers for each language."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(_answered(langs, docs.sparkSession.sparkContext.broadcast(logs)), f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, *learn(docs))
