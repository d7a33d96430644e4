"""Benchmark decontamination: an FM-index over the words of each training shard, searched with the benchmark's windows.

Words are runs of digits, letters and characters beyond ASCII; A-Z are lower-cased. A window is 10 consecutive words of
an item; an item of fewer words, but not none, is one window. Words of a document inside any occurrence are hit. Null
and empty texts have no words; repeated rows are documents of their own; items of one text are all named. An empty
benchmark hits nothing, an empty table gives an empty result. The windows of an item without an id hit words as others
do, but the item is neither named nor counted among a document's items. contamination reads the id and the text alone;
without_benchmark keeps all other columns, whatever their names.

A task gathers documents into shards of about half a million words; a longer document is a shard of its own, and no
document is split. A shard's words become numbers, with a separator of its own after each document, its suffixes are
sorted by prefix doubling (only those that still tie are sorted again), the words before them are held in a wavelet
tree, and every eighth position of the text is sampled. Nothing but the benchmark is sent to the executors, in blocks of
bounded size: a shard's index is built once and searched with each block in turn, of which a task holds one at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_words, settle, ship, table, text_slices

WINDOW, SHARD_WORDS, SAMPLE = 10, 500_000, 8
#: Windows that are sent to the executors at a time: 80 bytes each.
BLOCK_WINDOWS = 200_000


class WaveletTree:
    """Ranks and values of a sequence of numbers below size, by one level of bits for each binary digit."""

    def __init__(self, values: np.ndarray, size: int):
        self.n, self.levels = values.size, max(1, int(size - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, value: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each value stands before place upto."""
        lo, hi = np.zeros(value.size, np.int64), upto.astype(np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (value >> (self.levels - 1 - k)) & 1
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return hi - lo

    def at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value at each place, how often it stands before it)."""
        here, lo, value = place.astype(np.int64), np.zeros(place.size, np.int64), np.zeros(place.size, np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[here + 1] - ones[here]
            a, b = ones[lo], ones[here]
            lo, here = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, here - b)
            value = value * 2 + bit
        return value, here - lo


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of text in order; its last symbol occurs nowhere else."""
    n = text.size
    order = np.argsort(text, kind="stable")
    key, slots, rank, span = text[order], np.arange(n), np.empty(n, np.int64), 1
    while True:
        new = np.ones(slots.size + 1, bool)
        new[1:-1] = key[1:] != key[:-1]
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(new[:-1], np.arange(slots.size), 0))]
        slots = slots[~(new[:-1] & new[1:])]
        if not slots.size:
            return order
        at = order[slots]  # a suffix that ties in its first `span` symbols has more than these
        key = rank[at] * n + rank[at + span]
        by = np.argsort(key, kind="stable")
        order[slots], key = at[by], key[by]
        span *= 2


class FMIndex:
    """Over documents of 64-bit words; each is followed by a separator of its own."""

    def __init__(self, words: np.ndarray, first: np.ndarray):
        docs = first.size - 1
        self.words, code = np.unique(words, return_inverse=True)
        self.docs, self.starts = docs, first[:-1] + np.arange(docs)  # of the documents in the text
        text = np.insert(code.reshape(-1).astype(np.int64) + docs, first[1:], np.arange(docs)) if docs else np.zeros(0, np.int64)
        order = suffix_order(text) if text.size else text
        self.n, self.size = text.size, self.words.size + docs
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.size))])
        self.tree = WaveletTree(text[order - 1], self.size) if text.size else None
        marked = order % SAMPLE == 0
        self.mark = np.concatenate([[0], np.cumsum(marked)])
        self.sample = order[marked]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase; a phrase fills the end of its row."""
        lo, hi = np.zeros(lengths.size, np.int64), np.full(lengths.size, self.n, np.int64)
        if not self.words.size:
            return lo, lo
        code = np.searchsorted(self.words, phrases)
        code[code == self.words.size] = 0
        known = self.words[code] == phrases
        for k in range(phrases.shape[1]):
            column = phrases.shape[1] - 1 - k
            live = np.flatnonzero((k < lengths) & (lo < hi))
            ok = known[live, column]
            hi[live[~ok]] = lo[live[~ok]]
            live = live[ok]
            if not live.size:
                continue
            c = code[live, column] + self.docs
            lo[live], hi[live] = self.first[c] + self.tree.rank(c, lo[live]), self.first[c] + self.tree.rank(c, hi[live])
        return lo, hi

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Positions in the text of suffixes, by steps back to a sampled one."""
        out, steps, live, here = np.empty(places.size, np.int64), 0, np.arange(places.size), places.astype(np.int64)
        while live.size:
            hit = self.mark[here + 1] > self.mark[here]
            out[live[hit]] = self.sample[self.mark[here[hit]]] + steps
            live, here = live[~hit], here[~hit]
            if live.size:
                value, rank = self.tree.at(here)
                here = self.first[value] + rank
                steps += 1
        return out


class Phrases:
    """A block of windows with the items they come from; picklable, of bounded size."""

    def __init__(self, windows: list[bytes], items: list[str | None]):
        table: dict[bytes, list[int]] = {}
        self.items = sorted({x for x in items if x is not None})
        number = {x: k for k, x in enumerate(self.items)}
        for w, x in zip(windows, items):
            own = table.setdefault(w, [])
            if x is not None:
                own.append(number[x])
        self.lengths = np.array([len(w) // 8 for w in table], np.int64)
        self.words = np.zeros((len(table), WINDOW), np.uint64)
        for k, w in enumerate(table):
            self.words[k, WINDOW - len(w) // 8 :] = np.frombuffer(w, np.uint64)
        self.owners = list(table.values())

    def mark(self, index: FMIndex, hit: np.ndarray, items: list[set[str]]) -> None:
        """Adds to hit the words of a shard, and to items the items of its documents, that this block's windows find."""
        if not hit.size or not self.lengths.size:
            return
        lo, hi = index.search(self.words, self.lengths)
        found = np.flatnonzero(hi > lo)
        if not found.size:
            return
        count = (hi - lo)[found]
        ends = np.cumsum(count)
        places = np.repeat(lo[found] - (ends - count), count) + np.arange(ends[-1])
        window = np.repeat(found, count)
        at = index.locate(places)
        doc = np.searchsorted(index.starts, at, "right") - 1
        word = at - doc
        edge = np.bincount(word, minlength=hit.size + 1) - np.bincount(word + self.lengths[window], minlength=hit.size + 1)
        hit |= np.cumsum(edge)[:-1] > 0
        pairs = np.unique(doc * self.lengths.size + window)
        for d, w in zip((pairs // self.lengths.size).tolist(), (pairs % self.lengths.size).tolist()):
            items[d].update(self.items[x] for x in self.owners[w])


def hits(blocks: list, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[set[str]]]:
    """(hit or not of every word, items of every document) of one shard, by all blocks (broadcast Phrases)."""
    hit, items = np.zeros(hashes.size, bool), [set() for _ in range(first.size - 1)]
    if hashes.size and blocks:
        index = FMIndex(hashes, first)
        for block in blocks:
            block.value.mark(index, hit, items)
            if len(blocks) > 1:
                block.__dict__.pop("_value", None)  # read again from the worker's file when it is needed again
    return hit, items


def _windows(batches):
    for batch in batches:
        for at, n, offsets, data in text_slices(batch.column(1)):
            hashes, first, _, _ = hashed_words(offsets, data)
            rows = []
            for k, item in enumerate(batch.column(0).slice(at, n).to_pylist()):
                own = hashes[first[k] : first[k + 1]]
                if own.size:
                    size = min(WINDOW, own.size)
                    rows += [(item, own[j : j + size].tobytes()) for j in range(own.size - size + 1)]
            item, window = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(window, pa.binary())], ["item", "window"])


def phrase_blocks(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text"):
    """Broadcast blocks of the benchmark's distinct (window, item) pairs, BLOCK_WINDOWS each or about that."""
    spark = benchmark.sparkSession
    ship(spark)
    pairs = benchmark.select(F.col(id_column).cast("string").alias("item"), F.col(text_column).cast("string").alias("text")).mapInArrow(_windows, "item string, window binary")
    pairs = settle(pairs.distinct())
    blocks = -(-pairs.count() // BLOCK_WINDOWS)
    for k in range(blocks):
        rows = pairs.where(F.pmod(F.xxhash64("item", "window"), F.lit(blocks)) == k).collect() if blocks > 1 else pairs.collect()
        yield spark.sparkContext.broadcast(Phrases([bytes(r["window"]) for r in rows], [r["item"] for r in rows]))


def _shards(batches, column: int):
    """(batch, first row, rows, word hashes, their bounds, starts, ends, offsets) of shards of documents."""
    for batch in batches:
        for at, n, offsets, data in text_slices(batch.column(column), SHARD_WORDS * 8):
            hashes, first, starts, ends = hashed_words(offsets, data)
            yield batch, at, n, hashes, first, starts, ends, offsets, data


def _edges(hit: np.ndarray) -> list[int]:
    """[start, end, start, end, ...] of the runs of hit words."""
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).tolist()


def _search(blocks):
    def run(batches):
        for batch, at, n, hashes, first, *_ in _shards(batches, 1):
            hit, items = hits(blocks, hashes, first)
            spans = [_edges(hit[a:b]) if b > a else [] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, n), pa.array(np.diff(first), pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                ["doc_id", "n_words", "spans", "items"],
            )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, items): spans are bounds of hit words, [start, end, start, end, ...]."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_search(list(phrase_blocks(benchmark))), f"doc_id {kind}, n_words long, spans array<long>, items array<string>")


def _left(text: bytes, edge, starts, ends) -> bytes:
    """text without the words of the spans [start, end, ...] of edge and what stands between them."""
    keep, at = [], 0
    for a, b in zip(edge[::2], edge[1::2]):
        keep.append(text[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*keep, text[at:]])


def _cut(blocks, shard) -> dict[int, bytes]:
    """Of the rows of a shard that are hit: what is left when nothing more is found in what is left."""
    out: dict[int, bytes] = {}
    _, _, n, hashes, first, starts, ends, offsets, data = shard
    rows = list(range(n))
    while rows:
        hit, _ = hits(blocks, hashes, first)
        again = []
        for k, row in enumerate(rows):
            a, b = first[k], first[k + 1]
            if b > a and hit[a:b].any():
                out[row] = _left(data[offsets[k] : offsets[k + 1]].tobytes(), _edges(hit[a:b]), starts[a:b] - offsets[k], ends[a:b] - offsets[k])
                again.append(row)
        rows = again
        if rows:
            offsets = np.concatenate([[0], np.cumsum([len(out[r]) for r in rows])])
            data = np.frombuffer(b"".join([*(out[r] for r in rows), bytes(8)]), np.uint8)
            hashes, first, starts, ends = hashed_words(offsets, data)
    return out


def _without(blocks):
    def run(batches):
        for batch in batches:
            texts = {}
            for _, *shard in _shards([batch], 0):
                texts |= {shard[0] + k: x.decode() for k, x in _cut(blocks, (None, *shard)).items()}
            whole = batch.column(0).to_pylist()
            out = [texts.get(k, x) for k, x in enumerate(whole)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array([k in texts for k in range(len(out))], pa.bool_()), *batch.columns[1:]], ["_text", "_cut", *batch.schema.names[1:]])

    return run


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text_column: str = "text") -> DataFrame:
    """docs without the benchmark's passages; a document of which only white space is left is dropped.

    All words hit by any window of any block go at once, and what is left is searched again, until it holds no window.
    """
    ship(docs.sparkSession)
    blocks, names = list(phrase_blocks(benchmark)), docs.columns
    if not blocks:
        return docs
    renamed = docs.select(F.col(f"`{text_column}`").cast("string").alias("_own"), *[F.col(f"`{c}`").alias(f"_c{j}") for j, c in enumerate(names) if c != text_column])
    kinds = ", ".join(["_text string", "_cut boolean", *(f"{f.name} {f.dataType.simpleString()}" for f in renamed.schema.fields[1:])])
    cut = renamed.mapInArrow(_without(blocks), kinds).where("NOT _cut OR _text RLIKE '[^\\\\s]'")
    return cut.select(*[(F.col("_text") if c == text_column else F.col(f"_c{j}")).alias(c) for j, c in enumerate(names)])


def op8_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.transform("spans", lambda x, k: F.when(k % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".replace("\\\\", "\\")
OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS win, least(10, len(w)) AS n
        FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
size AS (SELECT DISTINCT n FROM win),
occ AS (SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS win
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, size WHERE len(w) >= n)),
hit AS (SELECT doc_id, k, o.n, item FROM occ o JOIN win USING (win, n)),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM hit)) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)
"""
