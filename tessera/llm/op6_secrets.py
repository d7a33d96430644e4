"""Secrets in texts: three fixed kinds of match, and candidates of which inferred grammars say that they look like one.

Base matches are those of the kinds `assign`, `access` and `hex` below, leftmost and not overlapping within a kind; their
spans are in code points of the whole text. Each kind's matched credentials, at most EXAMPLES of them from a sample of
about SAMPLE_DOCS documents chosen by a hash of doc_id, label a format; its probabilistic automaton is inferred by
merging a prefix tree's states. Every run of [A-Za-z0-9+/_=-] with a digit and a letter, outside base matches, is a
candidate if it has MIN_RUN characters or as many as the shortest example of a kind (examples of more than 4096 characters
are not learned from; candidates are scored whole, however long). It becomes a span of kind `format`
if some kind's automaton gives it, a character, a likelihood that is above the background's and not below that of all
but a twentieth of the kind's examples, each scored by an automaton of the other half of them. The background is an
automaton of words: runs without a digit, from documents of the sample without base matches. Candidates are in neither.

Null counts as empty; repeated rows are scanned alike; an empty table gives an empty result; with no examples there is
no `format` span. Only the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automata import Automaton
from .common import LOWER, hash_spans, run_spans, ship, table, text_slices

KINDS = ("assign", "access", "hex", "format")
EXAMPLES, SAMPLE_DOCS = 300, 50_000
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_BYTES = np.arange(256)
_HEX = np.isin(_BYTES, list(b"0123456789abcdef"))
_RUN = np.isin(_BYTES, list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"))
_DIGIT = (_BYTES >= 0x30) & (_BYTES <= 0x39)
_LETTER = ((_BYTES | 0x20) >= 0x61) & ((_BYTES | 0x20) <= 0x7A) & (_BYTES < 0x80)
#: Least characters of a credential after a name, and of a candidate where all examples are longer.
MIN_VALUE, MIN_RUN = 6, 20


def _holding(needle: bytes, data: bytes, offsets: np.ndarray) -> set[int]:
    rows, at = set(), data.find(needle)
    while at >= 0:
        row = int(np.searchsorted(offsets, at, "right")) - 1
        rows.add(row)
        at = data.find(needle, int(offsets[row + 1]) - len(needle) + 1 if at + len(needle) <= offsets[row + 1] else at + 1)
    return rows


def _within(inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of the bytes of each span are inside."""
    total = np.concatenate([[0], np.cumsum(inside, dtype=np.int32)])
    return total[ends] - total[starts]


def scan(offsets: np.ndarray, data: np.ndarray, shortest: int = MIN_RUN):
    """(row, text, base spans, runs) of the rows of a slice that have any: [(start, kind, end)], [(start, end)].

    Runs are those with a digit and a letter, of at least `shortest` characters.
    """
    body = data[:-8]
    low, raw = LOWER[body].tobytes(), body.tobytes()
    rows = set().union(*(_holding(w, low, offsets) for w in _WORDS)) | _holding(b"AKIA", raw, offsets)
    spans: dict[int, list] = {}
    for kind, inside, least in ((2, _HEX, 24), (3, _RUN, shortest)):
        starts, ends = run_spans(inside[body], offsets)
        use = ends - starts >= least
        starts, ends = starts[use], ends[use]
        if kind == 3:
            use = (_within(_DIGIT[body], starts, ends) > 0) & (_within(_LETTER[body], starts, ends) > 0)
            starts, ends = starts[use], ends[use]
        for row, a, b in zip((np.searchsorted(offsets, starts, "right") - 1).tolist(), starts.tolist(), ends.tolist()):
            spans.setdefault(row, []).append((a - int(offsets[row]), kind, b - int(offsets[row])))
    for row in sorted(rows | set(spans)):
        own = raw[offsets[row] : offsets[row + 1]]
        text = own.decode()
        found = spans.get(row, [])
        if len(text) < len(own):  # bytes to code points
            points = np.concatenate([[0], np.cumsum((np.frombuffer(own, np.uint8) & 0xC0) != 0x80)])
            found = [(int(points[a]), kind, int(points[b])) for a, kind, b in found]
        base = [x for x in found if x[1] == 2]
        if row in rows:
            base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
            base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
        base.sort()
        yield row, text, base, [(a, b) for a, kind, b in found if kind == 3]


def _outside(runs, base):
    """The runs that overlap no base span."""
    out, k, reach = [], 0, 0
    for a, b in sorted(runs):
        while k < len(base) and base[k][0] < b:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= a:
            out.append((a, b))
    return out


def _words(offsets: np.ndarray, data: np.ndarray, skip: set[int]) -> list[tuple[int, int, str]]:
    """(3, hash, word) of the EXAMPLES words of least hash, from rows that are not to be skipped."""
    body = data[:-8]
    starts, ends = run_spans(_RUN[body], offsets)
    use = (ends - starts >= MIN_VALUE) & (ends - starts <= 4096) & (_within(_DIGIT[body], starts, ends) == 0) & (_within(_LETTER[body], starts, ends) > 0)
    use &= ~np.isin(np.searchsorted(offsets, starts, "right") - 1, list(skip))
    starts, ends = starts[use], ends[use]
    hashes, at = np.unique(hash_spans(data, starts, ends - starts).view(np.int64), return_index=True)
    raw = body.tobytes()
    return [(3, h, raw[a:b].decode()) for h, a, b in zip(hashes[:EXAMPLES].tolist(), starts[at[:EXAMPLES]].tolist(), ends[at[:EXAMPLES]].tolist())]


def _examples(batches):
    """(kind, nth, value) of credentials by kind, nth 0, and of words as kind 3, nth their hash: all that can be among the first EXAMPLES."""
    for batch in batches:
        found = set()
        for _, _, offsets, data in text_slices(batch.column(0)):
            matched = set()
            for row, text, base, _ in scan(offsets, data):
                for a, kind, b in base:
                    value = ASSIGN.fullmatch(text[a:b])[2] if kind == 0 else text[a:b]
                    found.add((kind, 0, value))
                    matched.add(row)
            found.update(_words(offsets, data, matched))
        kind, nth, value = zip(*sorted(found)) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(nth, pa.int64()), pa.array(value, pa.string())], ["kind", "nth", "value"])


class Formats:
    """Automata of the labelled kinds and of words, and the least score and length that pass each kind.

    examples: (kind, value), words as kind 3.
    """

    def __init__(self, examples: list[tuple[int, str]]):
        by_kind: dict[int, list[str]] = {}
        for kind, value in sorted(set(examples)):
            by_kind.setdefault(kind, []).append(value)
        self.background = Automaton(by_kind[3]) if by_kind.get(3) else None
        self.kinds = []
        for kind in (0, 1, 2):
            own = by_kind.get(kind, [])
            if len(own) >= 10:
                halves = own[::2], own[1::2]
                held_out = sorted(x for k in (0, 1) for x in map(Automaton(halves[1 - k]).score, halves[k]))
                self.kinds.append((Automaton(own), held_out[len(own) // 20], min(MIN_RUN, *map(len, own))))
        self.shortest = min((size for _, _, size in self.kinds), default=MIN_RUN)

    def passes(self, text: str) -> bool:
        floor = self.background.score(text) + 0.25 if self.background else -99.0
        return any(score >= least and score > floor for a, least, size in self.kinds if len(text) >= size for score in (a.score(text),))


def learn(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Formats:
    ship(docs.sparkSession)
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64(f"`{id_column}`"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    found = some.select(F.col(f"`{text_column}`").cast("string").alias("text")).mapInArrow(_examples, "kind int, nth long, value string")
    rows: list[tuple[int, str]] = []
    for kind in range(4):
        own = found.where(F.col("kind") == kind).where("length(value) <= 4096").distinct()
        rows += [(r["kind"], r["value"]) for r in own.orderBy("nth", F.xxhash64("value"), "value").limit(EXAMPLES).collect()]
    return Formats(rows)


def _scanned(formats: Formats):
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            for at, n, offsets, data in text_slices(batch.column(1)):
                counts, sha, spans = np.zeros((3, n), np.int64), [empty] * n, [""] * n
                for row, text, base, runs in scan(offsets, data, formats.shortest):
                    more = [(a, 3, b) for a, b in _outside(runs, base) if formats.passes(text[a:b])]
                    for _, kind, _ in base:
                        counts[kind, row] += 1
                    name = lambda x: f"{KINDS[x[1]]}:{x[0]}:{x[2]}"
                    sha[row] = hashlib.sha256(",".join(map(name, base)).encode()).hexdigest()
                    spans[row] = ",".join(map(name, sorted(base + more)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *(pa.array(c) for c in counts), pa.array(sha), pa.array(spans)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def find_secrets(docs: DataFrame, formats: Formats, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scanned(formats), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op6_grammar_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_secrets(docs, learn(docs))
