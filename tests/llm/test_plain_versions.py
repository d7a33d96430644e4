"""The operators against brute force, exact round trips and plain arithmetic; measured recall of the two MinHash operators."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bagminhash, bpe, common, components, op1_near_dedup, op2_packing, op3_line_dedup, op4_quality, op5_exact_dedup, op6_secrets, op7_sharding, op8_decontamination, op9_language, op10_html
from tessera.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
#: Extra columns with names that the operators use themselves.
SCHEMA = "doc_id long, text string, uid string, line int, part string, n long, lead string, `odd name` int"
ODD = [(None, None), (None, None), (1, None), (2, ""), (3, "   \n"), (4, "one"), (4, "one"), (4, "other"), (5, "word " * 30_000), (None, "é ü 日本"), (6, "a b don't <|endoftext|> it's\n\n\n x  ")]


def docs(spark, pairs):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, "z", 3) for i, t in pairs], SCHEMA)


def data(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_op2_ids_pieces_and_count(spark):
    rows = ODD + [(r["doc_id"], r["text"]) for r in data(spark).select("doc_id", "text").collect()]
    found = op2_packing.pack(docs(spark, rows)).collect()
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(bpe.tokenizer_path())
    want, lengths = Counter(), []
    for i, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        head, at, piece = len(ids) % 1024, 0, 0
        while at < len(ids):
            size = head if at == 0 and head else 1024
            want[i, piece, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())] += 1
            lengths.append(size)
            at, piece = at + size, piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    places = defaultdict(list)
    for r in found:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    rooms: list[int] = []  # best fit, longest first, piece by piece
    for length in sorted(lengths, reverse=True):
        fit = min((k for k in range(len(rooms)) if rooms[k] >= length), key=lambda k: rooms[k], default=None)
        if fit is None:
            rooms.append(1024 - length)
        else:
            rooms[fit] -= length
    assert len(places) == len(rooms)


def test_op2_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(op2_packing, "SHARD_PIECES", 300)
    rng = random.Random(1)
    rows = [(k, "word " * rng.choice([3, 40, 200, 500, 700, 1100])) for k in range(2000)]
    found = op2_packing.pack(docs(spark, rows)).collect()
    assert Counter(r["doc_id"] for r in found if r["piece"] == 0) == Counter(range(2000))
    fill, spans = Counter(), defaultdict(list)
    for r in found:
        fill[r["sequence_id"]] += r["length"]
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in own) == max(a + n for a, n in own) <= 1024 and len({a for a, _ in own}) == len(own) for own in spans.values())
    one = op2_packing.placed(np.array([r["length"] for r in found]))[0].max() + 1
    assert len(fill) <= one * 1.02 + 2


def test_op3_against_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in data(spark).select("doc_id", "text").limit(60).collect()]
    rows += [(1000, "Menu\nMENU\n" + rows[0][1]), (1001, rows[1][1]), (1001, rows[1][1]), (None, rows[2][1]), (1002, None), (1003, "ab\nab \n\n")]
    ranked = []
    for i, t in rows:
        ranked.append((i if i is not None else 2**63, i, t))
    order = sorted({(a, t) for a, _, t in ranked}, key=lambda x: x[0])  # ids here have one text each
    lines, shingles = [], []
    for place, (_, t) in enumerate(order):
        for number, x in enumerate((t or "").split("\n")):
            own = op3_line_dedup.compared(x)
            if own:
                lines.append((place, number, own))
                shingles.append({own[k : k + 8] for k in range(len(own) - 7)})
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for k, x in enumerate(shingles):
        for y in x:
            holders[y].append(k)
    known = {}
    for k, (_, _, own) in enumerate(lines):
        j = known.setdefault(own, k)
        a, b = sorted((find(j), find(k)))
        root[b] = a
        both = Counter(j for y in shingles[k] for j in holders[y] if j < k)
        for j, n in both.items():
            if n >= 0.8 * (len(shingles[j]) + len(shingles[k]) - n) - 1e-9:
                a, b = sorted((find(j), find(k)))
                root[b] = a
    gone = defaultdict(set)
    for k, (place, number, _) in enumerate(lines):
        if find(k) != k:
            gone[place].add(number)
    want = Counter()
    for place, (i, t) in enumerate(order):
        left = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[place])
        want[i if i < 2**63 else None, left] += 1
        for _ in range(sum(1 for a, _, u in ranked if (a, u) == (i, t)) - 1):
            want[i if i < 2**63 else None, "\n".join(x for x in t.split("\n") if not x.strip())] += 1
    out = op3_line_dedup.dedup_lines(docs(spark, rows))
    assert out.columns == [c for c in docs(spark, []).columns] + ["n_lines", "n_dropped"]
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == want


def test_op3_recall():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(2000)]
    shingles = lambda t: {t[k : k + 8] for k in range(len(t) - 7)}
    by = defaultdict(list)
    while min((len(by[k]) for k in (80, 85, 90)), default=0) < 500:
        a = " ".join(rng.choice(words) for _ in range(rng.choice([4, 12, 40])))
        b = list(a)
        for _ in range(rng.randrange(1, 1 + max(2, len(a) // 40))):
            b[rng.randrange(len(b))] = rng.choice("qrstuv")
        b = "".join(b)
        if len(a) >= 9 and a != b:
            j = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
            by[80 if j < 0.85 else 85 if j < 0.9 else 90].append((a, b)) if j >= 0.8 else None
    for pairs in by.values():
        x, y = (op3_line_dedup.minhashed([p[k] for p in pairs]) for k in (0, 1))
        assert (x == y).any(axis=1).mean() >= 0.98


def test_op1_recall():
    rng = np.random.default_rng(5)
    for similarity in (0.8, 0.85, 0.9):
        elements, weights, rows = [], [], []
        for k in range(500):
            n = int(rng.integers(20, 300))
            own, w = rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(1, 4, n)
            other = own.copy()
            change = rng.permutation(n)[: int(n * (1 - similarity) / (1 + similarity))]
            other[change] = rng.integers(0, 2**63, change.size).astype(np.uint64)
            for j, e in enumerate((own, other)):
                order = np.argsort(e)
                elements.append(e[order])
                weights.append(w[order])
                rows.append(np.full(n, 2 * k + j))
        sig = bagminhash.signatures(np.concatenate(elements), np.concatenate(weights), np.concatenate(rows), 1000, op1_near_dedup.BANDS * op1_near_dedup.ROWS)
        assert abs((sig[::2] == sig[1::2]).mean() - similarity) < 0.02  # places agree with the weighted similarity
        keys = bagminhash.bands(sig, op1_near_dedup.ROWS)
        assert (keys[::2] == keys[1::2]).any(axis=1).mean() >= 0.98


def test_op4_pairwise_sum_and_odd_rows(spark):
    machine = op4_quality.Machine(3)
    rng = np.random.default_rng(2)
    machine.w = rng.normal(0, 0.5, machine.w.size).astype(np.float32)
    machine.v = rng.normal(0, 0.3, machine.v.shape).astype(np.float32)
    machine.bias = 0.3
    texts = ["the quick brown fox, the quick dog", "", "x" * 70_000 + " é", "A b C 12 !!"]
    raw = b"".join(t.encode() for t in texts)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    found = op4_quality.features(offsets, np.frombuffer(raw + bytes(8), np.uint8))
    scores = machine.score(*found)
    bounds, buckets, values, stats = found
    stats = machine.standard(stats)
    for k in range(len(texts)):
        x = np.zeros(op4_quality.BUCKETS + op4_quality.STATS)
        x[buckets[bounds[k] : bounds[k + 1]]] = values[bounds[k] : bounds[k + 1]]
        x[op4_quality.BUCKETS :] = stats[k]
        on = np.flatnonzero(x)
        pairs = sum(float(machine.v[i] @ machine.v[j]) * x[i] * x[j] for a, i in enumerate(on) for j in on[a + 1 :])
        z = machine.bias + float(machine.w @ x) + pairs
        assert abs(scores[k] - 1 / (1 + math.exp(-z))) < 1e-4
    frame = docs(spark, ODD)
    assert op4_quality.keep_good(frame, machine).columns == frame.columns and op4_quality.score_quality(frame, machine).count() == len(ODD)
    assert op4_quality.keep_good(frame.limit(0), machine).count() == op4_quality.score_quality(frame.limit(0), machine).count() == 0
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (4, 1, 1), (None, 1, 0), (5, None, 0), *((k, k % 2, 0) for k in (1, 2, 3, 6))], "doc_id long, quality int, toxic int")
    assert op4_quality.learn(frame, labels) is not None and op4_quality.learn(frame, labels.limit(0)) is None


@pytest.mark.parametrize("primes, bases", [(op5_exact_dedup.PRIMES, op5_exact_dedup.BASES), ((2, 3), (1, 1))])
def test_op5_against_plain_grouping(spark, monkeypatch, primes, bases):
    monkeypatch.setattr(op5_exact_dedup, "SALT_ROWS", 3)
    monkeypatch.setattr(op5_exact_dedup, "CHUNK", 64)
    monkeypatch.setattr(op5_exact_dedup, "HUGE", 100)
    rng = random.Random(4)
    long_ = "".join(rng.choice("ab \t\n") for _ in range(1500))
    rows = ODD + [(20 + k, "copy of  one\ttext") for k in range(9)] + [(40, long_), (41, re.sub(r"[ \t\n]+", "  ", long_)), (42, long_[:-1] + "b"), (43, " " * 250), (44, "\n" * 333), (45, " "), (46, "x y")]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = Counter(norm(t) for _, t in rows)
    found = op5_exact_dedup.exact_groups(docs(spark, rows), primes=primes, bases=bases).collect()
    shas = {hashlib.sha256(x.encode()).hexdigest(): x for x in groups}
    assert Counter((r["doc_id"], shas[r["sha"]]) for r in found) == Counter((i, norm(t)) for i, t in rows)
    leads = defaultdict(set)
    for r in found:
        leads[r["lead"]].add(r["sha"])
    assert len(leads) == len(groups) and all(len(x) == 1 for x in leads.values())
    assert op5_exact_dedup.exact_groups(docs(spark, [])).count() == 0


def plain_base(text):
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24])


def test_op6_against_plain_patterns(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows = texts + ODD + [(9001, "é API_KEY = 'abcdefgh' tokentoken=xpassword:yyyyyy PASSWD=12345 token=ſtoken"), (9002, "AKIA" * 9 + "0123456789abcdef" * 3), (9003, "password: secret: token=abcdefg")]
    formats = op6_secrets.learn(docs(spark, rows))
    want = Counter()
    for i, t in rows:
        base = plain_base(t or "")
        sha = hashlib.sha256(",".join(f"{op6_secrets.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        want[i, *(sum(x[1] == k for x in base) for k in range(3)), sha] += 1
    found = op6_secrets.find_secrets(docs(spark, rows), formats).collect()
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in found) == want


def test_op6_finds_planted_formats(spark):
    rng = random.Random(9)
    sign = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    made = [lambda: "ghp_" + "".join(rng.choices(sign, k=36)), lambda: "sk-" + "".join(rng.choices(sign, k=40)), lambda: "xoxb-" + "".join(rng.choices("0123456789", k=12)) + "-" + "".join(rng.choices(sign, k=24))]
    words = [w for r in data(spark).select("text").limit(30).collect() for w in r["text"].split() if w.isalpha()]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(k, f"{prose(20)} token = {made[k % 3]()} {prose(20)}") for k in range(150)]
    planted = [(1000 + k, f"{prose(15)} {made[k % 3]()} {prose(15)}") for k in range(201)]
    clean = [(5000 + k, prose(100) + f" part{k} of 12") for k in range(100)]
    formats = op6_secrets.learn(docs(spark, rows))
    found = {r["doc_id"]: r["spans"] for r in op6_secrets.find_secrets(docs(spark, planted + clean), formats).collect()}
    assert sum("format:" in found[i] for i, _ in planted) >= 0.9 * len(planted)
    assert sum("format:" in found[i] for i, _ in clean) == 0


def test_op7_sizes_laws_and_hot_rows(spark, monkeypatch):
    monkeypatch.setattr(op7_sharding, "BLOCK_ROWS", 7)
    rows = ODD + [(k, f"t{k}") for k in range(300)] + [(77, "same")] * 100
    found = op7_sharding.shard(docs(spark, rows), [1.0, 1.0, 2.0], [1.0]).collect()
    raw = lambda t: (t or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((i, len(raw(t)) + 8, zlib.crc32(raw(t))) for i, t in rows)
    assert all(len({r["shard"] for r in found if r["doc_id"] == i}) == 1 for i, _ in rows) and all(r["grown_shard"] in (r["shard"], 3) for r in found)
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    same = {r["doc_id"]: r["shard"] for r in op7_sharding.shard(docs(spark, rows), [1.0, 1.0, 2.0, 1.0]).collect()}
    assert all(same[r["doc_id"]] == r["grown_shard"] for r in found)


def test_op8_items_without_id_and_plain_search(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(12)]
    bench = [(k, " ".join(rng.choices(words, k=rng.choice([2, 3, 11])))) for k in range(6)] + [(None, "Nameless Item"), (7, None), (8, ""), (9, "w1 w1 w1"), (9, "w2 w2 w2")]
    rows = ODD + [(100 + k, ", ".join(rng.choices(words, k=60)) + " nameless item") for k in range(20)]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = Counter()
    for i, t in rows:
        own, hit, items = split(t), set(), set()
        for item, b in bench:
            w = split(b)
            for k in range(max(1, len(w) - 9) if w else 0):
                window = w[k : k + 10]
                for at in range(len(own) - len(window) + 1):
                    if own[at : at + len(window)] == window:
                        hit.update(range(at, at + len(window)))
                        items.add(item)
        want[i, len(own), len(hit), tuple(sorted(str(x) for x in items if x is not None))] += 1
    frame = spark.createDataFrame(bench, "item_id long, text string")
    for size in (200_000, 3):
        op8_decontamination.BLOCK_WINDOWS, kept = size, op8_decontamination.BLOCK_WINDOWS
        found = op8_decontamination.contamination(docs(spark, rows), frame).collect()
        op8_decontamination.BLOCK_WINDOWS = kept
        assert Counter((r["doc_id"], r["n_words"], sum(r["spans"][1::2]) - sum(r["spans"][::2]), tuple(r["items"])) for r in found) == want


def test_op9_against_plain_counting(spark):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in data(spark).select("doc_id", "text", "lang").collect()] + [(None, "text", "en"), (1, None, "en"), (2, "abc", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, logs = op9_language.learn(frame)

    def counted(text):
        out = Counter()
        own = re.sub(r"\W|\d|_", lambda m: m[0] if m[0].isalpha() else " ", text.lower())
        own = " " + " ".join("".join(c if c.isalpha() else " " for c in own).split()) + " "
        for n in (1, 2, 3):
            for k in range(len(own) - n + 1):
                if own[k : k + n].strip():
                    h = 0
                    for c in own[k : k + n]:
                        h = (h * 0x110001 + ord(c)) % 2**64
                    h = (ord(own[k]) + 0x51ED27) if n == 1 else (h + n * 0x9E3779B97F4A7C15) % 2**64
                    out[int(common.mix(np.array([h], np.uint64))[0]) % op9_language.BUCKETS] += 1
        return out

    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    table, size = {x: Counter() for x in langs}, Counter()
    for i, t, lang in rows:
        if i is not None and t is not None and lang is not None and not held(i):
            table[lang] += counted(t)
            size[lang] += 1
    assert set(size) == set(langs)
    total = {x: sum(c.values()) + op9_language.SMOOTHING * op9_language.BUCKETS for x, c in table.items()}
    for k, lang in enumerate(langs):
        for bucket in list(table[lang])[:50]:
            assert abs(logs[bucket, k] - math.log((table[lang][bucket] + op9_language.SMOOTHING) / total[lang])) < 1e-9
        assert abs(logs[-1, k] - math.log((size[lang] + 1) / (sum(size.values()) + len(langs)))) < 1e-9
    found = op9_language.identify(docs(spark, ODD), langs, logs).collect()
    answers = Counter()
    for i, t in ODD:
        own = counted(t or "")
        logp = {x: math.log((size[x] + 1) / (sum(size.values()) + len(langs))) + sum(n * math.log((table[x][b] + op9_language.SMOOTHING) / total[x]) for b, n in own.items()) for x in langs}
        answers[i, max(sorted(logp), key=logp.get) if own else "und"] += 1
    assert Counter((r["doc_id"], r["lang_pred"]) for r in found) == answers


def test_op10_network_and_odd_pages(spark):
    model = op10_html.learn()
    pages = [r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").select("html").limit(5).collect()]
    pages += ["<article><p>one and some words.</p><p title=it's>two, with more words.</p><p>three of these words here.</p></article>", "<p>" + "long text, " * 20_000]
    blocks = [op10_html.blocks_of(p) for p in pages]
    scores = model.score(blocks)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for own, score in zip(blocks[:6], scores):
        states = {}
        for way in "fb":
            h = c = np.zeros(op10_html.HIDDEN)
            out = []
            for block in own if way == "f" else own[::-1]:
                inputs, values, _ = op10_html.encode([block])
                x = np.zeros(op10_html.INPUTS)
                np.add.at(x, inputs, values)
                z = x @ model.p["x" + way] + model.p["c" + way] + h @ model.p["h" + way]
                i, f, o, g = np.split(z, 4)
                c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
                h = sigmoid(o) * np.tanh(c)
                out.append(h)
            states[way] = out if way == "f" else out[::-1]
        want = [sigmoid(np.concatenate([a, b]) @ model.p["o"] + model.p["ob"])[0] for a, b in zip(states["f"], states["b"])]
        assert np.allclose(want, score, atol=1e-3)
    frame = spark.createDataFrame([(k, "u", p, "x", 1) for k, p in enumerate(pages)], "page_id long, url string, html string, text string, n_chars int")
    found = {r["page_id"]: r for r in op10_html.extract(frame, model).collect()}
    assert found[5]["text"] == "one and some words.\n\ntwo, with more words.\n\nthree of these words here."
    assert all(r["n_chars"] == len(r["text"]) for r in found.values()) and op10_html.extract(frame.limit(0), model).count() == 0


def test_components_over_tasks(spark, monkeypatch):
    rng = random.Random(8)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(1000 + k, 1001 + k) for k in range(60)]
    frame = spark.createDataFrame(links, "a long, b long")

    def found():
        return {r["node"]: r["component"] for r in components.components(frame).collect()}

    one = found()
    monkeypatch.setattr(components, "TASK_LINKS", 50)
    assert found() == one
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert one == {x: find(x) for p in links if p[0] != p[1] for x in p}


def test_settled_tables_go(spark):
    a = common.settle(spark.range(10))
    b = common.settle(a.where("id > 3"), a)
    assert b.count() == 6
    with pytest.raises(Exception):
        a.count()
    common.forget(b)


def test_pipeline_stages_against_plain_versions(spark):
    """Each stage on the table that the one before it left."""
    now = data(spark)
    machine = op4_quality.learn(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = lambda df: Counter(json.dumps(r.asDict(), sort_keys=True) for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)
    good = common.settle(stages["quality"](spark, now, DATA))
    scores = op4_quality.score_quality(now, machine).where("score >= 0.5").select("doc_id")
    assert rows(good) == rows(now.join(scores, "doc_id", "left_semi"))
    lines = common.settle(stages["line_dedup"](spark, good, DATA))
    left = {r["doc_id"]: r["text"] for r in op3_line_dedup.dedup_lines(good.select("doc_id", "text")).collect()}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.collect()} == {i: (t, len(t)) for i, t in left.items()}
    near = common.settle(stages["near_dedup"](spark, lines, DATA))
    bags, root = {}, {}
    for r in lines.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]))
        bags[r["doc_id"]] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter({r["text"]: 1})
        root[r["doc_id"]] = r["doc_id"]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(bags)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = bags[a], bags[b]
            if min(x.total(), y.total()) >= 0.8 * max(x.total(), y.total()):
                both = (x & y).total()
                if both >= 0.8 * (x.total() + y.total() - both) - 1e-9:
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    assert {r["doc_id"] for r in near.collect()} == {i for i in ids if find(i) == i}
    clean = common.settle(stages["decontaminate"](spark, near, DATA))
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    found = op8_decontamination.contamination(near, bench).where("size(spans) > 0").select("doc_id")
    assert rows(clean.join(found, "doc_id", "left_anti")) == rows(near.join(found, "doc_id", "left_anti"))
    assert op8_decontamination.contamination(clean, bench).where("size(spans) > 0").count() == 0
    packed = stages["pack"](spark, clean, DATA)
    assert packed.where("piece = 0").count() == clean.count()
    odd = docs(spark, ODD).withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, DATA)
        assert out.count() >= 0 and stage(spark, odd.limit(0), DATA).count() == 0
        assert name == "pack" or out.columns == odd.columns


def test_every_query_reads_its_whole_table(spark):
    n = {"documents": data(spark).count(), "pages": spark.read.parquet(f"{DATA}/pages.parquet").count()}
    for name, query in QUERIES.items():
        if not name.startswith("op2"):
            assert query(spark, DATA).count() == n["pages" if name.startswith("op10") else "documents"]
