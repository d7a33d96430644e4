"""The operators against plain versions, on small tables with nulls, empty and long texts, ties and clashing names."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import components, op1_near_dedup, op2_packing, op3_line_dedup, op4_quality, op6_secrets, op7_sharding, op8_decontamination, op9_language, op10_html
from tessera.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, line int, part string"


def docs(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, "y") for i, t in pairs], SCHEMA)


def made(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice("abcdefghij") * 2 + str(rng.randrange(400)) for _ in range(n))][0]


ODD = [(None, None), (1, None), (2, ""), (3, "   \n"), (4, "one"), (4, "one"), (5, made(4000, 1)), (None, "é ü")]


def jaccard(a, b):
    words = lambda t: [w for w in "".join(c if c.isalnum() else " " for c in t).split()]
    bag = lambda w: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    x, y = bag(words(a)), bag(words(b))
    return sum((x & y).values()) / sum((x | y).values())


def test_op1_against_all_pairs(spark):
    rng, texts = random.Random(3), []
    for k in range(12):
        base = made(80, k).split()
        texts.append(" ".join(base))
        for j in range(4):
            other = list(base)
            for _ in range(rng.randrange(0, 5)):
                other[rng.randrange(len(other))] = f"new{rng.randrange(9)}"
            texts.append(" ".join(other))
    rows = list(enumerate(texts))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if jaccard(texts[a], texts[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    found = op1_near_dedup.near_duplicates(docs(spark, rows)).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == {k: find(k) for k in range(len(rows))}
    assert sorted(r["doc_id"] for r in op1_near_dedup.drop_near_duplicates(docs(spark, rows)).collect()) == sorted({find(k) for k in range(len(rows))})


def test_prefix_pairs_lose_nothing(spark):
    rng = np.random.default_rng(2)
    common = np.unique(rng.integers(0, 2**63, 40).astype(np.uint64))
    sets = []
    for k in range(60):
        own = np.concatenate([common, rng.integers(0, 2**63, int(rng.integers(0, 30))).astype(np.uint64)]) if k % 3 else rng.permutation(common)[:36]
        sets.append(np.unique(own))
    rows = spark.createDataFrame([(k, k, bytearray(x.tobytes())) for k, x in enumerate(sets)], "uid long, part long, shingles binary")
    found = {(r["a"], r["b"]) for r in components.prefix_pairs(rows, 0.8).collect()}
    for a in range(60):
        for b in range(a + 1, 60):
            both = np.intersect1d(sets[a], sets[b]).size
            if both >= 0.8 * (sets[a].size + sets[b].size - both):
                assert (a, b) in found


def test_large_buckets_find_their_links(spark):
    members = spark.createDataFrame([(1, k, 10) for k in range(40)] + [(2, k, 10) for k in range(3)], "key long, uid long, n long")
    none = spark.createDataFrame([], "node long, component long")
    pairs, inside = components.crossing(members, none, 0.8)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(0, 1), (0, 2), (1, 2)} and inside.count() == 40


def test_buckets_are_dealt_in_packed_form(spark, monkeypatch):
    plans = []

    def settle(df, *spent):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, *spent)

    real = components.settle
    monkeypatch.setattr(components, "settle", settle)
    monkeypatch.setattr(components, "RUN_KEYS", 64)
    monkeypatch.setattr(components, "HOT", 8)
    spread = lambda k: int(components.mix(np.array([k], np.uint64)).view(np.int64)[0])
    held = {spread(k): {k, k + 1000} for k in range(300)} | {spread(k): {k, k + 1000, k + 2000} for k in range(300, 330)}
    held |= {spread(900): set(range(3000, 3400)), spread(901): set(range(3000, 3003)), spread(902): set(range(3030, 3045)), spread(903): {7}}
    keys = defaultdict(list)
    for key, uids in held.items():
        for uid in uids:
            keys[uid].append(key)
    rows = spark.createDataFrame([(uid, uid % 7, 1 + uid % 5, own) for uid, own in sorted(keys.items())], "uid long, n long, copies long, keys array<long>")
    pairs, members = components.bucket_pairs(rows)
    assert sorted((r["key"], r["uid"], r["n"]) for r in members.collect()) == sorted((key, uid, uid % 7) for key, uids in held.items() if len(uids) > 2 for uid in uids)
    found = {(r["a"], r["b"]) for r in pairs.collect()}
    assert len(found) == pairs.count() <= sum(map(len, keys.values())) and all(a < b for a, b in found)
    for uids in held.values():  # each bucket is held together by links inside it
        u, v = np.array([x for x in found if set(x) <= uids], np.int64).reshape(-1, 2).T
        assert len(components.roots(u, v)[0]) == len(uids) - 1
    # a record of a bucket is no row of its own, and buckets are not joined with their members again
    assert not any(x in p for p in plans for x in ("Generate", "SortMergeJoin", "BroadcastHashJoin"))


def test_op2_round_trip(spark):
    rows = ODD + [(10 + k, made(200 * k, k)) for k in range(1, 12)]
    found = op2_packing.pack(docs(spark, rows)).collect()
    by = defaultdict(list)
    for r in found:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len({r["doc_id"] for r in found if r["piece"] == 0}) == len({i for i, _ in rows})
    assert sum(r["piece"] == 0 for r in found) == len(rows)
    assert op2_packing.pack(docs(spark, [])).collect() == []


def test_op3_lines(spark):
    line = "The quick brown fox jumps over the lazy dog near the river bank"
    rows = [(1, f"{line}\nown line number one of the first"), (2, f"short\n{line}!\nanother line that only the second has"), (3, f"{line.upper()}"), (11, None), (12, ""), (13, "  \n")]
    out = {r["doc_id"]: r["text"] for r in op3_line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert out[1] == rows[0][1] and out[2] == "short\nanother line that only the second has" and out[3] == ""
    assert (out[11], out[12], out[13]) == (None, "", "  \n")


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op6", "op7", "op8"])
def test_odd_rows_and_empty_tables(spark, name):
    bench = spark.createDataFrame([(1, "one"), (None, "x y"), (2, None)], "item_id long, text string")
    formats = op6_secrets.Formats([])
    run = {
        "op1": op1_near_dedup.drop_near_duplicates, "op2": op2_packing.pack, "op3": op3_line_dedup.dedup_lines, "op6": lambda d: op6_secrets.find_secrets(d, formats),
        "op7": lambda d: op7_sharding.shard(d, [1.0] * 3, [1.0]), "op8": lambda d: op8_decontamination.without_benchmark(d, bench),
    }[name]
    assert run(docs(spark, ODD).limit(0)).count() == 0
    n = run(docs(spark, ODD)).count()
    assert n == {"op1": 5, "op2": n, "op3": 8, "op6": 8, "op7": 8, "op8": 6}[name]


def test_op4_and_op9_learn(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = QUERIES["op4_factorisation_machine"](spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id")
    assert found.where("predicted = quality").count() >= 0.95 * found.count()
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op9_naive_bayes_language"](spark, "/root/testdata/sf0.01").where("held_out AND lang_pred <> 'und'").join(lang, "doc_id")
    assert found.where("lang_pred = lang").count() >= 0.98 * found.count()
    rows = op9_language.identify(docs(spark, ODD), *op9_language.learn(docs(spark, []))).collect()
    assert {r["lang_pred"] for r in rows} == {"und"}
    assert {r["score"] for r in op4_quality.score_quality(docs(spark, ODD), None).collect()} == {0.5}


def test_op7_law(spark):
    rows = [(k, f"t{k % 7}") for k in range(500)] + ODD
    found = op7_sharding.shard(docs(spark, rows), [1.0] * 24, [1.0]).collect()
    assert len(found) == len(rows) and all(r["grown_shard"] in (r["shard"], 24) for r in found)
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_op10_on_hand_made_pages(spark):
    model = op10_html.learn()
    page = (
        '<html><head><title>x</title><script>var a="<p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie">We use cookies.</div>'
        "<article><h1>Fish &amp; chips</h1><p>First <b>bold\n  words</b> here, and more of them.<p>Second paragraph of the article, with its words.</article>"
        '<section class="comments"><p>Nice one, thanks!</p></section><footer>&copy; 2024</footer>'
    )
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (None, "v", ""), (4, "w", "<p"), (1, "u", page)], "page_id long, url string, html string")
    found = [r["text"] for r in op10_html.extract(pages, model).collect()]
    want = "Fish & chips\n\nFirst bold words here, and more of them.\n\nSecond paragraph of the article, with its words."
    assert sorted(found) == ["", "", "", want, want]
    assert op10_html.extract(pages.limit(0), model).count() == 0


def test_pipeline_stages_keep_the_columns(spark):
    now = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, op3_line_dedup.settle(stage(spark, now, DATA))
        if name != "pack":
            assert now.columns == columns
            assert now.select("doc_id").subtract(before.select("doc_id")).count() == 0
            assert now.count() == now.dropDuplicates(["doc_id"]).count()
    assert now.count() > 0
    odd = docs(spark, ODD)
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, odd, DATA).count() >= 0 and stage(spark, odd.limit(0), DATA).count() == 0
