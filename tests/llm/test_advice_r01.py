"""What the review of round 1 found: cases in which an operator did less than its whole job."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import bagminhash, op3_line_dedup, op6_secrets, op8_decontamination


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_op6_formats_pass_their_own_candidates(spark):
    rng = random.Random(5)
    key = lambda head, n: head + "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    labelled = [f'the house stands here and token = "{key("ghp_", 36)}" is read' for _ in range(40)] + [f"api_key: {key('sk-', 11)}\n" for _ in range(40)]
    bare = [key("ghp_", 35) + "7", key("sk-", 10) + "7"]
    plain = "an unremarkable sentence from the neighbouring department in chapter12 of part-2\n" * 3
    rows = docs(spark, [*labelled, f"é see {bare[0]} there", f"or {bare[1]}", plain, "Overwhelmingly-thoughtful-considerations2"])
    formats = op6_secrets.learn(rows)
    found = {r["doc_id"]: r["spans"] for r in op6_secrets.find_secrets(rows, formats).where(F.col("doc_id") >= 80).collect()}
    assert found == {80: "format:6:46", 81: "format:3:17", 82: "", 83: ""}


def test_signatures_do_not_depend_on_the_batch():
    rng = np.random.default_rng(4)
    sizes = [int(x) for x in rng.integers(1, 60, 400)] + [3000, 9000]
    elements = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in sizes]
    for m, per_band, heavy in ((192, 6, 5), (30, 3, 1)):
        weights = [rng.integers(1, heavy + 1, x.size) for x in elements]

        def signed(rows, m=m, per_band=per_band, weights=weights):
            row = np.repeat(np.arange(len(rows)), [elements[k].size for k in rows])
            sig = bagminhash.signatures(np.concatenate([elements[k] for k in rows]), np.concatenate([weights[k] for k in rows]), row, len(rows), m)
            return bagminhash.bands(sig, per_band)

        every = signed(range(len(sizes)))
        for k in [*range(0, 400, 5), 400, 401]:
            assert (signed([k])[0] == every[k]).all()
        few = list(range(7, 60, 9))
        assert (signed(few) == every[few]).all()


def test_decontamination_does_not_depend_on_blocks(spark, monkeypatch):
    passage = [f"w{k}" for k in range(50)]
    bench = spark.createDataFrame([(1, " ".join(passage)), (2, " ".join(f"v{k}" for k in range(14))), (3, "one two three")], "item_id long, text string")
    inner = " ".join([*passage[:5], *(f"v{k}" for k in range(14)), *passage[5:12]])  # a passage that the first cut brings together
    texts = [f"before, {' '.join(passage)}. after", f"x {inner} y", " ".join(passage), None, "", " ", "nothing of it", "one two Three four", "one one two three two three end"]
    rows = spark.createDataFrame([(k, t, k, {"a": k}) for k, t in enumerate(texts)], "doc_id long, text string, `odd name` int, m map<string,int>")

    def left():
        out = op8_decontamination.without_benchmark(rows, bench)
        assert out.columns == rows.columns
        return {r["doc_id"]: (r["text"], r["odd name"], r["m"]) for r in out.collect()}

    whole = left()
    assert {k: v[0] for k, v in whole.items()} == {0: "before, . after", 1: "x  y", 3: None, 4: "", 5: " ", 6: "nothing of it", 7: " four", 8: " end"}
    monkeypatch.setattr(op8_decontamination, "BLOCK_WINDOWS", 9)
    assert left() == whole


def test_op3_short_lines(spark):
    texts = ["Share\nRead  more here\nown\n\nNa-na-na-na-na-na", "share \nread more here\nother\n\nNa-na-na-na-na", "read more there\nSHARE\n \nown", "}"]
    out = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in op3_line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert out == {0: (texts[0], 0), 1: ("other\n", 3), 2: ("read more there\n ", 2), 3: ("}", 0)}
    assert sorted(r["text"] for r in op3_line_dedup.dedup_lines(docs(spark, ["", "a\n\nb"]).union(docs(spark, ["", "a\n\nb"]))).collect()) == ["", "", "", "a\n\nb"]
