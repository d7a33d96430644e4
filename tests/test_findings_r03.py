"""What the review of round 3 found: steps whose disk, memory or time grew faster than the input."""

import pathlib

from pyspark.sql import functions as F

from tessera.operators import induction, patterns, rewrites, schema, service, vectors
from tessera.plans import catalog, catalog_schema  # noqa: F401
from tessera.sources.triples import SCHEMA


def graph(spark, *rows):
    return spark.createDataFrame([(*r, *("iri", "", "")[len(r) - 3 :]) if len(r) < 6 else r for r in rows], SCHEMA)


def test_analysis_keeps_no_copy_of_the_graph(spark, monkeypatch):
    kept = []
    for module in (schema, induction):
        monkeypatch.setattr(module, "cut", lambda df, real=module.cut: kept.append(real(df)) or kept[-1])
    node = F.concat(F.lit("ex:n"), F.col("id").cast("string"))
    ids = spark.range(3000)
    t = ids.select(node.alias("s"), F.lit("rdf:type").alias("p"), F.lit("ex:A").alias("o"), F.lit("iri").alias("o_kind"), F.lit("").alias("o_dt"), F.lit("").alias("o_lang"))
    link = t.withColumns({"p": F.lit("ex:p"), "o": F.concat(F.lit("ex:m"), F.substr("s", F.lit(5)))})
    a = schema.analyse(t.union(link).union(link))  # every link twice
    assert max(x.count() for x in kept) < 1000
    assert {tuple(r) for r in a.roles.collect()} == {("ex:p", "domain", "ex:A", 3000)} and a.classes.first()["n"] == 3000


def test_counts_of_a_profile(spark):
    rows = [
        ("ex:a", "rdf:type", "ex:A"), ("ex:b", "rdf:type", "ex:A"), ("ex:a", "ex:sym", "ex:b"), ("ex:b", "ex:sym", "ex:a"), ("ex:c", "ex:sym", "ex:c"), ("ex:a", "ex:has", "ex:b"), ("ex:b", "ex:of", "ex:a"),
        ("ex:a", "ex:almost", "ex:b"), ("ex:b", "ex:tsomla", "ex:c"), ("ex:a", "ex:in", "ex:b"), ("ex:b", "ex:in", "ex:c"), ("ex:a", "ex:in", "ex:c"),
        ("ex:a", "ex:one", "x", "literal", "", "it"), ("ex:a", "ex:one", "x", "literal", "", "en"), ("ex:b", "ex:one", "x", "literal", "xsd:token", ""), ("ex:a", "ex:two", "x", "literal", "", "it"), ("ex:a", "ex:two", "y", "literal", "", "en"),
    ]
    t = graph(spark, *rows, *rows)
    a = schema.analyse(t)
    marks = {r["p"]: r for r in a.marks.collect()}
    assert {p for p, r in marks.items() if r["symmetric"]} == {"ex:sym"} and {p for p, r in marks.items() if r["transitive"]} == {"ex:in"}
    assert {p for p, r in marks.items() if not r["functional"]} == {"ex:in"} == {p for p, r in marks.items() if not r["inverse_functional"]}
    assert {(r["p"], r["q"]) for r in a.inverse.collect()} == {("ex:has", "ex:of"), ("ex:of", "ex:almost"), ("ex:almost", "ex:of")}
    assert {(r["p"], r["functional"]) for r in a.functional_data.collect()} == {("ex:one", True), ("ex:two", False)} == {(r["p"], r["functional"]) for r in induction.functional_data(t).collect()}
    assert {(r["p"], r["datatype"], r["n"]) for r in a.datatypes.collect()} == {("ex:one", "rdf:langString", 2), ("ex:one", "xsd:token", 1), ("ex:two", "rdf:langString", 2)}
    assert {(r["cls"], r["p"], r["min_n"], r["max_n"]) for r in a.restrictions.where("p IN ('ex:in', 'ex:of')").collect()} == {("ex:A", "ex:in", 1, 2), ("ex:A", "ex:of", 0, 1)}


def test_many_properties_are_compared_in_turns(spark):
    rows = [(f"ex:{k}", f"ex:p{k:02}", f"ex:o{k}") for k in range(40)] + [(f"ex:o{k}", f"ex:q{k:02}", f"ex:{k}") for k in range(40)]
    t = graph(spark, *rows)
    pairs = induction.turned(t, induction.profile(t))[1]
    assert {(r["p"], r["q"]) for r in pairs.collect()} == {(f"ex:p{k:02}", f"ex:q{k:02}") for k in range(40)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def few_values(spark):
    return graph(spark, *[(f"ex:{k}", "ex:p", f"ex:{v}") for k, v in ((1, 9), (1, 3), (1, 3), (1, 5), (2, 7), (2, 7), (3, 1))], *[(f"ex:{k}", "rdf:type", "ex:C") for k in (1, 2, 4)])


def test_first_values_are_sorted_once_without_a_set(spark):
    out = service.first_values(few_values(spark), "ex:p", 2)
    assert sorted((r["s"], r["o"]) for r in out.collect()) == [("ex:1", "ex:3"), ("ex:1", "ex:5"), ("ex:2", "ex:7"), ("ex:3", "ex:1")]
    found = plan(catalog.QUERIES["top_per_predicate"](spark, "/root/testdata/sf0.001"))
    assert "Aggregate" not in found and found.count("Exchange") == 1


def test_functional_needs_no_set_of_statements(spark):
    t = few_values(spark)
    assert [tuple(r) for r in induction.functional(t).collect()] == [("ex:p", False, True)]
    found = plan(catalog.QUERIES["functional_properties"](spark, "/root/testdata/sf0.001"))
    assert "Join" not in found and found.count("Exchange") <= 3


def test_cardinalities_deal_statements_once(spark):
    assert [tuple(r) for r in induction.cardinalities(few_values(spark), "ex:p", "ex:C").collect()] == [(0, 3)]
    found = plan(catalog.QUERIES["cardinality_restrictions"](spark, "/root/testdata/sf0.001"))
    assert "Join" not in found and found.count("Exchange") == 2


def test_exact_names_are_not_looked_up_by_tokens(spark, monkeypatch):
    names = [(f"{k}", f"ponte vecchio {k}") for k in range(20)] + [("x", "torre alta vecchio"), ("y", "mercato nuovo 1234"), ("z", "nothing")]
    known = [(f"w:ponte_vecchio_{k}", f"ponte vecchio {k}") for k in range(20)] + [("w:alta_vecchio", "-"), ("w:mercato_1234", "-"), ("w:mercato_nuovo", "-"), ("w:a_vecchio_alta_unrelated", "-")]
    world = spark.createDataFrame([(s, "rdfs:label", o, "literal", "", "it") for s, o in known], SCHEMA)
    related = world.where("s NOT LIKE '%unrelated'").select("s")
    names = spark.createDataFrame(names, "id string, name string")
    asked = []
    monkeypatch.setattr(service, "first_fuzzy", lambda w, n, b, real=service.first_fuzzy: asked.append(n.count()) or real(w, n, b))
    found = {r["id"]: r["s"] for r in service.linked(world, names, "w:", related).collect()}
    assert asked == [3] and found == {str(k): f"w:ponte_vecchio_{k}" for k in range(20)} | {"x": "w:alta_vecchio", "y": "w:mercato_1234"}
    plain = service.fuzzy_candidates(world, names, "w:").groupBy("id").agg(F.min(F.struct("rank", "s")).getField("s").alias("s"))
    assert {tuple(r) for r in service.first_fuzzy(world, names, "w:").collect()} == {tuple(r) for r in plain.collect()}


def test_vectors_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    monkeypatch.setattr(vectors, "ROW_BLOCK", 3)
    rows = spark.createDataFrame([(k, [float(k % 5 - 2), 1.0, float(k)]) for k in range(1, 9)] + [(20, None), (21, [0.0, 0.0, 0.0]), (22, [1.0, 2.0]), (23, [1.0, None, 2.0])], "id long, v array<float>")
    found = {(r["a"], r["b"]): r["similarity"] for r in vectors.cosines(rows.where("id < 6 OR id = 22"), rows, "id", "v", 5).collect()}
    v = {r["id"]: r["v"] for r in rows.collect()}
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))
    assert found.keys() == {(a, b) for a in (1, 2, 3, 4, 5, 22) for b in v if a != b}
    assert all(x is None for (a, b), x in found.items() if b in (20, 22, 23) or a == 22) and all(x != x for (a, b), x in found.items() if b == 21 and a != 22)
    assert all(abs(found[a, b] - dot(v[a], v[b]) / (dot(v[a], v[a]) * dot(v[b], v[b])) ** 0.5) <= 0.50001e-5 for a in range(1, 6) for b in range(1, 9) if a != b)
    assert "zip_with" not in plan(catalog.QUERIES["cosine_search"](spark, "/root/testdata/sf0.001")).lower()


def test_redirecting_makes_one_set(spark):
    t = graph(spark, ("ex:o", "ex:has", "ex:2"), ("ex:o", "ex:has", "ex:1"), ("ex:2", "ex:name", "ex:2", "literal", "", ""), ("ex:2", "rdf:type", "ex:C"), ("ex:1", "rdf:type", "ex:C"))
    out = rewrites.redirected(t, spark.createDataFrame([("ex:2", "ex:1")], "s string, canonical string"))
    assert sorted(tuple(r)[:3] for r in out.collect()) == [("ex:1", "ex:name", "ex:2"), ("ex:1", "rdf:type", "ex:C"), ("ex:o", "ex:has", "ex:1")]
    for name in ("classified_parts", "dedup_redirects"):
        found = plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
        before = found[: found.index("Exchange")]  # what follows the last exchange: one set, of all
        assert before.count("HashAggregate") == 2 and "Join" not in before, name


def test_tasks_follow_the_files(spark, monkeypatch):
    monkeypatch.setattr(patterns, "DEALT_BYTES", 1000)
    t = catalog.graph(spark, "/root/testdata/sf0.001", "orders")
    size = sum(x.stat().st_size for x in [pathlib.Path("/root/testdata/sf0.001/orders.parquet")]) * 4
    both = t.join(t.select("s", F.col("o").alias("x")), "s", "left")  # the optimiser takes its size for a product
    assert patterns.dealt(t, "s").rdd.getNumPartitions() == size // 1000 and patterns.dealt(both, "s").rdd.getNumPartitions() == 2 * size // 1000
