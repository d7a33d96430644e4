"""Edge cases of graph operators on small graphs."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import terms
from tessera.operators import induction, patterns, rewrites, service, validation
from tessera.sources import triples
from tessera.streaming import overlay


def graph(spark, rows):
    full = [(s, p, o, "literal" if o.startswith('"') else "iri", "", "") for s, p, o in rows]
    return spark.createDataFrame(full, triples.SCHEMA)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_thresholds_are_strict(spark):
    conf = spark.createDataFrame([("p", 0.75), ("q", 0.76)], "p string, confidence double")
    assert got(induction.accepted(conf).select("p")) == [("q",)]
    t = graph(spark, [(f"i{k}", triples.TYPE, "A") for k in range(10)] + [(f"i{k}", triples.TYPE, "B") for k in range(7)] + [(f"j{k}", triples.TYPE, "B") for k in range(9)])
    assert got(induction.subclasses(t)) == []  # seven of ten is not above .7


def test_cardinality_counts_members_without_values(spark):
    t = graph(spark, [("a", triples.TYPE, "C"), ("b", triples.TYPE, "C"), ("a", "p", "x"), ("a", "p", "y")])
    assert got(induction.cardinalities(t, "p", "C")) == [(0, 2)]


def test_closure_of_a_cycle_and_of_nothing(spark):
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a long, b long")
    assert len(got(patterns.path_plus(ring))) == 9
    assert got(patterns.path_plus(ring.limit(0))) == []


def test_shared_optional_variable_keeps_the_left_value(spark):
    left = spark.createDataFrame([("a", "u"), ("b", None)], "s string, v string")
    right = spark.createDataFrame([("a", "w"), ("b", "x")], "s string, v string")
    assert got(patterns.optional(left, right, ("v",))) == [("a", "u"), ("b", "x")]


def test_patterns_never_cross(spark):
    t = graph(spark, [("a", "p", "b")])
    with pytest.raises(ValueError):
        patterns.bgp(t, ("?a", "p", "?b"), ("?c", "p", "?d"))
    assert got(patterns.pattern(t, "?x", "p", "?x")) == []


def test_dedup_redirects_references_and_is_idempotent(spark):
    t = graph(spark, [("a", triples.TYPE, "C"), ("b", triples.TYPE, "C"), ("c", triples.TYPE, "C"), ("a", "p", "v"), ("b", "p", "v"), ("z", "q", "b")])
    once = rewrites.dedup_individuals(t, "C")
    assert ("z", "q", "a") in got(once.select("s", "p", "o"))
    assert ("c", triples.TYPE, "C") in got(once.select("s", "p", "o"))  # nothing said: never merged
    assert got(rewrites.dedup_individuals(once, "C")) == got(once)


def test_addresses_without_a_comma_have_no_toponym(spark):
    df = spark.createDataFrame([("a", "Rome, x"), ("b", "rome, y"), ("c", "Rome"), ("d", ", z")], "s string, address string")
    assert got(service.same_place(df)) == [("a", "b")]


def test_ntriples_round_trip(spark, tmp_path):
    rows = [("ex:a", "ex:p", 'say "hi"\nto \\ all', "literal", "", "it"), ("ex:a", "ex:q", "ex:b", "iri", "", ""), ("ex:a", "ex:r", "1", "literal", "xsd:int", ""), ("_:n", "ex:p", "", "literal", "", "")]
    t = spark.createDataFrame(rows, triples.SCHEMA)
    triples.write_ntriples(t, str(tmp_path / "g"))
    assert got(triples.read_ntriples(spark, str(tmp_path / "g"))) == sorted(rows)
    text = spark.createDataFrame([("# none",), ("",), ("junk .",)], "value string")
    assert got(triples.parse_ntriples(text)) == []


def test_stream_keeps_each_statement_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nt").write_text("<a> <p> <b> .\n<a> <p> <b> .\n<a> <p> <c> .\n")
    for _ in range(2):
        overlay.append(overlay.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(60)
        (tmp_path / "in" / "b.nt").write_text("<a> <p> <b> .\n<d> <p> <c> .\n")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(terms.before(F.lit("ab"), ",")) == "" and one(terms.after(F.lit("a,b"), ",")) == "b"
    assert one(terms.short_id(F.lit("http://x/y#z/"))) == "z" and one(terms.local_name(F.lit("http://x/y#z"))) == "z"
    assert one(terms.wkt_point(F.lit("point(1 2)"))) is None and one(terms.wkt_point(F.lit("POINT(1.5 -2)")))["lat"] == -2
    assert abs(one(terms.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) - 20015.087) < 0.01
    assert one(terms.classify(F.lit("Not low, high"), [("high", "a"), ("low", "b")], "c")) == "a"


def test_hierarchy_and_clashes(spark):
    parents = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b")], "child string, parent string")
    assert validation.hierarchy(parents).first().asDict() == {"roots": 1, "average_depth": 1.0, "max_depth": 2, "leaves": 2, "average_breadth": 4 / 3, "max_breadth": 2, "nodes": 4, "edges": 3}
    t = graph(spark, [("i", triples.TYPE, "A"), ("i", triples.TYPE, "B"), ("j", triples.TYPE, "A")])
    assert got(validation.clashes(t, spark.createDataFrame([("A", "B")], "a string, b string"))) == [("i", "A", "B")]
