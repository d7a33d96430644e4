"""What the review of round 1 found in the rewrites of graphs."""

from tessera.operators import rewrites
from tessera.sources import triples


def test_individuals_whose_references_merge_are_merged(spark):
    rows = [("a1", triples.TYPE, "A"), ("a2", triples.TYPE, "A"), ("a1", "has", "z1"), ("a2", "has", "z2")]
    rows += [("z1", triples.TYPE, "Z"), ("z2", triples.TYPE, "Z"), ("z1", "of", "m1"), ("z2", "of", "m2")]
    rows += [("m1", triples.TYPE, "M"), ("m2", triples.TYPE, "M"), ("m1", triples.TYPE, "owl:NamedIndividual"), ("m1", "name", "x"), ("m2", "name", "x"), ("w", "sees", "a2")]
    kinds = {"x": "literal"}
    t = spark.createDataFrame([(s, p, o, kinds.get(o, "iri"), "", "") for s, p, o in rows], triples.SCHEMA)
    assert rewrites.class_order(t) == ["M", "Z", "A"]
    assert {r["s"] for r in rewrites.dedup_all_individuals(t).collect()} == {"a1", "z1", "m1", "w"}
    ring = spark.createDataFrame([("b", triples.TYPE, "B", "iri", "", ""), ("c", triples.TYPE, "C", "iri", "", ""), ("b", "p", "c", "iri", "", ""), ("c", "p", "b", "iri", "", "")], triples.SCHEMA)
    assert rewrites.class_order(ring) == ["B", "C"] and rewrites.class_order(ring.limit(0)) == []
