"""Files, query text, refinement and enrichment on small hand-made graphs."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import terms
from tessera.operators import enrich, induction, labels, refine, schema, service
from tessera.plans import sparql
from tessera.sources import files, triples, vocabulary

P = {"ex": "http://e.example/"}
TTL = """@prefix ex: <http://e.example/> .
ex:a a ex:C ; ex:p "x\\ty \\"q\\" \\u00e9"@it, 5, 1.5, true, \"\"\"long
"quoted" one\"\"\" ; ex:q ex:b , [ ex:r ex:c ; ex:s ( ex:x "y" ) ] .
_:n1 ex:p ex:a . [] ex:p ex:z .
ex:b ex:back "C:\\\\new\\\\tab"^^<http://www.w3.org/2001/XMLSchema#token> ."""


def graph(spark, *rows):
    return spark.createDataFrame([(*r, *("iri", "", "")[len(r) - 3 :]) if len(r) < 6 else r for r in rows], triples.SCHEMA)


def plain(t):
    return sorted((r.s if not r.s.startswith("_:") else "_", r.p, r.o if r.o_kind != "bnode" else "_", r.o_kind, r.o_dt, r.o_lang) for r in t.collect())


@pytest.mark.parametrize("kind", ["turtle", "xml", "nt"])
def test_round_trip_of_files(spark, tmp_path, kind):
    (tmp_path / "x.ttl").write_text(TTL)
    t = files.read_graph(spark, str(tmp_path / "x.ttl"), prefixes=P)
    assert t.count() == 17 and t.where("o = 'C:\\\\new\\\\tab'").count() == 1 and t.where("p = 'rdf:rest'").count() == 2
    files.write_graph(t, str(tmp_path / "out"), kind, P)
    assert plain(files.read_graph(spark, str(tmp_path / "out"), kind, prefixes=P)) == plain(t)
    assert plain(vocabulary.compact(vocabulary.expand(t, P), P)) == plain(t)


def test_faulty_files(spark):
    for bad in ("<a> <b> .", "ex:a ex:b ex:c .", '"x" <p> <o> .', "<a> <b> <c>"):
        with pytest.raises(ValueError):
            list(files.parse_turtle(bad))
    lines = spark.createDataFrame([("<a><p><b>.",), ("# note",), ("",), ("nonsense",), ('<a> <p> "\\u00e9\\\\n" .',)], "value string")
    assert sorted(r.o for r in triples.parse_ntriples(lines).collect()) == ["b", "é\\n"]
    assert [r.value for r in triples.rejected_lines(lines).collect()] == ["nonsense"]


def test_names_and_text(spark):
    row = spark.createDataFrame([(x,) for x in ['""say "hi"""; ', 'say "hi"', "cittÃ  bella", "Lâ€™arte", "plain", "ABCDEF0123456789ABCDEF0123456789", "x_0123456789abcdef", None]], "x string")
    out = {r[0]: r[1:] for r in row.select("x", terms.clean_literal(F.col("x")), terms.repair(F.col("x")), terms.is_hash_name(F.col("x"))).collect()}
    assert out['say "hi"'][0] == 'say "hi"' and out["cittÃ  bella"][1] == "città bella" and out["Lâ€™arte"][1] == "L’arte"
    assert out["ABCDEF0123456789ABCDEF0123456789"][2] and out["x_0123456789abcdef"][2] and not out["plain"][2] and out[None] == (None, None, None)
    assert terms.salvaged_json('so: ```json\n{"a": 1}\n``` .') == {"a": 1} and terms.salvaged_json("none") is None


def test_thresholds_are_strict(spark):
    people = [(f"ex:{k}", "rdf:type", "ex:A") for k in range(10)] + [(f"ex:{k}", "rdf:type", "ex:B") for k in range(7)]
    assert {(r.child, r.parent) for r in induction.subclasses(graph(spark, *people)).collect()} == {("ex:B", "ex:A")}  # 0.7 of A is not above 0.7
    facts = [(f"ex:{k}", "rdf:type", "ex:A") for k in range(3)] + [("ex:3", "rdf:type", "ex:B")] + [(f"ex:{k}", "ex:p", "v", "literal", "", "") for k in range(4)]
    assert induction.accepted(induction.confidence(graph(spark, *facts))).count() == 0  # 0.75 is not above 0.75


def test_purge_splices_lists(spark):
    t = graph(spark, ("_:u", "owl:unionOf", "_:1", "bnode", "", ""), *[(f"_:{k}", "rdf:first", f"ex:{k}") for k in range(1, 6)], *[(f"_:{k}", "rdf:rest", f"_:{k + 1}", "bnode", "", "") for k in range(1, 5)], ("_:5", "rdf:rest", "rdf:nil"))
    left = refine.purged(t, refine.terms(t, "ex:1", "ex:3", "ex:4", "ex:5"))
    assert {(r.s, r.p, r.o) for r in left.collect()} == {("_:u", "owl:unionOf", "_:2"), ("_:2", "rdf:first", "ex:2"), ("_:2", "rdf:rest", "rdf:nil")}


def test_refine_twice_gives_the_same(spark):
    n = refine.Names()
    t = graph(spark, ("http://x/data/i1", "rdf:type", n.main), ("http://x/data/i1", "rdfs:label", "A - b", "literal", "", ""), ("http://x/data/i2", "rdf:type", n.main), ("http://x/data/i2", "rdfs:label", "A", "literal", "", ""),
              ("http://x/data/i1", n.has_access, "ex:ac"), ("ex:ac", "rdf:type", n.access), ("ex:ac", "rdfs:label", "Parzialmente non accessibile", "literal", "", ""))
    once = refine.refine(t, n)
    assert once.where("p = 'ex:isPartOf'").count() == 1 and once.where("p = 'ac:hasAccessCondition'").first().o == "http://x/data/access-condition/non-accessibile"
    assert plain(refine.refine(once, n)) == plain(once)


def test_restrictions_and_enrichment(spark):
    node = lambda k, p="ex:p": [(f"_:{k}", "rdf:type", "owl:Restriction"), (f"_:{k}", "owl:onProperty", p), (f"_:{k}", "owl:minCardinality", "1", "literal", "", ""), (f"ex:C{k}", "rdfs:subClassOf", f"_:{k}", "bnode", "", "")]
    t = graph(spark, *node("a"), *node("b"), *node("c", "ex:q"), ("_:d", "rdf:type", "owl:Restriction"), ("ex:D", "rdfs:subClassOf", "_:d", "bnode", "", ""))
    out = schema.dedup_restrictions(schema.well_formed_restrictions(t))
    assert {(r.s, r.o) for r in out.where("p = 'rdfs:subClassOf'").collect()} == {("ex:Ca", "_:a"), ("ex:Cb", "_:a"), ("ex:Cc", "_:c")}
    a = schema.analyse(graph(spark, ("ex:1", "rdf:type", "ex:A"), ("ex:1", "ex:knows", "ex:1")))
    assert enrich.ask(None, "x") is None and enrich.enriched(a, None)[1].count() == 0


def test_service_refuses(spark):
    n = refine.Names()
    t = graph(spark, ("ex:i", "rdf:type", n.main), ("ex:i", n.has_access, "ex:a"))
    for args, status in ((("ex:i", "none", ["all"]), 400), (("ex:i", "all", ["all"]), 409)):
        with pytest.raises(service.Refused) as e:
            service.give_access(t, *args, n)
        assert e.value.status == status


def test_query_text(spark):
    t = graph(spark, ("ex:a", "ex:p", "1", "literal", "xsd:integer", ""), ("ex:b", "ex:p", "10", "literal", "xsd:integer", ""), ("ex:c", "ex:q", "x", "literal", "", "en"))
    ask = lambda q, **k: [tuple(r) for r in sparql.query(t, q, **k).collect()]
    assert ask("SELECT ?s WHERE { ?s ex:p ?n . FILTER(?n > 9) }") == [("ex:b",)]
    assert ask('SELECT ?s WHERE { ?s ex:q ?n . FILTER(LANG(?n) = "en" && isLiteral(?n)) }') == [("ex:c",)]
    assert ask('SELECT (STRBEFORE("a,b", ",") AS ?x) (STRBEFORE("ab", ",") AS ?y) WHERE { }') == [("a", "")]
    assert ask("ASK { ?s ex:none ?o }") == [(False,)] and ask("SELECT ?o WHERE { ?s ex:p ?o } ORDER BY DESC(?o) LIMIT 1", params={"s": "ex:a"}) == [("1",)]
    with pytest.raises(ValueError):
        sparql.query(t, "SELECT ?s WHERE { ?s ex:p }")


def test_configuration(spark, tmp_path):
    (tmp_path / "postprocess_config.json").write_text('{"fix_labels": {"ex:C": {"property": "ex:n"}}, "flatten": [{"via": "ex:v"}]}')
    c = labels.load_config(str(tmp_path / "g.ttl"))
    assert c.fix_labels == {"ex:C": {"property": "ex:n"}} and c.flatten == [{"via": "ex:v"}] and files.output_name("/x/my_data.ttl", True) == "/x/my_data_merged.ttl" and files.output_title("/x/my_data.ttl") == "Ontologia My Data"
