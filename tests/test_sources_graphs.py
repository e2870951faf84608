"""Readers, writers, entailment, OWL, graph library, profiling, text search on small graphs."""

import gzip
import io
import json
import xml.etree.ElementTree as ET
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from quadloom.engine import Engine, all_triples
from quadloom.operators import entailment, fulltext, graphlib, owl, profile
from quadloom.operators.paths import components, reach
from quadloom.plans.algebra import OWL, RDF, RDFS, XSD, Lit
from quadloom.sources import readers, writers
from quadloom.sources.graphs import QuadGraph

SKOS = "http://www.w3.org/2004/02/skos/core#"
NT = '<urn:a> <urn:p> "x\\ty \\"q\\" \\u00e9"@en .\n# note\n\n_:b <urn:p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> .\n<urn:a> <urn:q> <urn:b> . # end\n'
TTL = '@prefix : <urn:> . :a :p "z" ; a :C . :l :items (1 "two" :three) . [] :of :a .'
XML = '<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="urn:e#"><e:C rdf:about="urn:a"><e:p rdf:parseType="Collection"><e:D/></e:p><e:q rdf:datatype="urn:t">5</e:q></e:C></rdf:RDF>'


def flat(df):
    return {(r.s.lex, r.p, r.o.lex) for r in df.select("s", "p", "o").collect()}


def graph(spark, *triples):
    return QuadGraph.from_triples(spark, list(triples))


def test_ntriples(spark, tmp_path):
    (tmp_path / "a.nt").write_text(NT)
    with gzip.open(tmp_path / "b.nt.gz", "wt") as f:
        f.write(NT)
    rows = readers.load(spark, str(tmp_path / "a.nt")).quads.collect()
    assert {(r.s.k, r.s.lex, r.p, r.o.k, r.o.lex, r.o.dt, r.o.lang) for r in rows} == {(1, "urn:a", "urn:p", 3, 'x\ty "q" é', "", "en"), (2, "_:b", "urn:p", 3, "5", XSD + "integer", ""), (1, "urn:a", "urn:q", 1, "urn:b", "", "")}
    assert readers.load(spark, str(tmp_path / "b.nt.gz")).quads.count() == 3
    (tmp_path / "q.nq").write_text("<urn:a> <urn:p> <urn:b> <urn:g> .\n<urn:a> <urn:p> <urn:c> .\n")
    assert {r.g for r in readers.load(spark, str(tmp_path / "q.nq")).quads.collect()} == {"urn:g", "user"}
    (tmp_path / "bad.nt").write_text("<urn:a> <urn:p> .\n")
    with pytest.raises(Exception, match="no statement"):
        readers.load(spark, str(tmp_path / "bad.nt")).quads.collect()


def test_documents_and_archives(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TTL)
    got = readers.load(spark, str(tmp_path / "a.ttl")).quads
    assert got.count() == 10 and ("urn:a", RDF + "type", "urn:C") in flat(got)
    (tmp_path / "a.rdf").write_text(XML)
    assert readers.load(spark, str(tmp_path / "a.rdf")).quads.count() == 6
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.ttl", TTL)
        z.writestr("README.txt", "no data")
        z.writestr("sub/a.rdf", XML)
    assert readers.load(spark, str(tmp_path / "z.zip")).quads.count() == 16
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as tar:
        info = tarfile.TarInfo("x.nt")
        info.size = len(NT.encode())
        tar.addfile(info, io.BytesIO(NT.encode()))
    assert readers.load(spark, str(tmp_path / "t.tar.gz")).quads.count() == 3
    assert readers.sniff("x.owl") == "rdfxml" and readers.sniff("x", XML) == "rdfxml" and readers.sniff("x.ttl.gz") == "turtle"
    lib = readers.Library({"one": (str(tmp_path / "a.ttl"), None, ["two"]), "two": (str(tmp_path / "a.rdf"), None, ["one"])})
    assert lib.names() == ["one", "two"] and lib.load(spark, "one").quads.count() == 16
    e = Engine(graph(spark, ("urn:x", "urn:y", "urn:z"))).update(f"LOAD <{tmp_path / 'a.ttl'}> INTO GRAPH <urn:g> ; LOAD SILENT <{tmp_path / 'none.ttl'}>")
    assert e.sparql("SELECT * { GRAPH <urn:g> { ?s ?p ?o } }").count() == 10


def test_result_formats_round_trip(spark, tmp_path):
    g = graph(spark, ("urn:a", "urn:p", Lit("x,\"y\"\n<&>", "", "en")), ("urn:b", "urn:p", Lit("5", XSD + "integer")), ("urn:c", "urn:q", "_:n"))
    df = Engine(g).sparql("SELECT ?s ?o ?z { ?s ?p ?o OPTIONAL { ?s <urn:none> ?z } }", terms=True)
    want = {tuple(None if x is None else (x.k, x.lex if x.k != 2 else "_", x.dt, x.lang) for x in r) for r in df.collect()}
    for fmt, end in (("json", "srj"), ("xml", "srx")):
        writers.write(df, str(tmp_path / f"r.{end}"), fmt)
        back = readers.read_results(spark, str(tmp_path / f"r.{end}"))
        assert {tuple(None if x is None else (x.k, x.lex if x.k != 2 else "_", x.dt, x.lang) for x in r) for r in back.collect()} == want
    for fmt in ("csv", "tsv", "ntriples", "turtle-canonical", "rdfjson"):
        writers.write(df if fmt in ("csv", "tsv") else all_triples(g), str(tmp_path / fmt), fmt)
    assert readers.read_results(spark, str(tmp_path / "csv"), "csv").count() == 3
    assert {r.o.lex for r in readers.read_results(spark, str(tmp_path / "tsv"), "tsv").collect()} >= {"5"}
    assert flat(readers.load(spark, str(tmp_path / "ntriples"), "ntriples").quads) == flat(all_triples(g))
    for r in spark.read.text(str(tmp_path / "rdfjson")).collect():
        json.loads(r.value)
    writers.write(all_triples(g), str(tmp_path / "g.rdf"), "rdfxml")
    assert {x[2] for x in flat(readers.load(spark, str(tmp_path / "g.rdf")).quads)} >= {"5", 'x,"y"\n<&>'}
    writers.write(df, str(tmp_path / "t.xml"), "table-xml")
    for folder in ("t.xml", "g.rdf", "r.srx"):  # every part is a document by itself
        parts = [p.read_text() for p in (tmp_path / folder).glob("part-*")]
        assert parts and all(ET.fromstring(x) is not None for x in parts)
    assert "<null/>" in "".join(p.read_text() for p in (tmp_path / "t.xml").glob("part-*"))
    assert all(json.loads(p.read_text())["head"] for p in (tmp_path / "r.srj").glob("part-*"))
    writers.write(Engine(g).sparql("ASK { ?s ?p ?o }"), str(tmp_path / "ask.json"), "json")
    assert json.loads((tmp_path / "ask.json").read_text())["boolean"] is True
    with pytest.raises(ValueError):
        writers.write(df, str(tmp_path / "x"), "nope")


def test_entailment(spark):
    g = graph(spark, ("urn:A", RDFS + "subClassOf", "urn:B"), ("urn:B", RDFS + "subClassOf", "urn:C"), ("urn:C", RDFS + "subClassOf", "urn:B"), ("urn:x", RDF + "type", "urn:A"), ("urn:p", RDFS + "subPropertyOf", "urn:q"), ("urn:q", RDFS + "domain", "urn:D"), ("urn:q", RDFS + "range", "urn:E"), ("urn:y", "urn:p", "urn:z"))
    ask = lambda regime, text: Engine(g).sparql(f"ASK {{ {text} }}", entail=regime).first()[0]
    assert not ask("none", "<urn:x> a <urn:C>") and ask("rdfslite", "<urn:x> a <urn:C>") and ask("rdfslite", "<urn:y> <urn:q> <urn:z>")
    assert ask("rdfslite", "<urn:A> rdfs:subClassOf <urn:A>") and not ask("rdfslite", "<urn:y> a <urn:D>")
    assert ask("rdfs", "<urn:y> a <urn:D>") and ask("rdfs", "<urn:z> a <urn:E>") and ask("rdfs", "<urn:z> a rdfs:Resource") and ask("rdfs", "<urn:p> a rdf:Property")
    assert ask("rdf", "<urn:p> a rdf:Property") and ask("rdf", "<urn:y> a rdfs:Resource") and not ask("rdf", "<urn:x> a <urn:C>")
    xl = entailment.SKOSXL
    labels = graph(spark, ("urn:c", xl + "prefLabel", "urn:l"), ("urn:l", xl + "literalForm", Lit("cat", "", "en")))
    assert [r.t for r in Engine(labels).sparql("SELECT ?t { <urn:c> skos:prefLabel ?t }", entail="skosxl").collect()] == ["cat"]
    with pytest.raises(ValueError):
        Engine(g).sparql("ASK {}", entail="nope")


def test_owl(spark):
    n = "urn:"
    g = graph(
        spark, (n + "a", RDF + "type", n + "Cat"), (n + "b", RDF + "type", n + "Dog"), (n + "Cat", RDFS + "subClassOf", n + "Pet"), (n + "a", n + "knows", n + "b"), (n + "a", n + "knows", n + "c"), (n + "b", n + "has", n + "v"),
        ("_:u", OWL + "unionOf", "_:l1"), ("_:l1", RDF + "first", n + "Cat"), ("_:l1", RDF + "rest", "_:l2"), ("_:l2", RDF + "first", n + "Dog"), ("_:l2", RDF + "rest", RDF + "nil"),
        ("_:r", OWL + "onProperty", n + "knows"), ("_:r", OWL + "minCardinality", Lit("2")), ("_:v", OWL + "onProperty", n + "has"), ("_:v", OWL + "hasValue", n + "v"), ("_:s", OWL + "onProperty", n + "knows"), ("_:s", OWL + "someValuesFrom", n + "Dog"),
        ("_:c", OWL + "complementOf", "_:u"), (n + "knows", RDF + "type", OWL + "SymmetricProperty"), (n + "up", RDF + "type", OWL + "TransitiveProperty"), (n + "1", n + "up", n + "2"), (n + "2b", n + "up", n + "3"), (n + "2", OWL + "sameAs", n + "2b"), (n + "a", RDFS + "label", Lit("Tom Cat")),
    )
    t = all_triples(g)
    sc = owl.read_schema(t)
    who = lambda df: {r.n.lex for r in df.collect()}
    assert who(owl.satisfies(t, sc, "_:u")) == {"urn:a", "urn:b"} and who(owl.satisfies(t, sc, "urn:Pet")) == {"urn:a"}
    assert who(owl.satisfies(t, sc, "_:r")) == {"urn:a"} and who(owl.satisfies(t, sc, "_:v")) == {"urn:b"} and who(owl.satisfies(t, sc, "_:s")) == {"urn:a"}
    assert "urn:a" not in who(owl.satisfies(t, sc, "_:c")) and "urn:c" in who(owl.satisfies(t, sc, "_:c"))
    pairs = lambda df: {(r.s.lex, r.o.lex) for r in df.collect()}
    assert pairs(owl.has(t, sc, "urn:knows")) == {("urn:a", "urn:b"), ("urn:b", "urn:a"), ("urn:a", "urn:c"), ("urn:c", "urn:a")}
    assert pairs(owl.has(t, sc, "urn:up")) >= {("urn:1", "urn:3"), ("urn:1", "urn:2"), ("urn:1", "urn:2b"), ("urn:2", "urn:3")}
    assert who(owl.find(t, sc, "cat", "word", "urn:Pet")) == {"urn:a"} and owl.merged_restriction(sc, "_:r", "urn:knows").least == 2
    e = owl.apply_rules(Engine(g, {"": n}), [("?x :knows ?y . ?y :has ?z", "?x :gets ?z"), ("?x :gets ?z", "?z :goes ?x")])
    assert e.sparql("ASK { :v :goes :a }").first()[0]


def test_graph_library(spark):
    g = graph(spark, ("urn:a", "urn:p", "_:1"), ("_:1", "urn:p", "_:2"), ("_:2", "urn:q", Lit("deep")), ("urn:z", "urn:p", "urn:a"), ("urn:a", OWL + "sameAs", "urn:b"), ("urn:b", OWL + "sameAs", "urn:c"), ("urn:c", "urn:q", "urn:z"), ("urn:a", RDFS + "label", Lit("A", "", "en")), ("urn:a", RDFS + "label", Lit("Ah", "", "de")))
    t = all_triples(g)
    seeds = spark.createDataFrame([((1, "urn:a", "", ""),)], "n struct<k:int,lex:string,dt:string,lang:string>")
    assert ("_:2", "urn:q", "deep") in flat(graphlib.cbd(t, seeds)) and ("urn:z", "urn:p", "urn:a") not in flat(graphlib.cbd(t, seeds))
    assert ("urn:z", "urn:p", "urn:a") in flat(graphlib.cbd(t, seeds, symmetric=True))
    merged = flat(graphlib.merge_same_as(t))
    assert ("urn:a", "urn:q", "urn:z") in merged and not any(p == OWL + "sameAs" for _, p, _ in merged)
    assert {(r.n.lex, r.label) for r in graphlib.labels(t, seeds, "de").collect()} == {("urn:a", "Ah")}
    assert sum(s.startswith("_:v") for s, _, _ in flat(graphlib.blank_variables(t))) == 2
    target = spark.createDataFrame([((2, "_:2", "", ""),)], seeds.schema)
    assert [(r.steps, r.path[0].lex) for r in graphlib.path_from_named(t, target).collect()] == [(2, "urn:a")]
    twins = all_triples(graph(spark, ("urn:x", "urn:k", "urn:h"), ("urn:y", "urn:k", "urn:h"), ("urn:w", "urn:k", "urn:i")))
    out, members = graphlib.bagify(twins)
    assert {r.member.lex for r in members.collect()} == {"urn:x", "urn:y"} and len(flat(out)) == 5
    schema = all_triples(graph(spark, ("urn:p1", RDFS + "subPropertyOf", "urn:top"), ("urn:p2", RDFS + "subPropertyOf", "urn:top"), ("urn:sym", RDF + "type", OWL + "SymmetricProperty")))
    par = all_triples(graph(spark, ("urn:a", "urn:p1", "urn:b"), ("urn:a", "urn:p2", "urn:b"), ("urn:a", "urn:p1", "urn:c"), ("urn:a", "urn:sym", "urn:b"), ("urn:b", "urn:sym", "urn:a"), ("urn:d", "urn:p1", "urn:e"), ("urn:d", "urn:top", "urn:e")))
    assert ("urn:a", "urn:p1", "urn:c") in flat(graphlib.merge_properties(par, schema))
    assert ("urn:a", "urn:top", "urn:b") in flat(graphlib.merge_properties(par.where("p <> 'urn:sym'"), schema))
    small = flat(graphlib.minimise(par, schema))
    assert ("urn:d", "urn:top", "urn:e") not in small and ("urn:a", "urn:sym", "urn:b") in small and ("urn:b", "urn:sym", "urn:a") not in small
    st = all_triples(graph(spark, ("urn:s", "urn:p", "urn:o"), ("_:st", RDF + "subject", "urn:s"), ("_:st", RDF + "predicate", "urn:p"), ("_:st", RDF + "object", "urn:o"), ("_:st", "urn:by", "urn:me")))
    assert ("_:st", "urn:by", "urn:me") in flat(graphlib.with_reifications(st, st.where("p = 'urn:p'")))
    inferred = flat(graphlib.schema(all_triples(graph(spark, ("urn:i", RDF + "type", "urn:K"), ("urn:i", "urn:has", "urn:i")))))
    assert ("urn:has", RDFS + "domain", "urn:K") in inferred and ("urn:K", RDF + "type", RDFS + "Class") in inferred
    assert flat(graphlib.context(t, seeds, ["urn:p"], [RDFS + "label"], 1)) >= {("urn:a", "urn:p", "_:1"), ("urn:a", RDFS + "label", "A")}
    assert graphlib.smash(t).where(F.col("p").endswith("_1")).count() == 1


@pytest.mark.parametrize("held", [0, 50_000])
def test_closures_in_rounds_and_by_search(spark, held):
    from quadloom.operators.paths import closure

    edges = [(i, i + 1) for i in range(20)] + [(20, 5), (30, 31), (31, 31), (None, 3)]
    got = [tuple(r) for r in closure(spark.createDataFrame(edges, "s int, o int"), held_edges=held).collect() if r.s is not None]
    down = {}
    for a, b in edges:
        down.setdefault(a, set()).add(b)
    want = set()
    for a in range(40):
        front = set(down.get(a, ()))
        while front:
            want |= {(a, x) for x in front}
            front = {y for x in front for y in down.get(x, ()) if (a, y) not in want}
    assert len(got) == len(want) and set(got) == want
    assert closure(spark.createDataFrame([], "s int, o int"), held_edges=held).count() == 0
    terms = spark.createDataFrame([(("a", 1), ("b", 1)), (("b", 1), ("a", 2))], "s struct<x:string,k:int>, o struct<x:string,k:int>")
    assert {(tuple(r.s), tuple(r.o)) for r in closure(terms, held_edges=held).collect()} == {(("a", 1), ("b", 1)), (("b", 1), ("a", 2)), (("a", 1), ("a", 2))}


def test_closures(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(40, 0), (50, 51)], "s int, o int")
    assert reach(edges.where("s = 50"), edges).count() == 1 and reach(edges, edges).count() == 41 * 41 + 1
    with pytest.raises(RuntimeError):
        reach(edges.where("s = 0"), edges, max_rounds=3)
    comp = {r.node: r.component for r in components(edges, "s", "o").collect()}
    assert comp[40] == 0 and comp[51] == 50 and components(edges.limit(0), "s", "o").count() == 0


def test_profile_and_text(spark):
    q = graph(spark, ("urn:a", RDF + "type", "urn:C"), ("urn:a", "urn:p", Lit("red car 20")), ("urn:b", "urn:p", Lit("Red cars")), ("urn:b", "urn:p", Lit("blue bike 7"))).quads
    assert {(r.type, r.n_instances) for r in profile.types(q).collect()} == {("urn:C", 1), (RDFS + "Resource", 1)}
    assert {r.p: (r.n_triples, r.n_subjects, r.n_objects, r.n_domains) for r in profile.predicates(q).collect()}["urn:p"] == (3, 2, 3, 1)
    hit = lambda text: {r.o.lex for r in q.where(fulltext.condition(fulltext.parse(text), F.col("o.lex"))).collect()}
    assert hit("red/i") == {"red car 20", "Red cars"} and hit("red/i -cars") == {"red car 20"} and hit("car/s") == {"red car 20", "Red cars"}
    assert hit("(blue OR 20) -car") == {"blue bike 7"} and hit("5..10") == {"blue bike 7"} and hit(">=8") == {"red car 20"} and hit("^Red") == {"Red cars"} and hit("byke/S") == {"blue bike 7"} and hit("ca*") == {"red car 20", "Red cars"}
    assert {r.o.lex for r in q.where(fulltext.browse("RED -cars", F.col("o.lex"))).collect()} == {"red car 20"}
    two = spark.createDataFrame([(1,), (1,)], "x int")
    assert profile.unique_solution(two).count() == 1 and profile.unique_solution(two.union(spark.createDataFrame([(2,)], "x int"))).count() == 0
    assert profile.head_and_tail(spark.range(10).toDF("x"), "x", 2, 2).count() == 4


def test_store_answers_alike(spark, tmp_path):
    g = graph(spark, ("urn:a", "urn:p", "urn:b"), ("urn:a", "urn:p", "urn:b", "urn:g"), ("urn:b", "urn:p", Lit("x y", "", "en"), "urn:g"), ("urn:c", "urn:q/r?=1", "urn:a", None))
    st = g.store(str(tmp_path / "store"))
    for q in ("SELECT ?s ?p ?o { ?s ?p ?o }", "SELECT ?s ?o { ?s <urn:p> ?o }", "SELECT ?g ?s { GRAPH ?g { ?s <urn:p> ?o } }", "SELECT ?s FROM <urn:g> FROM <user> { ?s <urn:p> <urn:b> }", "SELECT ?x { ?x <urn:p>+ ?y }", "SELECT ?s { ?s <urn:q/r?=1> ?o }"):
        rows = lambda e: sorted(map(str, e.sparql(q).collect()))
        assert rows(Engine(st)) == rows(Engine(g)), q
    plan = Engine(st).sparql("SELECT ?s ?o { ?s <urn:p> ?o }")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PartitionFilters: [isnotnull(p" in plan
    schema = graph(spark, ("urn:C", RDF + "type", RDFS + "Class"), ("urn:x", RDF + "type", "urn:C"))
    assert flat(graphlib.extract(all_triples(schema), data_part=False)) == {("urn:C", RDF + "type", RDFS + "Class")}


def test_service_runs_on_a_registered_endpoint(spark):
    other = graph(spark, ("urn:a", "urn:name", Lit("Ann")))
    e = Engine(graph(spark, ("urn:x", "urn:knows", "urn:a")), {"": "urn:"}, endpoints={"urn:far": other})
    assert [tuple(r) for r in e.sparql("SELECT ?x ?n { ?x :knows ?y SERVICE <urn:far> { ?y :name ?n } }").collect()] == [("urn:x", "Ann")]
    assert e.sparql("SELECT ?x { ?x :knows ?y SERVICE SILENT <urn:none> { ?y :name ?n } }").count() == 1
    with pytest.raises(ValueError):
        e.sparql("SELECT ?x { SERVICE <urn:none> { ?y :name ?n } }")
