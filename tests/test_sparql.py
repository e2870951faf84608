"""Queries over micro graphs: golden rows as bags."""

from collections import Counter

import pytest

from quadloom.engine import Engine
from quadloom.plans import serql, sparql
from quadloom.plans.algebra import RDF, XSD, Lit
from quadloom.sources.graphs import QuadGraph

I = lambda n: Lit(str(n), XSD + "integer")  # noqa: E731, E741
DATA = [
    ("urn:a", "urn:p", "urn:b"), ("urn:b", "urn:p", "urn:c"), ("urn:c", "urn:p", "urn:a"), ("urn:d", "urn:p", "urn:d"),
    ("urn:a", "urn:n", I(1)), ("urn:b", "urn:n", Lit("2.5", XSD + "decimal")), ("urn:c", "urn:n", Lit("x")),
    ("urn:a", "urn:l", Lit("hello", "", "en")), ("urn:b", "urn:l", Lit("world")), ("urn:b", "urn:l", Lit("welt", "", "de-AT")),
    ("urn:a", "urn:t", Lit("2020-05-06T07:08:09.5+02:00", XSD + "dateTime")), ("urn:a", "urn:k", Lit("true", XSD + "boolean")),
    ("urn:a", RDF + "type", "urn:C"), ("urn:b", RDF + "type", "urn:C"), ("urn:x", "urn:of", "_:b1"), ("_:b1", "urn:n", I(7)), ("_:b1", "urn:of", "_:b2"), ("_:b2", "urn:n", I(8)),
    ("urn:l1", RDF + "first", "urn:a"), ("urn:l1", RDF + "rest", "urn:l2"), ("urn:l2", RDF + "first", "urn:b"), ("urn:l2", RDF + "rest", RDF + "nil"),
    ("urn:bag", RDF + "type", RDF + "Bag"), ("urn:bag", RDF + "_1", "urn:a"), ("urn:bag", RDF + "_2", "urn:b"),
    ("urn:a", "urn:p", "urn:b", "urn:g1"), ("urn:g", "urn:q", "urn:h", "urn:g1"), ("urn:g", "urn:q", "urn:i", "urn:g2"),
]


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(QuadGraph.from_triples(spark, DATA), {"": "urn:"})


GOLDEN = {
    "SELECT ?s ?o { ?s :p ?o }": [("urn:a", "urn:b"), ("urn:b", "urn:c"), ("urn:c", "urn:a"), ("urn:d", "urn:d")],
    "SELECT ?s { ?s :p ?s }": [("urn:d",)],
    "SELECT ?s ?l { ?s :p ?o OPTIONAL { ?s :l ?l FILTER(LANG(?l) = '') } }": [("urn:a", None), ("urn:b", "world"), ("urn:c", None), ("urn:d", None)],
    "SELECT ?s ?x { ?s :p ?o OPTIONAL { ?s :l ?x } OPTIONAL { ?s :n ?x } FILTER(BOUND(?x)) }": [("urn:b", "welt"), ("urn:b", "world"), ("urn:a", "hello"), ("urn:c", "x")],
    "SELECT ?s { { ?s :n 1 } UNION { ?s :n ?v FILTER(?v = 2.50) } }": [("urn:a",), ("urn:b",)],
    "SELECT ?s { ?s a :C MINUS { ?s :n 1 } }": [("urn:b",)],
    "SELECT ?s { ?s a :C MINUS { ?q :n 1 } }": [("urn:a",), ("urn:b",)],
    "SELECT ?s { ?s :p ?o FILTER EXISTS { ?o a :C } }": [("urn:a",), ("urn:c",)],
    "SELECT ?s { ?s :p ?o FILTER NOT EXISTS { ?s :n ?v FILTER(?o = :b) } }": [("urn:b",), ("urn:c",), ("urn:d",)],
    "SELECT ?s { ?s :n ?v FILTER(?v > 1 || ?v = 'x') }": [("urn:b",), ("urn:c",), ("_:b1",), ("_:b2",)],
    "SELECT (COUNT(?v) AS ?c) (SUM(?v) AS ?s) (MAX(?v) AS ?m) { ?x :n ?v FILTER(isNUMERIC(?v)) }": [(4, 18.5, "8")],
    "SELECT (COUNT(*) AS ?c) (SUM(?v) AS ?s) (MIN(?v) AS ?m) { ?x :none ?v }": [(0, 0.0, None)],
    "SELECT ?k (COUNT(?s) AS ?c) { ?s :n ?v } GROUP BY (DATATYPE(?v) AS ?k) HAVING (COUNT(?s) > 1)": [(XSD + "integer", 3)],
    "SELECT ?s (GROUP_CONCAT(?l; SEPARATOR='+') AS ?x) { ?s :l ?l } GROUP BY ?s": [("urn:a", "hello"), ("urn:b", "welt+world")],
    "SELECT DISTINCT ?t { ?s a ?t } ORDER BY DESC(?t) LIMIT 1": [("urn:C",)],
    "SELECT ?v { ?s :n ?v } ORDER BY ?v LIMIT 2 OFFSET 1": [("2.5",), ("7",)],
    "SELECT ?o { :a :p+ ?o }": [("urn:b",), ("urn:c",), ("urn:a",)],
    "SELECT ?o { :a :p* ?o }": [("urn:a",), ("urn:b",), ("urn:c",)],
    "SELECT ?o { :a :p? ?o }": [("urn:a",), ("urn:b",)],
    "SELECT ?s { ?s :p* :c }": [("urn:a",), ("urn:b",), ("urn:c",)],
    "SELECT ?o { :a (:p/:p)|:n ?o }": [("urn:c",), ("1",)],
    "SELECT ?o { :a !(:p|:n|:l|:t|:k|^:p) ?o }": [("urn:C",), ("urn:l1",), ("urn:bag",)],
    "SELECT ?s { ?s ^:p :a }": [("urn:b",)],
    "SELECT ?g ?o { GRAPH ?g { :g :q ?o } }": [("urn:g1", "urn:h"), ("urn:g2", "urn:i")],
    "SELECT ?o FROM :g2 { :g :q ?o }": [("urn:i",)],
    "SELECT ?o FROM NAMED :g1 { GRAPH ?g { :g :q ?o } }": [("urn:h",)],
    "SELECT ?s ?v { VALUES (?s ?v) { (:a 1) (:b UNDEF) } ?s :n ?v }": [("urn:a", "1"), ("urn:b", "2.5")],
    "SELECT ?s ?m { ?s a :C { SELECT (MAX(?v) AS ?m) { ?x :n ?v FILTER(isNUMERIC(?v)) } } }": [("urn:a", "8"), ("urn:b", "8")],
    "SELECT ?x { :l1 list:member ?x }": [("urn:a",), ("urn:b",)],
    "SELECT ?g ?o { GRAPH ?g { :a :p+ ?o } }": [("user", "urn:b"), ("user", "urn:c"), ("user", "urn:a"), ("urn:g1", "urn:b")],
    "SELECT ?g { GRAPH ?g { :g :q/:q? :i } }": [("urn:g2",)],
    "SELECT ?s { ?s :n 1 FILTER EXISTS { ?x :q ?y } }": [("urn:a",)],
    "SELECT ?s { ?s :n 1 FILTER NOT EXISTS { ?x :none ?y } }": [("urn:a",)],
    "SELECT ?x { ?s :n 1 . ?x apf:assign ?s }": [("urn:a",)],
    "SELECT ?i ?x { :l1 list:index (?i ?x) }": [(0, "urn:a"), (1, "urn:b")],
    "SELECT ?n { :l1 list:length ?n }": [(2,)],
    "SELECT ?x { :bag rdfs:member ?x }": [("urn:a",), ("urn:b",)],
    "SELECT ?x { ?b apf:bag ?x }": [("urn:a",), ("urn:b",)],
    "SELECT ?s { ?s txt:match 'wor*' }": [("urn:b",)],
    "SELECT ?l { :b :l ?l FILTER(LANGMATCHES(LANG(?l), 'de')) }": [("welt",)],
    "SELECT (YEAR(?t) AS ?y) (HOURS(?t) AS ?h) (TZ(?t) AS ?z) (STR(TIMEZONE(?t)) AS ?d) { :a :t ?t }": [(2020, 7, "+02:00", "PT2H")],
    "SELECT (IF(?k, 'y', 'n') AS ?r) (COALESCE(?zz, 'd') AS ?c) (STRDT('5', xsd:integer) + 1 AS ?n) { :a :k ?k }": [("y", "d", 6.0)],
    "SELECT (1 - 2 - 3 AS ?a) (2 + 3 * 4 AS ?b) (7 / 2 AS ?c) (1 / 0 AS ?d) (ROUND(-2.5) AS ?r) { }": [(-4, 14, 3.5, None, -2)],
    "SELECT (STRBEFORE('abc', 'z') AS ?a) (STRAFTER('abc', 'b') AS ?b) (SUBSTR('abcd', 2, 2) AS ?c) (ENCODE_FOR_URI('a b/ö') AS ?d) { }": [("", "c", "bc", "a%20b%2F%C3%B6")],
    "SELECT (REGEX('Abc', '^aB', 'i') AS ?a) (REPLACE('abab', 'a', 'x') AS ?b) ('a' IN ('b', 'a') AS ?c) (1 = 1.0 AS ?d) (sameTerm(1, 1.0) AS ?e) { }": [(True, "xbxb", True, True, False)],
    "SELECT (xsd:integer('12') AS ?a) (xsd:integer('1x') AS ?b) (xsd:boolean('0') AS ?c) (xsd:integer(2.7) AS ?d) { }": [(12, None, False, 2)],
    "SELECT (LANG(STRLANG('a', 'fr')) AS ?a) (UCASE('ab'@en) AS ?b) (isBLANK(BNODE('x')) AS ?c) (STRLEN(STRUUID()) AS ?d) { }": [("fr", "AB", True, 36)],
}


@pytest.mark.parametrize("query", list(GOLDEN))
def test_select(engine, query):
    assert Counter(tuple(r) for r in engine.sparql(query).collect()) == Counter(GOLDEN[query])


def test_ask_construct_describe(engine):
    assert engine.sparql("ASK { :a :n 1 }").first()[0] and not engine.sparql("ASK { :a :n 9 }").first()[0]
    rows = engine.sparql("CONSTRUCT { ?o :r ?s . _:x :from ?s } WHERE { ?s :p ?o }").collect()
    assert len(rows) == 8 and len({r.s.lex for r in rows if r.s.k == 2}) == 4
    assert engine.sparql("CONSTRUCT { ?v :r ?s } WHERE { ?s :n ?v }").count() == 0  # literal subjects are no triples
    assert {r.o.lex for r in engine.sparql("DESCRIBE :x").collect()} == {"_:b1", "7", "_:b2", "8"}


def test_updates(engine):
    e = engine.update("INSERT DATA { :z :n 5 . GRAPH :g3 { :z :n 6 } } ; DELETE { ?s :n ?v } INSERT { ?s :m ?v } WHERE { ?s :n ?v FILTER(?v < 2) }")
    assert {tuple(r) for r in e.sparql("SELECT ?s ?v { ?s :m ?v }").collect()} == {("urn:a", "1")}
    assert engine.sparql("ASK { :z ?p ?o }").first()[0] is False  # the old snapshot stays
    assert e.update("CLEAR ALL").sparql("SELECT * { ?s ?p ?o }").count() == 0
    moved = e.update("MOVE :g3 TO :g4").sparql("SELECT ?g { GRAPH ?g { :z :n 6 } }").collect()
    assert [r.g for r in moved] == ["urn:g4"]
    assert e.update("DELETE DATA { :z :n 5 } ; ADD :g3 TO :g1").sparql("SELECT ?g ?v { GRAPH ?g { :z :n ?v } }").count() == 2
    assert e.update("DELETE WHERE { ?s :p ?o }").sparql("ASK { ?s :p ?o }").first()[0] is False


@pytest.mark.parametrize("text", ["SELECT", "SELECT ?x { ?x ", "SELECT ?x { ?x :p }", "SELECT ?x { FILTER }", "SELECT * { ?s ?p ?o } GROUP BY ?s", "SELECT ?y { ?s ?p ?o } GROUP BY ?s", "SELECT (1 AS ?s) { ?s ?p ?o }", "ASK { 'a' :p :b }", "SELECT ?x { BIND(1 AS ?x) . nope }", "SELECT ?x { ?x unk:p ?y }"])
def test_bad_syntax(text):
    with pytest.raises(sparql.SyntaxProblem):
        sparql.parse_query(text, prefixes={"": "urn:"})


@pytest.mark.parametrize("text", ["BASE <http://x/> SELECT ?a { <b> <c> ?a }", "SELECT (SUM(?x)*2 AS ?y) { ?x :p [] } GROUP BY ?z ORDER BY ASC(?y)", "DESCRIBE ?x WHERE { ?x :p (1 2 'a'@en-GB) }", "CONSTRUCT WHERE { ?s ?p ?o } LIMIT 5", "ASK FROM <g> { { ?s :p ?o } UNION { ?s :q ?o . } }", "SELECT ?x { ?x :p \"\"\"a\"b\"\"\" ; :q 1.0e5, -3, true . # comment\n }"])
def test_good_syntax(text):
    sparql.parse_query(text, prefixes={"": "urn:"})


MICRO = [("r1", "p1", "r2"), ("r2", "p1", "r3"), ("r3", "p1", "r4"), ("r1", "label", Lit("label_one")), ("r2", "label", Lit("label_two")), ("r3", "label", Lit("label_three")), ("r1", "type", "c1"), ("c1", "label", Lit("class_one")), ("c1", "comment", Lit("Nice class"))]
SERQL = {
    'SELECT X FROM {X} <urn:label> {L} WHERE L LIKE "label*"': [("urn:r1",), ("urn:r2",), ("urn:r3",)],
    "SELECT L FROM {X} <urn:label> {L} WHERE X = <urn:r1>": [("label_one",)],
    "SELECT L FROM {X} <urn:label> {L} WHERE X = <urn:r1> OR X = <urn:r2>": [("label_one",), ("label_two",)],
    'SELECT L FROM {X} <urn:label> {L} WHERE isLiteral(L) AND L LIKE "label*"': [("label_one",), ("label_two",), ("label_three",)],
    "SELECT X, Y FROM {X} <urn:label> {}, {Y} <urn:comment> {}": [("urn:c1", "urn:c1"), ("urn:r1", "urn:c1"), ("urn:r2", "urn:c1"), ("urn:r3", "urn:c1")],
    "SELECT X, L FROM {X} <urn:type> {} <urn:label> {L}": [("urn:r1", "class_one")],
    "SELECT X, Y FROM {X} <urn:p1> {Y}; [<urn:type> {T}] WHERE T = NULL": [("urn:r2", "urn:r3"), ("urn:r3", "urn:r4")],
    "SELECT X FROM {X} p:p1 {Y} WHERE NOT Y = <urn:r2> LIMIT 5 OFFSET 0 USING NAMESPACE p = <urn:>": [("urn:r2",), ("urn:r3",)],
}


@pytest.mark.parametrize("query", list(SERQL))
def test_serql(spark, query):
    u = lambda x: x if isinstance(x, Lit) else f"urn:{x}"
    e = Engine(QuadGraph.from_triples(spark, [tuple(map(u, r)) for r in MICRO]))
    assert Counter(tuple(r) for r in e.serql(query, entail="none").collect()) == Counter(SERQL[query])


@pytest.mark.parametrize("text", ["SELECT X FROM {X} <p> ", "SELECT X FROM {X} {Y}", "SELECT X Y FROM {X} <p> {Y}", "SELECT X FROM {X} <p> {Y} WHERE X <urn:a>", "SELECT X FROM {X} <p {Y}", "SELECT X FROM {X} <p> {Y} WHERE"])
def test_serql_errors(text):
    with pytest.raises(sparql.SyntaxProblem):
        serql.parse(text)


def test_random_patterns_against_nested_loops(spark):
    """Joins of two and three patterns, and OPTIONAL, over a random graph, as bags."""
    import itertools
    import random

    r = random.Random(5)
    triples = sorted({(f"urn:n{r.randrange(6)}", f"urn:p{r.randrange(3)}", f"urn:n{r.randrange(6)}") for _ in range(25)})
    e = Engine(QuadGraph.from_triples(spark, triples))

    def match(patterns):
        out = []
        for combo in itertools.product(triples, repeat=len(patterns)):
            env = {}
            if all(env.setdefault(v, x) == x if v.startswith("?") else v == x for pat, tr in zip(patterns, combo) for v, x in zip(pat, tr)):
                out.append(env)
        return out

    for _ in range(6):
        pats = [(r.choice(["?a", "?b", "?c"]), f"urn:p{r.randrange(3)}", r.choice(["?a", "?b", "?c"])) for _ in range(r.choice([2, 3]))]
        text = " . ".join(" ".join(x if x.startswith("?") else f"<{x}>" for x in p) for p in pats)
        names = sorted({v for p in pats for v in p if v.startswith("?")})
        got = Counter(tuple(row) for row in e.sparql(f"SELECT {' '.join(names)} {{ {text} }}").collect())
        assert got == Counter(tuple(m[v] for v in names) for m in match(pats)), text
        left, right = pats[:1], pats[1:]
        opt = " . ".join(" ".join(x if x.startswith("?") else f"<{x}>" for x in p) for p in right)
        got = Counter(tuple(row) for row in e.sparql(f"SELECT {' '.join(names)} {{ {' '.join(x if x.startswith('?') else f'<{x}>' for x in left[0])} OPTIONAL {{ {opt} }} }}").collect())
        want = Counter()
        for m in match(left):
            more = [{**m, **x} for x in match(right) if all(x.get(k, v) == v for k, v in m.items())]
            for x in more or [m]:
                want[tuple(x.get(v) for v in names)] += 1
        assert got == want, text
