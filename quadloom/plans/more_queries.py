"""Further queries over the test tables, one per operator that survey_queries leaves out, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import terms
from quadloom.engine import Engine, all_triples
from quadloom.operators import entailment, fulltext, graphlib, owl, profile
from quadloom.plans import updates
from quadloom.plans.algebra import RDF
from quadloom.plans.survey_queries import _COMP, _E, NUM, PREFIXES, WR, W, _flat, star, statements
from quadloom.runtime import Spool, table
from quadloom.sources import readers, writers
from quadloom.sources.graphs import QuadGraph, star_schema

XSD = "http://www.w3.org/2001/XMLSchema#"

# name: (SPARQL, SQL) over the star schema
STAR: dict[str, tuple[str, str]] = {
    "j11_minus": (
        "SELECT ?c ?o { ?c :c_mktsegment 'BUILDING' OPTIONAL { ?o :o_custkey ?c ; :o_orderstatus 'P' } MINUS { ?o :o_orderpriority '1-URGENT' } }",
        "WITH a AS (SELECT c_custkey, o_orderkey, o_orderpriority FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE c_mktsegment = 'BUILDING') SELECT 'urn:t:customer/' || c_custkey AS c, 'urn:t:orders/' || o_orderkey AS o FROM a WHERE o_orderkey IS NULL OR o_orderpriority <> '1-URGENT'",
    ),
    "j11_not_exists": (
        "SELECT ?c ?o { ?c :c_mktsegment 'BUILDING' OPTIONAL { ?o :o_custkey ?c ; :o_orderstatus 'P' } FILTER NOT EXISTS { ?o :o_orderpriority '1-URGENT' } }",
        "WITH a AS (SELECT c_custkey, o_orderkey, o_orderpriority FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE c_mktsegment = 'BUILDING') SELECT 'urn:t:customer/' || c_custkey AS c, 'urn:t:orders/' || o_orderkey AS o FROM a WHERE CASE WHEN o_orderkey IS NULL THEN NOT EXISTS (SELECT 1 FROM orders WHERE o_orderpriority = '1-URGENT') ELSE o_orderpriority <> '1-URGENT' END",
    ),
    "j11_optional": (
        "SELECT ?c ?o ?p { ?c :c_mktsegment 'BUILDING' ; :c_acctbal ?b FILTER(?b > 9500) OPTIONAL { ?o :o_custkey ?c ; :o_orderstatus 'P' } OPTIONAL { ?o :o_totalprice ?p FILTER(?p > 440000) } }",
        "WITH a AS (SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9500) SELECT 'urn:t:customer/' || c_custkey AS c, 'urn:t:orders/' || coalesce(a.o_orderkey, u.o_orderkey) AS o, o_totalprice AS p FROM a LEFT JOIN orders u ON (a.o_orderkey IS NULL OR a.o_orderkey = u.o_orderkey) AND o_totalprice > 440000",
    ),
    "j11_theta_optional": (
        "SELECT ?c ?o ?p { ?c :c_mktsegment 'BUILDING' ; :c_acctbal ?b FILTER(?b > 9000) OPTIONAL { ?o :o_custkey ?c ; :o_orderstatus 'P' } OPTIONAL { ?o :o_totalprice ?p FILTER(?p > 200000 + ?b) } }",
        "WITH a AS (SELECT c_custkey, c_acctbal AS b, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000) SELECT 'urn:t:customer/' || c_custkey AS c, 'urn:t:orders/' || coalesce(a.o_orderkey, u.o_orderkey) AS o, o_totalprice AS p FROM a LEFT JOIN orders u ON (a.o_orderkey IS NULL OR a.o_orderkey = u.o_orderkey) AND o_totalprice > 200000 + b",
    ),
    "j11_exists": (
        "SELECT ?s (COUNT(*) AS ?n) { { ?x :o_orderstatus ?s } UNION { ?l :l_linestatus ?s } FILTER EXISTS { ?x :o_orderpriority '1-URGENT' } } GROUP BY ?s",
        "WITH a AS (SELECT o_orderkey, o_orderstatus AS s FROM orders UNION ALL SELECT NULL, l_linestatus FROM lineitem) SELECT s, count(*) AS n FROM a WHERE o_orderkey IS NULL OR o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY s",
    ),
    "p6_in_optional": (
        "SELECT ?c ?o { ?c :c_mktsegment 'MACHINERY' ; :c_nationkey ?k OPTIONAL { ?o :o_custkey ?c FILTER EXISTS { ?l :l_orderkey ?o ; :l_suppkey ?s . ?s :s_nationkey ?k } } }",
        "SELECT 'urn:t:customer/' || c_custkey AS c, 'urn:t:orders/' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_orderkey = o_orderkey AND s_nationkey = c_nationkey) WHERE c_mktsegment = 'MACHINERY'",
    ),
    "p8_group_scoping": ("SELECT ?n { ?k :n_name ?n { ?k :n_regionkey ?r FILTER(BOUND(?r)) } { FILTER(!BOUND(?n)) } }", "SELECT n_name AS n FROM nation"),
    "a11_sample": ("SELECT ?x (SAMPLE(?r) AS ?s) { ?n :n_regionkey ?x . ?x :r_name ?r } GROUP BY ?x", "SELECT 'urn:t:region/' || n_regionkey AS x, min(r_name) AS s FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "a10_avg_distinct": ("SELECT (ROUND(AVG(DISTINCT ?s) * 100) AS ?m) { ?p :p_size ?s }", "SELECT CAST(floor(avg(DISTINCT p_size) * 100 + 0.5) AS BIGINT) AS m FROM part"),
    "o6_reduced": ("SELECT REDUCED ?r ?n { ?k :n_regionkey ?r ; :n_name ?n }", "SELECT 'urn:t:region/' || n_regionkey AS r, n_name AS n FROM nation"),
    "x3_unary": ("SELECT ?p (-?s AS ?m) (+?s AS ?q) { ?p :p_size ?s }", "SELECT 'urn:t:part/' || p_partkey AS p, -p_size AS m, p_size AS q FROM part"),
    "b6_str": ("SELECT (STR(?k) AS ?a) (STR(?n) AS ?b) { ?k :n_name ?n }", "SELECT 'urn:t:nation/' || n_nationkey AS a, n_name AS b FROM nation"),
    "b9_strdt": ("SELECT ?n (STRDT(STR(?s), xsd:integer) + 1 AS ?i) { ?p :p_name ?n ; :p_size ?s }", "SELECT p_name AS n, CAST(p_size + 1 AS DOUBLE) AS i FROM part"),
    "b10_strlang": ("SELECT (LANG(STRLANG(?n, 'en')) AS ?l) (STR(STRLANG(?n, 'en')) AS ?t) { ?k :n_name ?n }", "SELECT 'en' AS l, n_name AS t FROM nation"),
    "b11_uuid": ("SELECT (COUNT(DISTINCT ?u) AS ?n) (MIN(STRLEN(?v)) AS ?l) { ?o :o_orderstatus ?s BIND(UUID() AS ?u) BIND(STRUUID() AS ?v) }", "SELECT count(*) AS n, CAST(36 AS BIGINT) AS l FROM orders"),
    "b12_bnode": ("SELECT (COUNT(DISTINCT ?b) AS ?n) { ?k :n_name ?x BIND(BNODE() AS ?b) FILTER(isBLANK(?b)) }", "SELECT count(*) AS n FROM nation"),
    "b13_iri": ("SELECT (IRI(CONCAT('urn:x:', ?n)) AS ?i) (isIRI(URI(CONCAT('urn:x:', ?n))) AS ?k) { ?r :r_name ?n }", "SELECT 'urn:x:' || r_name AS i, true AS k FROM region"),
    "b30_rand": ("SELECT (COUNT(?o) AS ?n) { ?o :o_orderstatus ?s FILTER(RAND() >= 0 && RAND() < 1) }", "SELECT count(*) AS n FROM orders"),
    "b31_now": ("SELECT (COUNT(?o) AS ?n) { ?o :o_orderstatus ?s FILTER(NOW() = NOW() && YEAR(NOW()) > 2020) }", "SELECT count(*) AS n FROM orders"),
    "b33_minutes_seconds": ("SELECT ?m ?s (COUNT(?e) AS ?n) { ?e :ts ?t BIND(MINUTES(?t) AS ?m) BIND(FLOOR(SECONDS(?t)) AS ?s) } GROUP BY ?m ?s", "SELECT CAST(minute(ts) AS BIGINT) AS m, CAST(second(ts) AS BIGINT) AS s, count(*) AS n FROM events GROUP BY ALL"),
    "b36_sha1": ("SELECT ?n (SHA1(?n) AS ?h) { ?x :r_name ?n }", "SELECT r_name AS n, sha1(r_name) AS h FROM region"),
    "e1_string_length": ("SELECT ?n (fn:string-length(?n) AS ?l) (fn:lower-case(?n) AS ?w) (fn:substring(?n, 2, 3) AS ?s) { ?x :n_name ?n }", "SELECT n_name AS n, CAST(length(n_name) AS BIGINT) AS l, lower(n_name) AS w, substr(n_name, 2, 3) AS s FROM nation"),
    "e7_java_alias": ("SELECT ?n (<java:com.hp.hpl.jena.query.function.library.strlen>(?n) AS ?l) { ?x :n_name ?n }", "SELECT n_name AS n, CAST(length(n_name) AS BIGINT) AS l FROM nation"),
    "f8_code_points": ("SELECT ?n { ?x :r_name ?n FILTER(?n = '\\u0041SIA') }", "SELECT r_name AS n FROM region WHERE r_name = 'ASIA'"),
    "pf1_assign": ("SELECT ?x ?n { ?k :n_name ?n . ?x apf:assign ?k }", "SELECT 'urn:t:nation/' || n_nationkey AS x, n_name AS n FROM nation"),
    "pp9_distinct_path": ("SELECT ?r ?x { ?r DISTINCT(^:n_regionkey/:n_regionkey) ?x }", "SELECT DISTINCT 'urn:t:region/' || n_regionkey AS r, 'urn:t:region/' || n_regionkey AS x FROM nation"),
}

# name: (SPARQL, SQL) over the statements
STATEMENTS: dict[str, tuple[str, str]] = {
    "b4_is_literal": ("SELECT (COUNT(*) AS ?n) { ?s ?p ?o FILTER(isLITERAL(?o)) }", W + "SELECT count(*) AS n FROM t WHERE o_k = 3"),
    "b8_datatype": ("SELECT ?d (COUNT(*) AS ?n) { ?s v:price ?o BIND(DATATYPE(?o) AS ?d) } GROUP BY ?d", W + f"SELECT CASE WHEN lang <> '' THEN '{RDF}langString' WHEN dt = '' THEN '{XSD}string' ELSE dt END AS d, count(*) AS n FROM t WHERE p = 'urn:x:v/price' GROUP BY 1"),
    "o2_mixed_sort": ("SELECT ?o { ?s v:price ?o } ORDER BY ?o LIMIT 300", W + f"SELECT o FROM (SELECT o, {NUM} AS v FROM t WHERE p = 'urn:x:v/price') ORDER BY v IS NULL, v, o LIMIT 300"),
    "t2_prefix": ('SELECT ?s ?o { ?s txt:match (rdfs:label "^The" ?o) }', W + "SELECT s, o FROM t WHERE p = 'rdfs:label' AND o_k = 3 AND dt = '' AND starts_with(o, 'The')"),
    "t3_stem": ('SELECT ?s ?o { ?s txt:match (rdfs:label "Briefen/s"@de ?o) }', W + "SELECT s, o FROM t WHERE p = 'rdfs:label' AND o_k = 3 AND dt = '' AND (lower(lang) = 'de' OR lower(lang) LIKE 'de-%') AND list_contains(list_transform(regexp_split_to_array(lower(o), '[^\\p{L}\\p{N}]+'), lambda w: CASE WHEN length(w) >= 5 THEN regexp_replace(w, '(ern|em|en|er|es|e|n|s)$', '') ELSE w END), 'brief')"),
    "t4_or_groups": ('SELECT ?s ?o { ?s txt:match (rdfs:label "(mill OR museum/i) letters" ?o) }', W + "SELECT s, o FROM t WHERE p = 'rdfs:label' AND o_k = 3 AND dt = '' AND (list_contains(regexp_split_to_array(o, '[^\\p{L}\\p{N}]+'), 'mill') OR list_contains(regexp_split_to_array(lower(o), '[^\\p{L}\\p{N}]+'), 'museum')) AND list_contains(regexp_split_to_array(o, '[^\\p{L}\\p{N}]+'), 'letters')"),
    "t6_language": ('SELECT ?s ?o { ?s txt:match (rdfs:label "museum/i"@en ?o) }', W + "SELECT s, o FROM t WHERE p = 'rdfs:label' AND o_k = 3 AND dt = '' AND list_contains(regexp_split_to_array(lower(o), '[^\\p{L}\\p{N}]+'), 'museum') AND (lower(lang) = 'en' OR lower(lang) LIKE 'en-%')"),
}


def _with(spark: SparkSession, d: str, quads: DataFrame) -> Engine:
    """The statements and further quads."""
    g = statements(spark, d).graph
    return Engine(g.derive(g.quads.union(quads.select("s", "p", "o", "g", "g_line"))), PREFIXES)


def _facts(spark: SparkSession, facts: list[tuple]) -> DataFrame:
    return QuadGraph.from_triples(spark, facts).quads


def _quads(df: DataFrame, s, p, o) -> DataFrame:
    return df.select(s.alias("s"), p.alias("p"), o.alias("o"), F.lit(None).cast("string").alias("g"), F.lit(None).cast("bigint").alias("g_line"))


def _iri(c):
    return terms.struct(1, c)


def _all(spark: SparkSession, d: str) -> DataFrame:
    return all_triples(statements(spark, d).graph)


def _of_class(triples: DataFrame, cls: str) -> DataFrame:
    return triples.where((F.col("p") == "rdf:type") & (F.col("o.lex") == cls)).select(F.col("s").alias("n")).distinct()


# lists and containers: the lines of every order
def _lists(spark: SparkSession, d: str) -> Engine:
    from pyspark.sql.window import Window

    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")).alias("i"))
    lines = lines.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")))
    cell = lambda i: F.concat(F.lit("urn:l/"), F.col("l_orderkey").cast("string"), F.lit("/"), i.cast("string"))
    bag, part = _iri(F.concat(F.lit("urn:b/"), F.col("l_orderkey").cast("string"))), _iri(F.concat(F.lit("urn:t:part/"), F.col("l_partkey").cast("string")))
    rest = F.when(F.col("i") < F.col("n"), cell(F.col("i") + 1)).otherwise(RDF + "nil")
    quads = _quads(lines, _iri(cell(F.col("i"))), F.lit(RDF + "first"), part).union(_quads(lines, _iri(cell(F.col("i"))), F.lit(RDF + "rest"), _iri(rest)))
    quads = quads.union(_quads(lines, bag, F.concat(F.lit(RDF + "_"), F.col("i").cast("string")), part)).union(_quads(lines.where("i = 1"), bag, F.lit(RDF + "type"), _iri(F.lit(RDF + "Bag"))))
    return Engine(QuadGraph(quads), PREFIXES)


_LINES = "WITH x AS (SELECT l_orderkey AS k, l_partkey AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) "
LISTS: dict[str, tuple[str, str]] = {
    "pf2_list_member": ("SELECT ?l (COUNT(?x) AS ?n) { ?l rdf:first ?f . ?l list:member ?x } GROUP BY ?l", _LINES + "SELECT 'urn:l/' || a.k || '/' || a.i AS l, count(*) AS n FROM x a JOIN x b ON a.k = b.k AND b.i >= a.i GROUP BY a.k, a.i"),
    "pf3_container_member": ("SELECT ?b (COUNT(?x) AS ?n) { ?b rdfs:member ?x } GROUP BY ?b", _LINES + "SELECT 'urn:b/' || k AS b, count(*) AS n FROM x GROUP BY 1"),
    "pf4_bag": ("SELECT ?b ?x { ?b apf:bag ?x }", _LINES + "SELECT 'urn:b/' || k AS b, 'urn:t:part/' || q AS x FROM x"),
    "pf5_list_length": ("SELECT ?l ?n { ?l rdf:first ?f ; list:length ?n }", _LINES + "SELECT 'urn:l/' || k || '/' || i AS l, n - i + 1 AS n FROM x"),
    "pf6_list_index": ("SELECT ?l ?i ?x { ?l list:index (?i ?x) }", _LINES + "SELECT 'urn:l/' || a.k || '/' || a.i AS l, b.i - a.i AS i, 'urn:t:part/' || b.q AS x FROM x a JOIN x b ON a.k = b.k AND b.i >= a.i"),
    "f9_collections": ("SELECT ?l { ?l rdf:first ?x ; rdf:rest () }", _LINES + "SELECT 'urn:l/' || k || '/' || i AS l FROM x WHERE i = n"),
}


# statements about statements
def _reified(spark: SparkSession, d: str) -> DataFrame:
    made = _all(spark, d).where("p = 'urn:x:v/maker'")
    st = _iri(F.concat(F.lit("urn:st/"), F.col("s.lex"), F.lit("|"), F.col("o.lex")))
    parts = [("rdf:type", _iri(F.lit("rdf:Statement"))), ("rdf:subject", F.col("s")), ("rdf:predicate", _iri(F.col("p"))), ("rdf:object", F.col("o")), ("urn:by", _iri(F.lit("urn:me")))]
    out = None
    for p, o in parts:
        q = _quads(made, st, F.lit(p), o)
        out = q if out is None else out.union(q)
    return out


def j13_reified(spark: SparkSession, d: str) -> DataFrame:
    return _with(spark, d, _reified(spark, d)).serql("SELECT S, O, B FROM {{S} v:maker {O}} <urn:by> {B}", entail="none")


def g3_reifications(spark: SparkSession, d: str) -> DataFrame:
    t_ = all_triples(_with(spark, d, _reified(spark, d)).graph)
    return _flat(graphlib.with_reifications(t_, t_.where("p = 'urn:x:v/maker'"), _E))


# path-expression queries
def l2_serql_construct(spark: SparkSession, d: str) -> DataFrame:
    return _flat(statements(spark, d).serql("CONSTRUCT {O} v:made {S} FROM {S} v:maker {O}", entail="none"))


def l5_serql_functions(spark: SparkSession, d: str) -> DataFrame:
    return statements(spark, d).serql("SELECT S, label(L) AS T, lang(L) AS G FROM {S} rdfs:label {L} WHERE isLiteral(L)", entail="none")


def l6_serql_comparison(spark: SparkSession, d: str) -> DataFrame:
    return statements(spark, d).serql("SELECT S, P FROM {S} v:price {P} WHERE P > 900 AND NOT P >= 950", entail="none")


def l7_direct(spark: SparkSession, d: str) -> DataFrame:
    return statements(spark, d).serql("SELECT S, O FROM {S} serql:directSubClassOf {O}", entail="rdfslite")


def p5_serql_projection(spark: SparkSession, d: str) -> DataFrame:
    return statements(spark, d).serql("SELECT DISTINCT O AS Maker FROM {S} v:maker {O} WHERE S != O", entail="none")


# entailment
_DOMAINS = [("urn:x:v/maker", "rdfs:domain", "urn:x:c/Made"), ("urn:x:v/maker", "rdfs:range", "urn:x:c/Maker")]


def r4_rdfs_types(spark: SparkSession, d: str) -> DataFrame:
    return _with(spark, d, _facts(spark, _DOMAINS)).sparql("SELECT ?c (COUNT(DISTINCT ?s) AS ?n) { ?s a ?c } GROUP BY ?c", entail="rdfs")


def r5_skosxl(spark: SparkSession, d: str) -> DataFrame:
    named = _all(spark, d).where("p = 'rdfs:label' AND o.k = 3")
    label = _iri(F.concat(F.lit("urn:xl/"), F.col("s.lex"), F.lit("/"), F.md5(F.concat("o.lex", F.lit("@"), "o.lang", F.lit("^"), "o.dt"))))
    xl = _quads(named, F.col("s"), F.lit(entailment.SKOSXL + "prefLabel"), label).union(_quads(named, label, F.lit(entailment.SKOSXL + "literalForm"), F.col("o")))
    return _with(spark, d, xl).sparql("SELECT ?s ?l { ?s skos:prefLabel ?l }", entail="skosxl")


def r6_own_regime(spark: SparkSession, d: str) -> DataFrame:
    @entailment.regime("inverse-makers")
    def inverse(graph: QuadGraph) -> QuadGraph:
        made = graph.quads.where("p = 'urn:x:v/maker' AND o.k < 3")
        return graph.derive(graph.quads.union(made.select(F.col("o").alias("s"), F.lit("urn:x:v/made").alias("p"), F.col("s").alias("o"), "g", "g_line")))

    return statements(spark, d).sparql("SELECT ?s (COUNT(?o) AS ?n) { ?s v:made ?o } GROUP BY ?s", entail="inverse-makers")


# OWL: the schema is given, the instances are the statements
_OWL = [
    ("_:thing", "owl:onProperty", "urn:x:v/maker"), ("_:thing", "owl:someValuesFrom", "owl:Thing"),
    ("_:topic", "owl:onProperty", "urn:x:v/subject"), ("_:topic", "owl:hasValue", "urn:x:topic/001"),
    ("_:topic2", "owl:onProperty", "urn:x:v/subject"), ("_:topic2", "owl:hasValue", "urn:x:topic/002"),
    ("_:two", "owl:onProperty", "urn:x:v/maker"), ("_:two", "owl:minCardinality", "2"), ("_:all", "owl:onProperty", "skos:related"), ("_:all", "owl:allValuesFrom", "urn:x:c/Item"),
    ("urn:K", "rdfs:subClassOf", "_:topic"), ("urn:K", "rdfs:subClassOf", "_:topic2"),
    ("_:u", "owl:unionOf", "_:l1"), ("_:l1", "rdf:first", "urn:x:c/Place"), ("_:l1", "rdf:rest", "_:l2"), ("_:l2", "rdf:first", "_:two"), ("_:l2", "rdf:rest", "rdf:nil"),
    ("_:not", "owl:complementOf", "_:u"), ("_:one", "owl:oneOf", "_:o1"), ("_:o1", "rdf:first", "urn:x:topic/001"), ("_:o1", "rdf:rest", "rdf:nil"),
    ("urn:x:c/Map", "rdfs:subClassOf", "urn:x:c/Flat"), ("urn:x:c/Print", "rdfs:subClassOf", "urn:x:c/Flat"), ("urn:x:v/hasPart", "owl:inverseOf", "urn:x:v/partOf"),
]


def _owl(spark: SparkSession) -> owl.Schema:
    return owl.read_schema(all_triples(QuadGraph(_facts(spark, _OWL))), _E)


def _who(df: DataFrame) -> DataFrame:
    return df.select(F.col("n.lex").alias("n"), F.col("n.k").alias("k"))


def _satisfying(cls: str):
    return lambda spark, d: _who(owl.satisfies(_all(spark, d), _owl(spark), cls))


def w2_merged_restriction(spark: SparkSession, d: str) -> DataFrame:
    sc = _owl(spark)
    return _who(owl.satisfies_restriction(_all(spark, d), sc, owl.merged_restriction(sc, "urn:K", "urn:x:v/subject")))


def w4_satisfies_restriction(spark: SparkSession, d: str) -> DataFrame:
    sc = _owl(spark)
    return _who(owl.satisfies_restriction(_all(spark, d), sc, owl.restriction(sc, "_:two")))


def w8_has(spark: SparkSession, d: str) -> DataFrame:
    t_ = _all(spark, d).where("p <> 'owl:sameAs'")
    return owl.has(t_, _owl(spark), "urn:x:v/hasPart", _E).select(F.col("s.lex").alias("s"), F.col("o.lex").alias("o"))


def w10_rules(spark: SparkSession, d: str) -> DataFrame:
    e = owl.apply_rules(statements(spark, d), [("?x v:maker ?y", "?y v:made ?x"), ("?y v:made ?x . ?x a c:Place", "?y v:builtAt ?x")])
    return e.sparql("SELECT ?p (COUNT(*) AS ?n) { ?s ?p ?o FILTER(?p IN (v:made, v:builtAt)) } GROUP BY ?p")


def w12_find(spark: SparkSession, d: str) -> DataFrame:
    return _who(owl.find(_all(spark, d), _owl(spark), "mill", "word", "urn:x:c/Item"))


# graph library
def g1_cbd(spark: SparkSession, d: str) -> DataFrame:
    t_ = _all(spark, d)
    return _flat(graphlib.cbd(t_, _of_class(t_, "urn:x:c/Place")))


def g2_graph_cbd(spark: SparkSession, d: str) -> DataFrame:
    t_ = _all(spark, d)
    return _flat(graphlib.graph_cbd(t_, t_.where("p = 'skos:related'")))


def g4_with_labels(spark: SparkSession, d: str) -> DataFrame:
    t_ = _all(spark, d)
    return _flat(graphlib.with_labels(t_, t_.where("p = 'skos:related'"), _E))


def g6_bagify(spark: SparkSession, d: str) -> DataFrame:
    members = graphlib.bagify(_all(spark, d), _E)[1]
    return members.select(F.col("bag.lex").alias("bag"), F.col("member.lex").alias("member"))


def g7_merge_properties(spark: SparkSession, d: str) -> DataFrame:
    links = [(p, "rdfs:subPropertyOf", "urn:x:v/link") for p in ("skos:related", "skos:broader", "skos:narrower", "rdfs:seeAlso", "urn:x:v/subject", "urn:x:v/maker")]
    return _flat(graphlib.merge_properties(_all(spark, d), all_triples(QuadGraph(_facts(spark, links))), _E))


def g10_resources(spark: SparkSession, d: str) -> DataFrame:
    return _who(graphlib.resources(_all(spark, d)))


def g12_smash(spark: SparkSession, d: str) -> DataFrame:
    """Without the numbers of the members, whose order is free: those are counted per bag."""
    out = graphlib.smash(_all(spark, d), _E)
    number = F.col("p").startswith("rdf:_")
    return _flat(out.where(~number)).union(out.where(number).groupBy(F.col("s.lex").alias("s")).agg(F.lit("members").alias("p"), F.count(F.lit(1)).cast("string").alias("o")))


def g13_combine_bags(spark: SparkSession, d: str) -> DataFrame:
    same = _all(spark, d).where("p = 'owl:sameAs'").select(F.col("s.lex").alias("bag"), F.col("o.lex").alias("member"))
    return graphlib.combine_bags(same)


def g14_blank_variables(spark: SparkSession, d: str) -> DataFrame:
    return _flat(graphlib.blank_variables(_all(spark, d)))


def g17_descriptions(spark: SparkSession, d: str) -> DataFrame:
    t_ = _all(spark, d)
    return graphlib.descriptions(t_, _of_class(t_, "urn:x:c/Item"), _E).select(F.col("n.lex").alias("n"), "description")


def g18_truncate(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d).where("p = 'rdfs:label'").select(F.col("s.lex").alias("s"), graphlib.truncate(F.col("o.lex"), 20).alias("label"))


def g19_context(spark: SparkSession, d: str) -> DataFrame:
    t_ = _all(spark, d)
    return _flat(graphlib.context(t_, _of_class(t_, "urn:x:c/Place"), ["skos:broader", "urn:x:v/partOf"], ["skos:related"], 3, names=_E))


def g20_path(spark: SparkSession, d: str) -> DataFrame:
    t_ = _all(spark, d)
    found = graphlib.path_from_named(t_, t_.where("o.k = 2").select(F.col("o").alias("n")).distinct())
    return found.select(F.col("n.lex").alias("n"), "steps")


def s21_extract_data(spark: SparkSession, d: str) -> DataFrame:
    facts = all_triples(QuadGraph(_facts(spark, [("urn:x:c/Place", "rdf:type", "rdfs:Class"), ("urn:x:c/Place", "rdfs:label", "urn:x")])))
    return _flat(graphlib.extract(_all(spark, d), schema_part=False, names=_E, inferred=facts))


# profiling
def q6_domains(spark: SparkSession, d: str) -> DataFrame:
    return profile.frequencies(statements(spark, d).graph.quads, "urn:x:v/maker", "domain", "rdf:type")


def q6_by_label(spark: SparkSession, d: str) -> DataFrame:
    return profile.frequencies(statements(spark, d).graph.quads, "urn:x:v/maker", "o", by_label=["rdfs:label"])


def q7_concepts(spark: SparkSession, d: str) -> DataFrame:
    return profile.concepts_of(statements(spark, d).graph.quads, "the letters of the mill", ["rdfs:label"])


def q8_description(spark: SparkSession, d: str) -> DataFrame:
    rows = profile.description(statements(spark, d).graph.quads, "urn:x:ent/1", ["rdf:type"])
    return rows.select("p", F.array_join("objects", "|").alias("objects"))


def q10_by_object(spark: SparkSession, d: str) -> DataFrame:
    rows = profile.triples_with_object(statements(spark, d).graph.quads, "urn:x:topic/001", by_label=["rdfs:label"])
    return rows.select(F.col("s.lex").alias("s"), "p", "label")


def q11_namespaces(spark: SparkSession, d: str) -> DataFrame:
    return profile.namespaces(statements(spark, d).graph.quads)


def o10_sorted_by_label(spark: SparkSession, d: str) -> DataFrame:
    q = statements(spark, d).graph.quads
    return profile.sorted_by_label(_of_class(q.select("s", "p", "o").distinct(), "urn:x:c/Place"), "n", q, ["rdfs:label"]).limit(40).select(F.col("n.lex").alias("n"), "label")


def o11_head_and_tail(spark: SparkSession, d: str) -> DataFrame:
    return profile.head_and_tail(table(spark, d, "orders").select("o_orderpriority", "o_orderkey"), "o_orderpriority", 30, 20)


def a17_answer_count(spark: SparkSession, d: str) -> DataFrame:
    return profile.answer_count(statements(spark, d).sparql("SELECT ?o { ?s v:subject ?o }"))


def a19_unique_solution(spark: SparkSession, d: str) -> DataFrame:
    return profile.unique_solution(star(spark, d).sparql("SELECT ?r { ?n :n_regionkey ?x . ?x :r_name ?r FILTER(?r = 'ASIA') }"))


# text
def t7_browse(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d).where("p = 'rdfs:label'").where(fulltext.browse("small museum -attic", F.col("o.lex"))).select(F.col("s.lex").alias("s"), F.col("o.lex").alias("o"))


def t9_token_index(spark: SparkSession, d: str) -> DataFrame:
    literals = table(spark, d, "literals")
    return fulltext.token_index(literals, "literal_id", "lex").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


# updates
def _after(request: str, question: str):
    return lambda spark, d: statements(spark, d).update(request).sparql(question)


_BY_GRAPH = "SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?s ?p ?o } FILTER(?g IN (<urn:x:g/set01>, <urn:x:g/set02>, <urn:g2>)) } GROUP BY ?g"


def u1_fresh_blank_nodes(spark: SparkSession, d: str) -> DataFrame:
    e = statements(spark, d)
    for _ in range(2):
        e = e.update("INSERT DATA { _:a v:seen 1 . _:a v:seen 2 }")
    return e.sparql("SELECT (COUNT(DISTINCT ?s) AS ?n) { ?s v:seen ?o }")


def u12_unload(spark: SparkSession, d: str) -> DataFrame:
    g = updates.clear(statements(spark, d).graph, "urn:x:g/main")
    return g.quads.groupBy("g").agg(F.count(F.lit(1)).alias("n"))


def u13_remove_uploaded(spark: SparkSession, d: str) -> DataFrame:
    g = statements(spark, d).graph
    return updates.remove_all(g, all_triples(g).where("p = 'urn:x:v/maker'")).quads.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def u17_history(spark: SparkSession, d: str) -> DataFrame:
    """Retract, assert and take back; the log tells the state between."""
    import datetime as dt

    at = lambda k: dt.datetime(2024, 1, k)
    tracked = updates.Tracked(statements(spark, d))
    one = tracked.update("DELETE { ?s v:maker ?o } INSERT { ?o v:made ?s } WHERE { ?s v:maker ?o }", "ann", at(1))
    two = one.update("DELETE WHERE { ?s v:made ?o }", "bob", at(2)).take_back(2, "ann", at(3))
    state = lambda k, until: updates.history(two.log, at(until)).groupBy("p").agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("k"), "p", "n")
    now = two.engine.graph.quads.where("p IN ('urn:x:v/made', 'urn:x:v/maker')").select("s", "p", "o", "g").distinct().groupBy("p").agg(F.count(F.lit(1)).alias("n")).select(F.lit("now").alias("k"), "p", "n")
    return state("first", 1).union(state("second", 2)).union(state("third", 3)).union(now)


# files
def _file(spark: SparkSession, name: str) -> str:
    spool = Spool(spark)
    return f"{spool.root}/{name}"


def _results(fmt: str, ending: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = statements(spark, d).sparql("SELECT ?s ?o { ?s rdfs:label ?o }", terms=True)
        path = _file(spark, f"r.{ending}")
        writers.write(df, path, fmt)
        back = readers.read_results(spark, path, fmt)
        return back.select(F.col("s.lex").alias("s"), F.col("o.lex").alias("o"), F.col("o.lang").alias("lang"))

    return run


def k3_csv(spark: SparkSession, d: str) -> DataFrame:
    path = _file(spark, "r.csv")
    writers.write(statements(spark, d).sparql("SELECT ?s ?o { ?s rdfs:label ?o }"), path, "csv")
    return readers.read_results(spark, path)


def _loaded(fmt: str, name: str, load: str | None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        t_ = _all(spark, d).where("p IN ('rdfs:label', 'skos:broader', 'urn:x:v/maker')").select("s", F.concat(F.lit("urn:full/"), F.element_at(F.split("p", "[:/]"), -1)).alias("p"), "o")
        path = _file(spark, name)
        writers.write(t_, path, fmt)
        back = all_triples(readers.load(spark, path, load))
        return back.where("s.k = 1 AND o.k <> 2").select(F.col("s.lex").alias("s"), "p", F.col("o.lex").alias("o"), F.col("o.lang").alias("lang"))

    return run


_LOADED = W + "SELECT s, 'urn:full/' || regexp_extract(p, '[^:/]*$') AS p, o, lang FROM t WHERE p IN ('rdfs:label', 'skos:broader', 'urn:x:v/maker') AND s_k = 1 AND o_k <> 2"


def s16_library(spark: SparkSession, d: str) -> DataFrame:
    t_ = _all(spark, d)
    paths = {}
    for name, p in (("urn:lib/a", "rdfs:subClassOf"), ("urn:lib/b", "skos:broader"), ("urn:lib/c", "skos:related")):
        paths[name] = _file(spark, "part.nt")
        writers.write(t_.where(F.col("p") == p), paths[name], "ntriples")
    lib = readers.Library({"urn:lib/a": (paths["urn:lib/a"], "ntriples", ["urn:lib/b"]), "urn:lib/b": (paths["urn:lib/b"], "ntriples", ["urn:lib/a"]), "urn:lib/c": (paths["urn:lib/c"], "ntriples", [])})
    return lib.load(spark, "urn:lib/a").quads.groupBy("g").agg(F.count(F.lit(1)).alias("n"))


def u9_load(spark: SparkSession, d: str) -> DataFrame:
    path = _file(spark, "made.nt")
    writers.write(_all(spark, d).where("p = 'urn:x:v/maker'").withColumn("p", F.lit("urn:x:v/copied")), path, "ntriples")
    e = statements(spark, d).update(f"LOAD <{path}> INTO GRAPH <urn:g9>")
    return e.sparql("SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?s v:copied ?o } } GROUP BY ?g")


def s20_store(spark: SparkSession, d: str) -> DataFrame:
    """Written once, then read by predicate."""
    g = statements(spark, d).graph.store(_file(spark, "store"))
    return Engine(g, PREFIXES).sparql("SELECT ?s ?l { ?s a c:Item ; rdfs:label ?l }")


def t1_indexed_match(spark: SparkSession, d: str) -> DataFrame:
    """Text search over a store's index of words."""
    g = statements(spark, d).graph.store(_file(spark, "store"))
    return Engine(g, PREFIXES).sparql('SELECT ?s ?o { ?s txt:match (rdfs:label "mill (letters OR museum)" ?o) }')


def s9_service(spark: SparkSession, d: str) -> DataFrame:
    e = Engine(star_schema(spark, d), PREFIXES, endpoints={"urn:ep": star_schema(spark, d)})
    return e.sparql("SELECT ?c ?name { ?c :c_mktsegment 'BUILDING' ; :c_nationkey ?n SERVICE <urn:ep> { ?n :n_name ?name } }")


FUNCTIONS = {f.__name__: f for f in (j13_reified, g3_reifications, l2_serql_construct, l5_serql_functions, l6_serql_comparison, l7_direct, p5_serql_projection, r4_rdfs_types, r5_skosxl, r6_own_regime, w2_merged_restriction, w4_satisfies_restriction, w8_has, w10_rules, w12_find, g1_cbd, g2_graph_cbd, g4_with_labels, g6_bagify, g7_merge_properties, g10_resources, g12_smash, g13_combine_bags, g14_blank_variables, g17_descriptions, g18_truncate, g19_context, g20_path, s21_extract_data, q6_domains, q6_by_label, q7_concepts, q8_description, q10_by_object, q11_namespaces, o10_sorted_by_label, o11_head_and_tail, a17_answer_count, a19_unique_solution, t7_browse, t9_token_index, u1_fresh_blank_nodes, u12_unload, u13_remove_uploaded, u17_history, k3_csv, s16_library, u9_load, s20_store, t1_indexed_match, s9_service)}
FUNCTIONS |= {
    "w1_has_value": _satisfying("_:topic"), "w5_description": _satisfying("_:not"), "w5_one_of": _satisfying("_:one"), "w6_satisfies": _satisfying("_:thing"), "w6_all_values": _satisfying("_:all"), "w7_individual_of": _satisfying("urn:x:c/Flat"),
    "u2_delete_data": _after("DELETE DATA { <urn:x:v/none> v:none 1 . GRAPH <urn:x:g/set01> { <urn:x:v/none> v:none 2 } }", "SELECT ?p (COUNT(*) AS ?n) { ?s ?p ?o } GROUP BY ?p"),
    "u5_using": _after("INSERT { GRAPH <urn:g2> { ?s v:copied ?o } } USING <urn:x:g/set01> WHERE { ?s v:subject ?o }", "SELECT (COUNT(*) AS ?n) { ?s v:copied ?o }"),
    "u6_add": _after("ADD <urn:x:g/set01> TO <urn:g2>", _BY_GRAPH), "u7_move": _after("MOVE <urn:x:g/set01> TO <urn:g2>", _BY_GRAPH), "u11_drop": _after("DROP GRAPH <urn:x:g/set01>", _BY_GRAPH),
    "k4_table_xml": _results("table-xml", "xml"), "k1_xml": _results("xml", "srx"), "k2_json": _results("json", "srj"), "k3_tsv": _results("tsv", "tsv"),
    "k6_turtle": _loaded("turtle-canonical", "g.nt", None), "k7_rdfxml": _loaded("rdfxml", "g.rdf", "rdfxml"), "s12_path_load": _loaded("ntriples", "g.nt", "ntriples"),
}

_LABELS = "SELECT s, o, lang FROM t WHERE p = 'rdfs:label'"
_DISTINCT_QUADS = "WITH q AS (SELECT DISTINCT s_k, s_lex, p_lex, o_k, o_lex, CASE WHEN o_dt = 'xsd:string' THEN '' ELSE coalesce(o_dt, '') END AS dt, coalesce(o_lang, '') AS lang, g_iri FROM rdf WHERE s_lex IS NOT NULL AND o_lex IS NOT NULL) "
_QUADS = "WITH q AS (SELECT * FROM rdf WHERE s_lex IS NOT NULL AND o_lex IS NOT NULL) "
_PLACES = "seeds AS (SELECT DISTINCT s_k AS k, s AS n FROM t WHERE p = 'rdf:type' AND o = 'urn:x:c/Place')"
_BLANKS = "reached AS (SELECT k, n FROM seeds UNION SELECT t.o_k, t.o FROM reached r JOIN t ON t.s = r.n AND t.s_k = r.k WHERE t.o_k = 2)"
_LABEL = "l AS (SELECT s_k, s, arg_min(o, (CASE WHEN lang = '' THEN 0 ELSE 1 END, o)) AS label FROM t WHERE p = 'rdfs:label' AND o_k = 3 GROUP BY 1, 2)"
_REST = "coalesce(label, regexp_extract({}, '([^/#:]*)$', 1))"
_UNION = W + ", k AS (SELECT s_k, s FROM t WHERE p = 'rdf:type' AND o = 'urn:x:c/Place' UNION SELECT s_k, s FROM t WHERE p = 'urn:x:v/maker' GROUP BY 1, 2 HAVING count(*) >= 2)"
_NODES = "(SELECT s_k AS k, s AS n FROM t UNION SELECT o_k, o FROM t WHERE o_k < 3)"
_MAPPED = "SELECT s, p, o FROM (SELECT DISTINCT CASE WHEN {a} IS NULL THEN t.s_k END AS sk, coalesce({a}, t.s) AS s, t.p, CASE WHEN {b} IS NULL THEN t.o_k END AS ok, coalesce({b}, t.o) AS o, dt, lang FROM t LEFT JOIN m x ON t.s_k = x.k AND t.s = x.n LEFT JOIN m y ON t.o_k = y.k AND t.o = y.n WHERE t.p <> 'owl:sameAs' AND (coalesce({a}, t.s) <> coalesce({b}, t.o) OR (t.s = t.o AND t.s_k = t.o_k)))"

FUNCTION_SQL = {
    "j13_reified": W + "SELECT s AS \"S\", o AS \"O\", 'urn:me' AS \"B\" FROM t WHERE p = 'urn:x:v/maker'",
    "g3_reifications": W + ", m AS (SELECT s, o, 'urn:st/' || s || '|' || o AS st FROM t WHERE p = 'urn:x:v/maker') SELECT s, 'urn:x:v/maker' AS p, o FROM m UNION ALL SELECT st, 'rdf:type', 'rdf:Statement' FROM m UNION ALL SELECT st, 'rdf:subject', s FROM m UNION ALL SELECT st, 'rdf:predicate', 'urn:x:v/maker' FROM m UNION ALL SELECT st, 'rdf:object', o FROM m UNION ALL SELECT st, 'urn:by', 'urn:me' FROM m",
    "l2_serql_construct": W + "SELECT o AS s, 'urn:x:v/made' AS p, s AS o FROM t WHERE p = 'urn:x:v/maker' AND o_k < 3",
    "l5_serql_functions": W + "SELECT s AS \"S\", o AS \"T\", lang AS \"G\" FROM t WHERE p = 'rdfs:label' AND o_k = 3",
    "l6_serql_comparison": W + f"SELECT s AS \"S\", o AS \"P\" FROM t WHERE p = 'urn:x:v/price' AND {NUM} > 900 AND NOT {NUM} >= 950",
    "l7_direct": W + "SELECT s AS \"S\", o AS \"O\" FROM t WHERE p = 'rdfs:subClassOf'",
    "p5_serql_projection": W + "SELECT DISTINCT o AS \"Maker\" FROM t WHERE p = 'urn:x:v/maker' AND s <> o",
    "r4_rdfs_types": WR + f"""f AS (SELECT * FROM t UNION ALL SELECT 1, s, p, 1, o, '', '' FROM (VALUES ('urn:x:v/maker', 'rdfs:domain', 'urn:x:c/Made'), ('urn:x:v/maker', 'rdfs:range', 'urn:x:c/Maker')) v(s, p, o)),
        e AS (SELECT DISTINCT s, o FROM t WHERE p = 'rdfs:subClassOf'), r AS (SELECT s, o FROM e UNION SELECT r.s, e.o FROM r JOIN e ON r.o = e.s),
        y AS (SELECT s_k, s, o AS c FROM f WHERE p = 'rdf:type' UNION SELECT s_k, s, 'urn:x:c/Made' FROM f WHERE p = 'urn:x:v/maker' UNION SELECT o_k, o, 'urn:x:c/Maker' FROM f WHERE p = 'urn:x:v/maker' AND o_k < 3 UNION SELECT 1, p, 'rdf:Property' FROM f),
        z AS (SELECT s_k, s, c FROM y UNION SELECT s_k, y.s, r.o FROM y JOIN r ON y.c = r.s UNION SELECT s_k, s, 'rdfs:Resource' FROM f UNION SELECT o_k, o, 'rdfs:Resource' FROM f WHERE o_k < 3)
        SELECT c, count(DISTINCT (s_k, s)) AS n FROM z GROUP BY 1""",
    "r5_skosxl": W + "SELECT s, o AS l FROM t WHERE p = 'rdfs:label' AND o_k = 3",
    "r6_own_regime": W + "SELECT o AS s, count(*) AS n FROM t WHERE p = 'urn:x:v/maker' AND o_k < 3 GROUP BY o_k, o",
    "w1_has_value": W + "SELECT DISTINCT s AS n, s_k AS k FROM t WHERE p = 'urn:x:v/subject' AND o = 'urn:x:topic/001' AND o_k = 1",
    "w2_merged_restriction": W + "SELECT s AS n, s_k AS k FROM t WHERE p = 'urn:x:v/subject' AND o = 'urn:x:topic/001' AND o_k = 1 INTERSECT SELECT s, s_k FROM t WHERE p = 'urn:x:v/subject' AND o = 'urn:x:topic/002' AND o_k = 1",
    "w4_satisfies_restriction": W + "SELECT s AS n, s_k AS k FROM t WHERE p = 'urn:x:v/maker' GROUP BY ALL HAVING count(*) >= 2",
    "w5_description": _UNION + f" SELECT n, k FROM {_NODES} WHERE (k, n) NOT IN (SELECT (s_k, s) FROM k)",
    "w5_one_of": W + f"SELECT n, k FROM {_NODES} WHERE n = 'urn:x:topic/001'",
    "w6_satisfies": W + "SELECT DISTINCT s AS n, s_k AS k FROM t WHERE p = 'urn:x:v/maker' AND o_k < 3",
    "w6_all_values": W + "SELECT DISTINCT s AS n, s_k AS k FROM t WHERE (s_k, s) NOT IN (SELECT (s_k, s) FROM t WHERE p = 'skos:related' AND (o_k, o) NOT IN (SELECT (s_k, s) FROM t WHERE p = 'rdf:type' AND o = 'urn:x:c/Item'))",
    "w7_individual_of": W + "SELECT DISTINCT s AS n, s_k AS k FROM t WHERE p = 'rdf:type' AND o IN ('urn:x:c/Map', 'urn:x:c/Print')",
    "w8_has": W + "SELECT s, o FROM (SELECT s_k, s, o_k, o FROM t WHERE p = 'urn:x:v/hasPart' UNION SELECT o_k, o, s_k, s FROM t WHERE p = 'urn:x:v/partOf' AND o_k < 3)",
    "w10_rules": W + ", m AS (SELECT DISTINCT o_k, o, s_k, s FROM t WHERE p = 'urn:x:v/maker' AND o_k < 3) SELECT 'urn:x:v/made' AS p, count(*) AS n FROM m UNION ALL SELECT 'urn:x:v/builtAt', count(*) FROM m WHERE (s_k, s) IN (SELECT (s_k, s) FROM t WHERE p = 'rdf:type' AND o = 'urn:x:c/Place') HAVING count(*) > 0",
    "w12_find": W + "SELECT DISTINCT s AS n, s_k AS k FROM t WHERE o_k = 3 AND list_contains(regexp_split_to_array(lower(o), '[^\\p{L}\\p{N}]+'), 'mill') AND (s_k, s) IN (SELECT (s_k, s) FROM t WHERE p = 'rdf:type' AND o = 'urn:x:c/Item')",
    "g1_cbd": WR + f"{_PLACES}, {_BLANKS} SELECT s, p, o FROM t WHERE (s_k, s) IN (SELECT (k, n) FROM reached)",
    "g2_graph_cbd": WR + f"seeds AS (SELECT s_k AS k, s AS n FROM t WHERE p = 'skos:related' UNION SELECT o_k, o FROM t WHERE p = 'skos:related' AND o_k < 3), {_BLANKS} SELECT s, p, o FROM t WHERE (s_k, s) IN (SELECT (k, n) FROM reached)",
    "g4_with_labels": W + ", n AS (SELECT s_k, s FROM t WHERE p = 'skos:related' UNION SELECT o_k, o FROM t WHERE p = 'skos:related' AND o_k < 3 UNION SELECT 1, 'skos:related') SELECT s, p, o FROM t WHERE p = 'skos:related' OR p IN ('rdfs:label', 'rdfs:comment', 'rdfs:seeAlso') AND (s_k, s) IN (SELECT (s_k, s) FROM n)",
    "g6_bagify": W + ", e AS (SELECT s_k AS k, s AS n, {'d': 'out', 'p': p, 'k': o_k, 'x': o, 'dt': dt, 'g': lang} AS e FROM t UNION SELECT o_k, o, {'d': 'in', 'p': p, 'k': s_k, 'x': s, 'dt': '', 'g': ''} FROM t WHERE o_k < 3), s AS (SELECT k, n, list_sort(list(e)) AS es FROM e GROUP BY k, n), b AS (SELECT es, min(n) AS first FROM s GROUP BY es HAVING count(*) > 1) SELECT '_:bag_' || substr(sha256(first), 1, 16) AS bag, n AS member FROM s JOIN b ON s.es = b.es",
    "g7_merge_properties": W + ", x AS (SELECT s_k, s, o_k, o, dt, lang, count(*) AS n, count(*) FILTER (p IN ('skos:related', 'skos:broader', 'skos:narrower', 'rdfs:seeAlso', 'urn:x:v/subject', 'urn:x:v/maker')) AS m FROM t GROUP BY ALL), b AS (SELECT * FROM x WHERE n > 1 AND n = m) SELECT s, 'urn:x:v/link' AS p, o FROM b UNION ALL SELECT s, p, o FROM t WHERE (s_k, s, o_k, o, dt, lang) NOT IN (SELECT (s_k, s, o_k, o, dt, lang) FROM b)",
    "g10_resources": W + "SELECT s AS n, s_k AS k FROM t UNION SELECT o, o_k FROM t WHERE o_k < 3 UNION SELECT p, 1 FROM t",
    "g12_smash": _COMP + ", c AS (SELECT a, least(a, min(b)) AS m FROM r GROUP BY a), m AS (SELECT a.k AS k, a.l AS n, '_:smash_' || substr(sha256(m.l), 1, 16) AS b FROM c) " + _MAPPED.format(a="x.b", b="y.b") + " UNION ALL SELECT b, 'members', CAST(count(*) AS VARCHAR) FROM m GROUP BY b",
    "g13_combine_bags": WR + "e AS (SELECT s AS a, o AS b FROM t WHERE p = 'owl:sameAs' UNION SELECT o, s FROM t WHERE p = 'owl:sameAs'), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT DISTINCT (SELECT least(t.s, min(b)) FROM r WHERE a = t.s) AS bag, o AS member FROM t WHERE p = 'owl:sameAs'",
    "g14_blank_variables": W + ", n AS (SELECT DISTINCT n FROM (SELECT s AS n FROM t WHERE s_k = 2 UNION SELECT o FROM t WHERE o_k = 2)), m AS (SELECT 2 AS k, n, '_:v' || row_number() OVER (ORDER BY n) AS b FROM n) SELECT coalesce(x.b, t.s) AS s, t.p, coalesce(y.b, t.o) AS o FROM t LEFT JOIN m x ON t.s_k = x.k AND t.s = x.n LEFT JOIN m y ON t.o_k = y.k AND t.o = y.n",
    "g17_descriptions": W + "SELECT s AS n, o AS description FROM t WHERE p = 'rdfs:comment' AND o_k = 3 AND (s_k, s) IN (SELECT (s_k, s) FROM t WHERE p = 'rdf:type' AND o = 'urn:x:c/Item')",
    "g18_truncate": W + "SELECT s, CASE WHEN length(o) > 20 THEN substr(o, 1, 19) || '…' ELSE o END AS label FROM t WHERE p = 'rdfs:label'",
    "g19_context": W + f", {_PLACES}, u AS (SELECT * FROM t WHERE p IN ('skos:broader', 'urn:x:v/partOf') AND o_k < 3), a AS (SELECT u.* FROM u JOIN seeds ON s_k = k AND s = n), b AS (SELECT * FROM u WHERE (s_k, s) IN (SELECT (o_k, o) FROM a)), c AS (SELECT * FROM u WHERE (s_k, s) IN (SELECT (o_k, o) FROM b)), f AS (SELECT * FROM a UNION SELECT * FROM b UNION SELECT * FROM c UNION SELECT t.* FROM t JOIN seeds ON s_k = k AND s = n WHERE p = 'skos:related') SELECT s, p, o FROM f",
    "g20_path": WR + "w AS (SELECT DISTINCT o AS n, s_k AS k, s AS at, 1 AS steps FROM t WHERE o_k = 2 UNION SELECT w.n, t.s_k, t.s, w.steps + 1 FROM w JOIN t ON t.o = w.at AND t.o_k = 2 WHERE w.k = 2 AND w.steps < 60) SELECT n, min(steps) AS steps FROM w WHERE k = 1 GROUP BY n",
    "s21_extract_data": W + "SELECT s, p, o FROM t WHERE s <> 'urn:x:c/Place'",
    "q6_domains": W + "SELECT y.o AS value, count(*) AS n FROM (SELECT * FROM t WHERE p = 'urn:x:v/maker') x JOIN (SELECT DISTINCT s_k, s, o_k, o FROM t WHERE p = 'rdf:type') y ON x.s = y.s AND x.s_k = y.s_k GROUP BY y.o_k, y.o",
    "q6_by_label": W + f", {_LABEL}, c AS (SELECT o_k, o, dt, lang, count(*) AS n FROM t WHERE p = 'urn:x:v/maker' GROUP BY ALL) SELECT c.o AS value, CASE WHEN c.o_k = 3 THEN c.o ELSE {_REST.format('c.o')} END AS label, n FROM c LEFT JOIN l ON c.o = l.s AND c.o_k = l.s_k",
    "q7_concepts": W + "SELECT DISTINCT s AS concept FROM t WHERE p = 'rdfs:label' AND o_k = 3 AND lower(o) = 'the letters of the mill'",
    "q8_description": W + "SELECT p, string_agg(DISTINCT o, '|' ORDER BY o) AS objects FROM t WHERE s = 'urn:x:ent/1' GROUP BY p",
    "q10_by_object": W + f", {_LABEL} SELECT t.s, t.p, {_REST.format('t.s')} AS label FROM t LEFT JOIN l ON t.s = l.s AND t.s_k = l.s_k WHERE t.o = 'urn:x:topic/001' AND t.o_k < 3",
    "q11_namespaces": _QUADS + "SELECT regexp_extract(p_lex, '^(.*[/#:])', 1) AS namespace, count(*) AS n FROM q GROUP BY 1",
    "o10_sorted_by_label": W + f", {_PLACES}, {_LABEL} SELECT n, {_REST.format('n')} AS label FROM seeds LEFT JOIN l ON s = n AND s_k = k ORDER BY lower({_REST.format('n')}), label, n LIMIT 40",
    "o11_head_and_tail": "(SELECT o_orderpriority, o_orderkey, 'top' AS part FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 30) UNION ALL (SELECT o_orderpriority, o_orderkey, 'bottom' AS part FROM orders ORDER BY o_orderpriority DESC, o_orderkey DESC LIMIT 20)",
    "a17_answer_count": W + "SELECT count(DISTINCT o) AS n FROM t WHERE p = 'urn:x:v/subject'",
    "a19_unique_solution": "SELECT DISTINCT r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
    "t7_browse": W + ", x AS (SELECT s, o, regexp_split_to_array(lower(o), '[^\\p{L}\\p{N}]+') AS w FROM t WHERE p = 'rdfs:label') SELECT s, o FROM x WHERE list_contains(w, 'small') AND list_contains(w, 'museum') AND NOT list_contains(w, 'attic')",
    "t9_token_index": "SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(regexp_split_to_array(lower(lex), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))) AS token FROM literals) GROUP BY 1",
    "u1_fresh_blank_nodes": "SELECT CAST(2 AS BIGINT) AS n",
    "u2_delete_data": W + "SELECT p, count(*) AS n FROM t GROUP BY 1",
    "u5_using": "SELECT count(*) AS n FROM (SELECT DISTINCT s_k, s_lex, o_k, o_lex FROM rdf WHERE s_lex IS NOT NULL AND o_lex IS NOT NULL AND p_lex = 'urn:x:v/subject' AND g_iri = 'urn:x:g/set01')",
    "u6_add": _DISTINCT_QUADS + "SELECT g, count(*) AS n FROM (SELECT g_iri AS g FROM q WHERE g_iri IN ('urn:x:g/set01', 'urn:x:g/set02') UNION ALL SELECT 'urn:g2' FROM q WHERE g_iri = 'urn:x:g/set01') GROUP BY 1",
    "u7_move": _DISTINCT_QUADS + "SELECT CASE g_iri WHEN 'urn:x:g/set01' THEN 'urn:g2' ELSE g_iri END AS g, count(*) AS n FROM q WHERE g_iri IN ('urn:x:g/set01', 'urn:x:g/set02') GROUP BY 1",
    "u11_drop": _DISTINCT_QUADS + "SELECT g_iri AS g, count(*) AS n FROM q WHERE g_iri = 'urn:x:g/set02' GROUP BY 1",
    "u12_unload": _QUADS + "SELECT g_iri AS g, count(*) AS n FROM q WHERE g_iri IS NULL OR g_iri <> 'urn:x:g/main' GROUP BY 1",
    "u13_remove_uploaded": _QUADS + "SELECT p_lex AS p, count(*) AS n FROM q WHERE p_lex <> 'urn:x:v/maker' GROUP BY 1",
    "u17_history": W + ", m AS (SELECT count(*) AS n FROM t WHERE p = 'urn:x:v/maker' AND o_k < 3) SELECT k, 'urn:x:v/made' AS p, n FROM m, (VALUES ('first'), ('third'), ('now')) v(k)",
    "k3_csv": W + "SELECT s, o FROM t WHERE p = 'rdfs:label'",
    "k1_xml": W + _LABELS, "k4_table_xml": W + _LABELS, "k2_json": W + _LABELS, "k3_tsv": W + _LABELS,
    "k6_turtle": _LOADED, "k7_rdfxml": _LOADED, "s12_path_load": _LOADED,
    "s16_library": W + "SELECT CASE p WHEN 'rdfs:subClassOf' THEN 'urn:lib/a' ELSE 'urn:lib/b' END AS g, count(*) AS n FROM t WHERE p IN ('rdfs:subClassOf', 'skos:broader') GROUP BY 1",
    "u9_load": W + "SELECT 'urn:g9' AS g, count(*) AS n FROM t WHERE p = 'urn:x:v/maker'",
    "s20_store": W + "SELECT a.s, b.o AS l FROM t a JOIN t b ON a.s = b.s AND a.s_k = b.s_k WHERE a.p = 'rdf:type' AND a.o = 'urn:x:c/Item' AND a.o_k < 3 AND b.p = 'rdfs:label'",
    "t1_indexed_match": W + ", x AS (SELECT s, o, regexp_split_to_array(o, '[^\\p{L}\\p{N}]+') AS w FROM t WHERE p = 'rdfs:label' AND o_k = 3 AND dt = '') SELECT s, o FROM x WHERE list_contains(w, 'mill') AND (list_contains(w, 'letters') OR list_contains(w, 'museum'))",
    "s9_service": "SELECT 'urn:t:customer/' || c_custkey AS c, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'",
}


def _asked(text: str, make):
    return lambda spark, d: make(spark, d).sparql(text)


def queries() -> dict:
    out = {n: _asked(q, star) for n, (q, _) in STAR.items()}
    out |= {n: _asked(q, statements) for n, (q, _) in STATEMENTS.items()}
    out |= {n: _asked(q, _lists) for n, (q, _) in LISTS.items()}
    return out | FUNCTIONS


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in (STAR | STATEMENTS | LISTS).items()} | FUNCTION_SQL
