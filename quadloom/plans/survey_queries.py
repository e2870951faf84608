"""Queries over the test tables for each family of operators, with their SQL. Star schema: prefix ':' is urn:t:; statements: v: is urn:x:v/."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.engine import Engine, all_triples
from quadloom.operators import fulltext, graphlib, owl, profile
from quadloom.plans import updates
from quadloom.plans.algebra import OWL, RDF, RDFS, Iri
from quadloom.runtime import table
from quadloom.sources.graphs import QuadGraph, star_schema

PREFIXES = {"": "urn:t:", "v": "urn:x:v/", "c": "urn:x:c/"}


def star(spark: SparkSession, d: str) -> Engine:
    return Engine(star_schema(spark, d), PREFIXES)


def statements(spark: SparkSession, d: str) -> Engine:
    return Engine(QuadGraph.from_statements(table(spark, d, "rdf")), PREFIXES)


T = """t AS (SELECT DISTINCT s_k, s_lex AS s, p_lex AS p, o_k, o_lex AS o, CASE WHEN o_dt = 'xsd:string' THEN '' ELSE coalesce(o_dt, '') END AS dt, coalesce(o_lang, '') AS lang
    FROM rdf WHERE s_lex IS NOT NULL AND p_lex IS NOT NULL AND o_lex IS NOT NULL)"""
W = f"WITH {T} "
WR = f"WITH RECURSIVE {T}, "
NUM = "CASE WHEN dt IN ('xsd:integer','xsd:decimal','xsd:double') THEN TRY_CAST(trim(o) AS DOUBLE) END"

# name: (SPARQL, SQL) over the star schema
STAR: dict[str, tuple[str, str]] = {
    "s1_scan_predicate": ("SELECT ?x ?name { ?x :n_name ?name }", "SELECT 'urn:t:nation/' || n_nationkey AS x, n_name AS name FROM nation"),
    "s2_graph_variable": ("SELECT ?g (COUNT(?s) AS ?n) { GRAPH ?g { ?s a ?c } } GROUP BY ?g", " UNION ALL ".join(f"SELECT 'urn:t:g/{t}' AS g, count(*) AS n FROM {t}" for t in "region nation customer supplier part orders lineitem events documents embeddings".split())),
    "s2_graph_constant": ("SELECT ?p (COUNT(*) AS ?n) { GRAPH <urn:t:g/region> { ?s ?p ?o } } GROUP BY ?p", f"SELECT p, CAST(n AS BIGINT) AS n FROM (VALUES ('urn:t:r_name', 5), ('{RDF}type', 5)) v(p, n)"),
    "s3_plain_literal": ('SELECT ?c { ?c :c_mktsegment "BUILDING" }', "SELECT 'urn:t:customer/' || c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "s7_values_one": ('SELECT ?n ?k { VALUES ?n { "NATION_1" "NATION_2" "none" } ?k :n_name ?n }', "SELECT n_name AS n, 'urn:t:nation/' || n_nationkey AS k FROM nation WHERE n_name IN ('NATION_1','NATION_2')"),
    "s8_values_undef": ('SELECT ?s ?f ?o { VALUES (?s ?f) { ("F" 1) (UNDEF 2) } ?o :o_orderstatus ?s }', "SELECT o_orderstatus AS s, f, 'urn:t:orders/' || o_orderkey AS o FROM orders JOIN (VALUES ('F', '1'), (NULL, '2')) v(s, f) ON s IS NULL OR s = o_orderstatus"),
    "f1_select_star": ("SELECT * { ?r :r_name ?name }", "SELECT 'urn:t:region/' || r_regionkey AS r, r_name AS name FROM region"),
    "f3_ask": ('ASK { ?o :o_orderstatus "F" ; :o_totalprice ?p FILTER(?p > 1000) }', "SELECT count(*) > 0 AS answer FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000"),
    "f5_sub_select": (
        "SELECT ?c ?price { ?o :o_custkey ?c ; :o_totalprice ?price { SELECT ?c (MAX(?p) AS ?price) { ?x :o_custkey ?c ; :o_totalprice ?p } GROUP BY ?c } }",
        "SELECT 'urn:t:customer/' || o.o_custkey AS c, o_totalprice AS price FROM orders o JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY 1) x ON o.o_custkey = x.o_custkey AND o_totalprice = m",
    ),
    "f6_from": ("SELECT (COUNT(*) AS ?n) FROM <urn:t:g/nation> FROM <urn:t:g/region> { ?s ?p ?o }", "SELECT 3 * (SELECT count(*) FROM nation) + 2 * (SELECT count(*) FROM region) AS n"),
    "f9_blank_and_lists": ("SELECT ?q { [] :l_quantity ?q ; :l_orderkey [ :o_orderpriority '1-URGENT' ] }", "SELECT l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'"),
    "sel_p1_filter": ("SELECT ?o ?p { ?o :o_totalprice ?p FILTER(?p > 300000 && ?p < 400000) }", "SELECT 'urn:t:orders/' || o_orderkey AS o, o_totalprice AS p FROM orders WHERE o_totalprice > 300000 AND o_totalprice < 400000"),
    "sel_p3_bind": ("SELECT ?p ?v { ?p :p_retailprice ?x ; :p_size ?s BIND(ROUND(?x * ?s) AS ?v) }", "SELECT 'urn:t:part/' || p_partkey AS p, CAST(floor(p_retailprice * p_size + 0.5) AS BIGINT) AS v FROM part"),
    "sel_p6_not_exists": ("SELECT ?c { ?c a :Customer FILTER NOT EXISTS { ?o :o_custkey ?c } }", "SELECT 'urn:t:customer/' || c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "sel_p6_exists_or": (
        "SELECT ?c { ?c :c_acctbal ?b FILTER(?b < 0 || EXISTS { ?o :o_custkey ?c ; :o_orderstatus 'P' }) }",
        "SELECT 'urn:t:customer/' || c_custkey AS c FROM customer WHERE c_acctbal < 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    ),
    "sel_p7_in": ("SELECT ?e ?t { ?e :event_type ?t FILTER(?t IN ('click', 'error')) }", "SELECT 'urn:t:event/' || event_id AS e, event_type AS t FROM events WHERE event_type IN ('click','error')"),
    "sel_p7_not_in": ("SELECT (COUNT(?e) AS ?n) { ?e :event_type ?t FILTER(?t NOT IN ('click', 'error')) }", "SELECT count(*) AS n FROM events WHERE event_type NOT IN ('click','error')"),
    "j1_bgp_join": (
        "SELECT ?r (COUNT(?o) AS ?n) { ?o :o_custkey ?c . ?c :c_nationkey ?k . ?k :n_regionkey ?x . ?x :r_name ?r } GROUP BY ?r",
        "SELECT r_name AS r, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "j2_optional": (
        "SELECT ?c ?o { ?c :c_mktsegment 'MACHINERY' OPTIONAL { ?o :o_custkey ?c ; :o_totalprice ?p FILTER(?p > 200000) } }",
        "SELECT 'urn:t:customer/' || c_custkey AS c, 'urn:t:orders/' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 WHERE c_mktsegment = 'MACHINERY'",
    ),
    "j4_minus": ("SELECT ?s { ?s a :Supplier MINUS { ?s :s_acctbal ?b FILTER(?b < 5000) } }", "SELECT 'urn:t:supplier/' || s_suppkey AS s FROM supplier WHERE NOT s_acctbal < 5000"),
    "j6_theta": ("SELECT ?a ?b { ?a :r_name ?x . ?b :r_name ?y FILTER(?x < ?y) }", "SELECT 'urn:t:region/' || a.r_regionkey AS a, 'urn:t:region/' || b.r_regionkey AS b FROM region a JOIN region b ON a.r_name < b.r_name"),
    "j7_cartesian": ("SELECT ?a ?b { ?x :r_name ?a . ?y :n_name ?b }", "SELECT r_name AS a, n_name AS b FROM region, nation"),
    "j11_null_compatible": (
        "SELECT ?c ?o ?n { ?c :c_mktsegment 'AUTOMOBILE' OPTIONAL { ?o :o_custkey ?c ; :o_orderstatus 'P' } OPTIONAL { ?o :o_orderpriority ?n FILTER(?n = '1-URGENT') } FILTER(BOUND(?o)) }",
        """WITH a AS (SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE c_mktsegment = 'AUTOMOBILE'),
           u AS (SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT')
           SELECT 'urn:t:customer/' || c_custkey AS c, 'urn:t:orders/' || coalesce(a.o_orderkey, u.o_orderkey) AS o, o_orderpriority AS n FROM a LEFT JOIN u ON a.o_orderkey IS NULL OR a.o_orderkey = u.o_orderkey
           WHERE coalesce(a.o_orderkey, u.o_orderkey) IS NOT NULL""",
    ),
    "a1_global": ("SELECT (COUNT(*) AS ?n) (ROUND(SUM(?q)) AS ?s) (MIN(?q) AS ?lo) (MAX(?q) AS ?hi) { ?l :l_quantity ?q }", "SELECT count(*) AS n, CAST(floor(sum(l_quantity) + 0.5) AS BIGINT) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem"),
    "a3_group_expression": ("SELECT ?y (COUNT(?o) AS ?n) { ?o :o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY 1"),
    "a4_having": ("SELECT ?c (COUNT(?o) AS ?n) { ?o :o_custkey ?c } GROUP BY ?c HAVING (COUNT(?o) > 15)", "SELECT 'urn:t:customer/' || o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15"),
    "a7_count_distinct": ("SELECT ?f (COUNT(DISTINCT ?p) AS ?n) { ?l :l_returnflag ?f ; :l_partkey ?p } GROUP BY ?f", "SELECT l_returnflag AS f, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1"),
    "a10_avg": ("SELECT ?f (ROUND(AVG(?q) * 1000) AS ?m) { ?l :l_returnflag ?f ; :l_quantity ?q } GROUP BY ?f", "SELECT l_returnflag AS f, CAST(floor(avg(l_quantity) * 1000 + 0.5) AS BIGINT) AS m FROM lineitem GROUP BY 1"),
    "a12_group_concat": ("SELECT ?x (GROUP_CONCAT(DISTINCT ?n; separator='|') AS ?ns) { ?k :n_regionkey ?x ; :n_name ?n } GROUP BY ?x", "SELECT 'urn:t:region/' || n_regionkey AS x, string_agg(n_name, '|' ORDER BY n_name) AS ns FROM nation GROUP BY 1"),
    "a13_sum_distinct": ("SELECT (SUM(DISTINCT ?s) AS ?t) { ?p :p_size ?s }", "SELECT CAST(sum(DISTINCT p_size) AS BIGINT) AS t FROM part"),
    "a14_empty_group": ("SELECT (COUNT(?x) AS ?n) (SUM(?x) AS ?s) (AVG(?x) AS ?a) (MIN(?x) AS ?m) { ?p :p_size ?x FILTER(?x < 0) }", "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS s, CAST(0 AS DOUBLE) AS a, CAST(NULL AS INTEGER) AS m"),
    "a15_post_expression": ("SELECT ?s (COUNT(?o) + 1 AS ?n) { ?o :o_orderstatus ?s } GROUP BY ?s", "SELECT o_orderstatus AS s, count(*) + 1 AS n FROM orders GROUP BY 1"),
    "o1_top_k": ("SELECT ?o ?p { ?o :o_totalprice ?p } ORDER BY DESC(?p) ?o LIMIT 10", "SELECT 'urn:t:orders/' || o_orderkey AS o, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o LIMIT 10"),
    "o3_offset": ("SELECT ?c ?n { ?c :c_name ?n } ORDER BY ?n LIMIT 7 OFFSET 20", "SELECT 'urn:t:customer/' || c_custkey AS c, c_name AS n FROM customer ORDER BY n LIMIT 7 OFFSET 20"),
    "o5_distinct": ("SELECT DISTINCT ?b ?t { ?p :p_brand ?b ; :p_type ?t }", "SELECT DISTINCT p_brand AS b, p_type AS t FROM part"),
    "o7_union": ("SELECT ?n { { ?c :c_nationkey ?k } UNION { ?s :s_nationkey ?k } ?k :n_name ?n }", "SELECT n_name AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON k = n_nationkey"),
    "x6_arithmetic": ("SELECT ?l (ROUND(SUM(?p * (1 - ?d))) AS ?v) { ?x :l_linestatus ?l ; :l_extendedprice ?p ; :l_discount ?d } GROUP BY ?l", "SELECT l_linestatus AS l, CAST(floor(sum(l_extendedprice * (1 - l_discount)) + 0.5) AS BIGINT) AS v FROM lineitem GROUP BY 1"),
    "b14_if": ("SELECT ?k (COUNT(?o) AS ?n) { ?o :o_totalprice ?p BIND(IF(?p > 250000, 'big', 'small') AS ?k) } GROUP BY ?k", "SELECT CASE WHEN o_totalprice > 250000 THEN 'big' ELSE 'small' END AS k, count(*) AS n FROM orders GROUP BY 1"),
    "b15_coalesce": ("SELECT ?c (COALESCE(?s, 'none') AS ?x) { ?c :c_name ?n OPTIONAL { ?o :o_custkey ?c ; :o_orderstatus ?s FILTER(?s = 'P') } }", "SELECT 'urn:t:customer/' || c_custkey AS c, coalesce(o_orderstatus, 'none') AS x FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'"),
    "b17_strings": (
        "SELECT ?n (STRLEN(?n) AS ?l) (SUBSTR(?n, 2, 3) AS ?u) (UCASE(?n) AS ?up) (LCASE(?n) AS ?lo) (STRBEFORE(?n, '_') AS ?b) (STRAFTER(?n, '_') AS ?a) (CONCAT(?n, '-', ?n) AS ?cc) (ENCODE_FOR_URI(?n) AS ?e) { ?x :n_name ?n FILTER(STRSTARTS(?n, 'NA') && CONTAINS(?n, 'ION') && !STRENDS(?n, '3')) }",
        "SELECT n_name AS n, CAST(length(n_name) AS BIGINT) AS l, substr(n_name, 2, 3) AS u, upper(n_name) AS up, lower(n_name) AS lo, split_part(n_name, '_', 1) AS b, substr(n_name, strpos(n_name, '_') + 1) AS a, n_name || '-' || n_name AS cc, n_name AS e FROM nation WHERE n_name LIKE 'NA%' AND n_name LIKE '%ION%' AND n_name NOT LIKE '%3'",
    ),
    "b25_regex": ("SELECT ?n { ?x :n_name ?n FILTER REGEX(?n, '^nation_1[0-4]$', 'i') }", "SELECT n_name AS n FROM nation WHERE regexp_matches(n_name, '^NATION_1[0-4]$')"),
    "b26_replace": ("SELECT (REPLACE(?n, '[0-9]', '#') AS ?r) { ?x :n_name ?n }", "SELECT regexp_replace(n_name, '[0-9]', '#', 'g') AS r FROM nation"),
    "b27_numbers": ("SELECT ?p (ABS(0 - ?s) AS ?a) (CEIL(?x) AS ?c) (FLOOR(?x) AS ?f) (ROUND(?x) AS ?r) { ?p :p_size ?s ; :p_retailprice ?x }", "SELECT 'urn:t:part/' || p_partkey AS p, CAST(abs(0 - p_size) AS BIGINT) AS a, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(floor(p_retailprice + 0.5) AS BIGINT) AS r FROM part"),
    "b32_dates": (
        "SELECT ?y ?m ?d ?h (COUNT(?e) AS ?n) { ?e :ts ?t BIND(YEAR(?t) AS ?y) BIND(MONTH(?t) AS ?m) BIND(DAY(?t) AS ?d) BIND(HOURS(?t) AS ?h) } GROUP BY ?y ?m ?d ?h",
        "SELECT CAST(year(ts) AS BIGINT) AS y, CAST(month(ts) AS BIGINT) AS m, CAST(day(ts) AS BIGINT) AS d, CAST(hour(ts) AS BIGINT) AS h, count(*) AS n FROM events GROUP BY ALL",
    ),
    "b36_hashes": ("SELECT ?n (MD5(?n) AS ?m) (SHA256(?n) AS ?s) { ?x :r_name ?n }", "SELECT r_name AS n, md5(r_name) AS m, sha256(r_name) AS s FROM region"),
    "b37_casts": ("SELECT ?p (xsd:integer(?x) AS ?i) (xsd:string(?s) AS ?t) (xsd:boolean(?s) AS ?b) { ?p :p_retailprice ?x ; :p_size ?s }", "SELECT 'urn:t:part/' || p_partkey AS p, CAST(trunc(p_retailprice) AS BIGINT) AS i, CAST(p_size AS VARCHAR) AS t, p_size <> 0 AS b FROM part"),
    "e1_extension_functions": ("SELECT ?n (fn:upper-case(?n) AS ?u) (afn:substr(?n, 0, 3) AS ?s) (afn:localname(?x) AS ?l) (afn:namespace(?x) AS ?ns) (afn:sha1sum(?n) AS ?h) { ?x :r_name ?n }", "SELECT r_name AS n, upper(r_name) AS u, substr(r_name, 1, 3) AS s, CAST(r_regionkey AS VARCHAR) AS l, 'urn:t:region/' AS ns, sha1(r_name) AS h FROM region"),
    "pp2_sequence": ("SELECT ?o ?r { ?o :o_custkey/:c_nationkey/:n_regionkey/:r_name ?r FILTER(?r = 'ASIA') }", "SELECT 'urn:t:orders/' || o_orderkey AS o, r_name AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "pp3_inverse": ("SELECT ?r (COUNT(?n) AS ?k) { ?r ^:n_regionkey ?n } GROUP BY ?r", "SELECT 'urn:t:region/' || n_regionkey AS r, count(*) AS k FROM nation GROUP BY 1"),
    "flagship_nation_revenue": (
        "SELECT ?nation (COUNT(?o) AS ?orders) (ROUND(SUM(?price)) AS ?revenue) { ?o :o_custkey ?c ; :o_totalprice ?price ; :o_orderstatus 'F' . ?c :c_nationkey ?n . ?n :n_name ?nation } GROUP BY ?nation HAVING (COUNT(?o) > 10) ORDER BY DESC(?revenue)",
        "SELECT n_name AS nation, count(*) AS orders, CAST(floor(sum(o_totalprice) + 0.5) AS BIGINT) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) > 10",
    ),
}

# name: (SPARQL, SQL) over the statements
STATEMENTS: dict[str, tuple[str, str]] = {
    "q_a6_predicate_counts": ("SELECT ?p (COUNT(*) AS ?n) { ?s ?p ?o } GROUP BY ?p", W + "SELECT p, count(*) AS n FROM t GROUP BY 1"),
    "q_s2_graph_triples": ("SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g", "SELECT g_iri AS g, count(*) AS n FROM (SELECT DISTINCT s_k, s_lex, p_lex, o_k, o_lex, CASE WHEN o_dt = 'xsd:string' THEN '' ELSE coalesce(o_dt, '') END, coalesce(o_lang, ''), g_iri FROM rdf WHERE s_lex IS NOT NULL AND o_lex IS NOT NULL AND g_iri IS NOT NULL) GROUP BY 1"),
    "q_j1_item_labels": ("SELECT ?s ?l { ?s a c:Item ; rdfs:label ?l }", W + "SELECT a.s, b.o AS l FROM t a JOIN t b ON a.s = b.s AND a.s_k = b.s_k WHERE a.p = 'rdf:type' AND a.o = 'urn:x:c/Item' AND a.o_k < 3 AND b.p = 'rdfs:label'"),
    "q_j2_optional_comment": ("SELECT ?s ?o ?c { ?s v:maker ?o OPTIONAL { ?s rdfs:comment ?c } }", W + "SELECT a.s, a.o, b.o AS c FROM t a LEFT JOIN t b ON a.s = b.s AND a.s_k = b.s_k AND b.p = 'rdfs:comment' WHERE a.p = 'urn:x:v/maker'"),
    "q_j4_minus": ("SELECT DISTINCT ?s { ?s v:price ?p MINUS { ?s v:height ?h } }", W + "SELECT DISTINCT s FROM t a WHERE p = 'urn:x:v/price' AND NOT EXISTS (SELECT 1 FROM t b WHERE b.s = a.s AND b.s_k = a.s_k AND b.p = 'urn:x:v/height')"),
    "q_b4_kinds": ("SELECT ?k (COUNT(*) AS ?n) { ?s ?p ?o BIND(IF(isIRI(?o), 'iri', IF(isBLANK(?o), 'blank', 'literal')) AS ?k) } GROUP BY ?k", W + "SELECT CASE o_k WHEN 1 THEN 'iri' WHEN 2 THEN 'blank' ELSE 'literal' END AS k, count(*) AS n FROM t GROUP BY 1"),
    "q_b7_languages": ("SELECT ?g (COUNT(?l) AS ?n) { ?s rdfs:label ?l } GROUP BY (LANG(?l) AS ?g)", W + "SELECT lang AS g, count(*) AS n FROM t WHERE p = 'rdfs:label' GROUP BY 1"),
    "q_b24_langmatches": ("SELECT (COUNT(?l) AS ?n) { ?s rdfs:label ?l FILTER LANGMATCHES(LANG(?l), 'en') }", W + "SELECT count(*) AS n FROM t WHERE p = 'rdfs:label' AND (lower(lang) = 'en' OR lower(lang) LIKE 'en-%')"),
    "q_x5_numeric_filter": ("SELECT ?s ?o { ?s v:price ?o FILTER(?o > 900) }", W + f"SELECT s, o FROM t WHERE p = 'urn:x:v/price' AND {NUM} > 900"),
    "q_a9_min_max": ("SELECT (MIN(?o) AS ?lo) (MAX(?o) AS ?hi) { ?s v:copies ?o FILTER(isNUMERIC(?o)) }", W + f", n AS (SELECT o, {NUM} AS v FROM t WHERE p = 'urn:x:v/copies') SELECT (SELECT o FROM n WHERE v IS NOT NULL ORDER BY v, o LIMIT 1) AS lo, (SELECT o FROM n WHERE v IS NOT NULL ORDER BY v DESC, o DESC LIMIT 1) AS hi"),
    "q_pp1_variable_predicate": ("SELECT ?p (COUNT(DISTINCT ?s) AS ?n) { ?s a c:Place ; ?p ?o } GROUP BY ?p", W + "SELECT b.p, count(DISTINCT (b.s, b.s_k)) AS n FROM t a JOIN t b ON a.s = b.s AND a.s_k = b.s_k WHERE a.p = 'rdf:type' AND a.o = 'urn:x:c/Place' GROUP BY 1"),
    "q_pp4_alternative": ("SELECT ?s ?o { ?s skos:broader|v:partOf ?o }", W + "SELECT s, o FROM t WHERE p IN ('skos:broader','urn:x:v/partOf')"),
    "q_pp5_negated": ("SELECT (COUNT(*) AS ?n) { ?s !(rdf:type|rdfs:label|v:subject) ?o }", W + "SELECT count(*) AS n FROM (SELECT DISTINCT s_k, s, o_k, o, dt, lang FROM t WHERE p NOT IN ('rdf:type','rdfs:label','urn:x:v/subject'))"),
    "q_pp6_optional_step": ("SELECT (COUNT(*) AS ?n) { ?s skos:related? ?o }", W + "SELECT count(*) AS n FROM (SELECT s_k, s, o_k, o, dt, lang FROM t WHERE p = 'skos:related' UNION SELECT s_k, s, s_k, s, '', '' FROM t UNION SELECT o_k, o, o_k, o, '', '' FROM t WHERE o_k < 3)"),
    "q_pp8_plus": ("SELECT ?s ?o { ?s rdfs:subClassOf+ ?o }", WR + "e AS (SELECT DISTINCT s, o FROM t WHERE p = 'rdfs:subClassOf'), r AS (SELECT s, o FROM e UNION SELECT r.s, e.o FROM r JOIN e ON r.o = e.s) SELECT s, o FROM r"),
    "q_pp7_star_from": ("SELECT ?c (COUNT(?o) AS ?n) { ?c a c:Item . ?c skos:broader* ?o } GROUP BY ?c", WR + "e AS (SELECT DISTINCT s, o FROM t WHERE p = 'skos:broader'), i AS (SELECT DISTINCT s FROM t WHERE p = 'rdf:type' AND o = 'urn:x:c/Item'), r AS (SELECT s, s AS o FROM i UNION SELECT r.s, e.o FROM r JOIN e ON r.o = e.s) SELECT s AS c, count(*) AS n FROM r GROUP BY 1"),
    "q_t1_match": ('SELECT ?s ?o { ?s txt:match (rdfs:label "mill" ?o) }', W + "SELECT s, o FROM t WHERE p = 'rdfs:label' AND o_k = 3 AND dt = '' AND list_contains(regexp_split_to_array(o, '[^\\p{L}\\p{N}]+'), 'mill')"),
    "q_t3_prefix_and_not": ('SELECT ?s ?o { ?s txt:match (rdfs:label "draw* -attic/i" ?o) }', W + "SELECT s, o FROM t WHERE p = 'rdfs:label' AND o_k = 3 AND dt = '' AND len(list_filter(regexp_split_to_array(o, '[^\\p{L}\\p{N}]+'), lambda x: starts_with(x, 'draw'))) > 0 AND NOT list_contains(regexp_split_to_array(lower(o), '[^\\p{L}\\p{N}]+'), 'attic')"),
    "q_t5_range": ('SELECT ?s ?o { ?s txt:match (v:shelfMark "100..200" ?o) }', W + "SELECT s, o FROM t WHERE p = 'urn:x:v/shelfMark' AND o_k = 3 AND dt = '' AND len(list_filter(regexp_split_to_array(o, '[^\\p{L}\\p{N}]+'), lambda x: TRY_CAST(x AS DOUBLE) BETWEEN 100 AND 200)) > 0"),
}


def _sparql(text: str, make):
    return lambda spark, d: make(spark, d).sparql(text)


_E = lambda x: {RDF + "type": "rdf:type", RDFS + "label": "rdfs:label"}.get(x, x.replace(RDF, "rdf:").replace(RDFS, "rdfs:").replace(OWL, "owl:"))


def _flat(df: DataFrame) -> DataFrame:
    return df.select(F.col("s.lex").alias("s"), "p", F.col("o.lex").alias("o"))


# queries that are not one SPARQL text
def f2_construct(spark: SparkSession, d: str) -> DataFrame:
    return _flat(star(spark, d).sparql("CONSTRUCT { ?k :in ?r } WHERE { ?k :n_regionkey ?x . ?x :r_name ?r }"))


def f4_describe(spark: SparkSession, d: str) -> DataFrame:
    return _flat(statements(spark, d).sparql("DESCRIBE ?s { ?s a c:Place }"))


def s24_nodes(spark: SparkSession, d: str) -> DataFrame:
    return statements(spark, d).graph.nodes(None).select(F.col("n.lex").alias("node"), F.col("n.k").alias("k"))


def l1_serql_select(spark: SparkSession, d: str) -> DataFrame:
    return star(spark, d).serql('SELECT O, N FROM {O} t:o_custkey {C} t:c_nationkey {K} t:n_name {N} WHERE N LIKE "*_1*" USING NAMESPACE t = <urn:t:>', entail="none")


def l3_serql_optional(spark: SparkSession, d: str) -> DataFrame:
    return statements(spark, d).serql("SELECT S, O, C FROM {S} v:maker {O}; [rdfs:comment {C}]", entail="none")


def j12_serql_set_nodes(spark: SparkSession, d: str) -> DataFrame:
    return star(spark, d).serql("SELECT A, B, R FROM {A, B} t:n_regionkey {R} USING NAMESPACE t = <urn:t:>", entail="none")


def r3_subclass_types(spark: SparkSession, d: str) -> DataFrame:
    return statements(spark, d).sparql("SELECT ?c (COUNT(DISTINCT ?s) AS ?n) { ?s a ?c } GROUP BY ?c", entail="rdfslite")


def r2_properties(spark: SparkSession, d: str) -> DataFrame:
    return statements(spark, d).sparql("SELECT ?p { ?p a rdf:Property }", entail="rdf")


def u1_insert_delete(spark: SparkSession, d: str) -> DataFrame:
    e = statements(spark, d).update("DELETE { ?s v:maker ?o } INSERT { GRAPH <urn:g2> { ?o v:made ?s } } WHERE { ?s v:maker ?o }")
    return e.sparql("SELECT ?p (COUNT(*) AS ?n) { ?s ?p ?o } GROUP BY ?p")


def u6_copy_clear(spark: SparkSession, d: str) -> DataFrame:
    e = statements(spark, d).update("COPY <urn:x:g/set01> TO <urn:g2> ; CLEAR GRAPH <urn:x:g/set01> ; CREATE GRAPH <urn:g3>")
    return e.sparql("SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?s ?p ?o } FILTER(?g IN (<urn:x:g/set01>, <urn:g2>, <urn:x:g/set02>)) } GROUP BY ?g")


def u13_remove_matching(spark: SparkSession, d: str) -> DataFrame:
    g = updates.remove_matching(statements(spark, d).graph, p="urn:x:v/subject", o=Iri("urn:x:topic/001"))
    return g.quads.agg(F.count(F.lit(1)).alias("n"))


def u16_statistics(spark: SparkSession, d: str) -> DataFrame:
    e = statements(spark, d)
    return updates.statistics(e.graph, e.update("DELETE WHERE { ?s v:height ?o } ; INSERT DATA { <urn:n> v:height 3 }").graph)


def profile_graphs(spark: SparkSession, d: str) -> DataFrame:
    return profile.graphs(statements(spark, d).graph.quads)


def profile_graph_summary(spark: SparkSession, d: str) -> DataFrame:
    return profile.graph_summary(statements(spark, d).graph.quads, "rdf:type")


def profile_types(spark: SparkSession, d: str) -> DataFrame:
    return profile.types(statements(spark, d).graph.quads, "rdf:type", "rdfs:Resource")


def profile_instances(spark: SparkSession, d: str) -> DataFrame:
    return profile.instances(statements(spark, d).graph.quads, "urn:x:c/Item", "rdf:type")


def profile_predicates(spark: SparkSession, d: str) -> DataFrame:
    return profile.predicates(statements(spark, d).graph.quads, "rdf:type")


def profile_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return profile.frequencies(statements(spark, d).graph.quads, "urn:x:v/subject")


def profile_void(spark: SparkSession, d: str) -> DataFrame:
    return profile.void(statements(spark, d).graph.quads)


def profile_description(spark: SparkSession, d: str) -> DataFrame:
    rows = profile.list_triples(statements(spark, d).graph.quads, predicate="urn:x:v/maker", domain="urn:x:c/Item", type_p="rdf:type")
    return _flat(rows)


def a18_answer_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = star(spark, d).sparql("SELECT ?r ?n { ?k :n_regionkey/:r_name ?r ; :n_name ?n }")
    return profile.answer_pairs(pairs, "r", "n", 3, 2)


def t8_autocomplete(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.complete(all_triples(statements(spark, d).graph), "the l", ["rdfs:label"], 10)


def a20_token_frequencies(spark: SparkSession, d: str) -> DataFrame:
    labels = all_triples(statements(spark, d).graph).where("p = 'rdfs:label'").select(F.col("o.lex").alias("text"))
    return fulltext.token_frequencies(labels, "text")


def g5_merge_same_as(spark: SparkSession, d: str) -> DataFrame:
    t_ = all_triples(statements(spark, d).graph)
    return graphlib.merge_same_as(t_, _E).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def g8_abstract(spark: SparkSession, d: str) -> DataFrame:
    return _flat(graphlib.abstract(all_triples(statements(spark, d).graph), _E))


def g11_minimise(spark: SparkSession, d: str) -> DataFrame:
    t_ = all_triples(statements(spark, d).graph)
    facts = [(("urn:x:v/partOf"), OWL + "inverseOf", "urn:x:v/hasPart"), ("skos:related", RDF + "type", OWL + "SymmetricProperty")]
    schema = all_triples(QuadGraph.from_triples(spark, facts))
    return graphlib.minimise(t_, schema).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def g15_schema(spark: SparkSession, d: str) -> DataFrame:
    return _flat(graphlib.schema(all_triples(statements(spark, d).graph), _E))


def g16_labels(spark: SparkSession, d: str) -> DataFrame:
    t_ = all_triples(statements(spark, d).graph)
    nodes = t_.where("p = 'urn:x:v/maker'").select(F.col("o").alias("n")).distinct()
    return graphlib.labels(t_, nodes, "en", [RDFS + "label"], _E).select(F.col("n.lex").alias("node"), "label")


def w9_same_as(spark: SparkSession, d: str) -> DataFrame:
    return owl.same_as(all_triples(statements(spark, d).graph), _E).select(F.col("node.lex").alias("node"), F.col("component.lex").alias("component"))


def w11_direct_subclasses(spark: SparkSession, d: str) -> DataFrame:
    return owl.direct_subclasses(all_triples(statements(spark, d).graph), _E).select(F.col("s.lex").alias("s"), F.col("o.lex").alias("o"))


def w4_cardinality(spark: SparkSession, d: str) -> DataFrame:
    return owl.cardinalities(all_triples(statements(spark, d).graph), "urn:x:v/maker").where("n > 1").select(F.col("s.lex").alias("s"), "n")


def k8_rdf_json(spark: SparkSession, d: str) -> DataFrame:
    """The values are parsed back from the text."""
    from quadloom.sources.writers import rdf_json

    rows = rdf_json(all_triples(statements(spark, d).graph))
    kind = "map<string,array<struct<type:string,value:string,lang:string,datatype:string>>>"
    each = rows.select("subject", F.explode(F.from_json("json", kind)).alias("p", "vs")).select("subject", "p", F.explode("vs").alias("v"))
    return each.select("subject", "p", F.col("v.type").alias("type"), F.col("v.value").alias("value"), F.coalesce("v.lang", F.lit("")).alias("lang"))


def s14_ntriples_round_trip(spark: SparkSession, d: str) -> DataFrame:
    from quadloom.sources.readers import lines_to_quads
    from quadloom.sources.writers import ntriples_lines

    back = lines_to_quads(ntriples_lines(all_triples(statements(spark, d).graph)), "user")
    return back.select(F.col("s.lex").alias("s"), "p", F.col("o.k").alias("o_k"), F.col("o.lex").alias("o"), F.col("o.dt").alias("dt"), F.col("o.lang").alias("lang"))


FUNCTIONS = {f.__name__: f for f in (f2_construct, f4_describe, s24_nodes, l1_serql_select, l3_serql_optional, j12_serql_set_nodes, r2_properties, r3_subclass_types, u1_insert_delete, u6_copy_clear, u13_remove_matching, u16_statistics, profile_graphs, profile_graph_summary, profile_types, profile_instances, profile_predicates, profile_frequencies, profile_void, profile_description, a18_answer_pairs, t8_autocomplete, a20_token_frequencies, g5_merge_same_as, g8_abstract, g11_minimise, g15_schema, g16_labels, w4_cardinality, w9_same_as, w11_direct_subclasses, k8_rdf_json, s14_ntriples_round_trip)}

_COMP = WR + """e AS (SELECT DISTINCT {'k': s_k, 'l': s} AS a, {'k': o_k, 'l': o} AS b FROM t WHERE p = 'owl:sameAs' AND o_k < 3 UNION SELECT DISTINCT {'k': o_k, 'l': o}, {'k': s_k, 'l': s} FROM t WHERE p = 'owl:sameAs' AND o_k < 3),
    r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)"""

FUNCTION_SQL = {
    "f2_construct": "SELECT 'urn:t:nation/' || n_nationkey AS s, 'urn:t:in' AS p, r_name AS o FROM nation JOIN region ON n_regionkey = r_regionkey",
    "s24_nodes": W + "SELECT s AS node, s_k AS k FROM t UNION SELECT o, o_k FROM t WHERE o_k < 3",
    "l1_serql_select": "SELECT 'urn:t:orders/' || o_orderkey AS \"O\", n_name AS \"N\" FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name LIKE '%\\_1%' ESCAPE '\\'",
    "l3_serql_optional": W + "SELECT a.s AS \"S\", a.o AS \"O\", b.o AS \"C\" FROM t a LEFT JOIN t b ON a.s = b.s AND a.s_k = b.s_k AND b.p = 'rdfs:comment' WHERE a.p = 'urn:x:v/maker'",
    "j12_serql_set_nodes": "SELECT 'urn:t:nation/' || a.n_nationkey AS \"A\", 'urn:t:nation/' || b.n_nationkey AS \"B\", 'urn:t:region/' || a.n_regionkey AS \"R\" FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey",
    "r2_properties": W + "SELECT p FROM (SELECT DISTINCT p FROM t UNION SELECT s FROM t WHERE p = 'rdf:type' AND o = 'rdf:Property')",
    "r3_subclass_types": WR + "e AS (SELECT DISTINCT s, o FROM t WHERE p = 'rdfs:subClassOf'), r AS (SELECT s, o FROM e UNION SELECT r.s, e.o FROM r JOIN e ON r.o = e.s), y AS (SELECT s_k, s, o AS c FROM t WHERE p = 'rdf:type' UNION SELECT t.s_k, t.s, r.o FROM t JOIN r ON t.o = r.s WHERE t.p = 'rdf:type') SELECT c, count(DISTINCT (s_k, s)) AS n FROM y GROUP BY 1",
    "u1_insert_delete": W + "SELECT p, count(*) AS n FROM t WHERE p <> 'urn:x:v/maker' GROUP BY 1 UNION ALL SELECT 'urn:x:v/made', count(*) FROM t WHERE p = 'urn:x:v/maker' AND o_k < 3",
    "u6_copy_clear": "WITH q AS (SELECT DISTINCT s_k, s_lex, p_lex, o_k, o_lex, CASE WHEN o_dt = 'xsd:string' THEN '' ELSE coalesce(o_dt, '') END, coalesce(o_lang, ''), g_iri FROM rdf WHERE o_lex IS NOT NULL) SELECT CASE g_iri WHEN 'urn:x:g/set01' THEN 'urn:g2' ELSE g_iri END AS g, count(*) AS n FROM q WHERE g_iri IN ('urn:x:g/set01','urn:x:g/set02') GROUP BY 1",
    "u13_remove_matching": "SELECT count(*) AS n FROM rdf WHERE s_lex IS NOT NULL AND o_lex IS NOT NULL AND NOT (p_lex = 'urn:x:v/subject' AND o_lex = 'urn:x:topic/001' AND o_k = 1)",
    "u16_statistics": "WITH q AS (SELECT DISTINCT s_k, s_lex, o_k, o_lex, CASE WHEN o_dt = 'xsd:string' THEN '' ELSE coalesce(o_dt, '') END, coalesce(o_lang, ''), g_iri FROM rdf WHERE s_lex IS NOT NULL AND o_lex IS NOT NULL AND p_lex = 'urn:x:v/height') SELECT CAST(1 AS BIGINT) AS triples_added, count(*) AS triples_removed, count(DISTINCT (s_k, s_lex)) + 1 AS subjects_touched FROM q",
    "profile_graphs": "SELECT g_iri AS g, count(*) AS n_triples FROM rdf WHERE s_lex IS NOT NULL AND o_lex IS NOT NULL GROUP BY 1",
    "profile_graph_summary": "SELECT g_iri AS g, count(DISTINCT p_lex) AS n_predicates, count(DISTINCT (s_k, s_lex)) AS n_subjects, count(DISTINCT CASE WHEN s_k = 2 THEN s_lex END) AS n_blank, count(DISTINCT CASE WHEN p_lex = 'rdf:type' THEN o_lex END) AS n_types FROM rdf WHERE s_lex IS NOT NULL AND o_lex IS NOT NULL GROUP BY 1",
    "profile_types": W + ", k AS (SELECT DISTINCT s_k, s, o FROM t WHERE p = 'rdf:type') SELECT coalesce(o, 'rdfs:Resource') AS type, count(*) AS n_instances FROM (SELECT DISTINCT s_k, s FROM t) x LEFT JOIN k ON x.s = k.s AND x.s_k = k.s_k GROUP BY 1",
    "profile_instances": W + "SELECT s AS instance, count(DISTINCT p) AS n_properties FROM t WHERE (s_k, s) IN (SELECT (s_k, s) FROM t WHERE p = 'rdf:type' AND o = 'urn:x:c/Item') GROUP BY s_k, s",
    "profile_predicates": W + """, k AS (SELECT DISTINCT s_k, s, o AS c FROM t WHERE p = 'rdf:type'),
        b AS (SELECT p, count(*) AS n_triples, count(DISTINCT (s_k, s)) AS n_subjects, count(DISTINCT (o_k, o, dt, lang)) AS n_objects FROM t GROUP BY 1),
        d AS (SELECT p, count(DISTINCT c) AS n FROM t JOIN k ON t.s = k.s AND t.s_k = k.s_k GROUP BY 1), r AS (SELECT p, count(DISTINCT c) AS n FROM t JOIN k ON t.o = k.s AND t.o_k = k.s_k WHERE t.o_k < 3 GROUP BY 1)
        SELECT b.*, coalesce(d.n, 0) AS n_domains, coalesce(r.n, 0) AS n_ranges FROM b LEFT JOIN d ON b.p = d.p LEFT JOIN r ON b.p = r.p""",
    "profile_frequencies": W + "SELECT o AS value, count(*) AS n FROM t WHERE p = 'urn:x:v/subject' GROUP BY 1",
    "profile_void": "SELECT g_iri AS g, count(*) AS triples, count(DISTINCT (s_k, s_lex)) AS \"distinctSubjects\", count(DISTINCT p_lex) AS properties, count(DISTINCT (o_k, o_lex, CASE WHEN o_dt = 'xsd:string' THEN '' ELSE coalesce(o_dt, '') END, coalesce(o_lang, ''))) AS \"distinctObjects\" FROM rdf WHERE s_lex IS NOT NULL AND o_lex IS NOT NULL GROUP BY 1",
    "profile_description": W + "SELECT s, p, o FROM t WHERE p = 'urn:x:v/maker' AND (s_k, s) IN (SELECT (s_k, s) FROM t WHERE p = 'rdf:type' AND o = 'urn:x:c/Item')",
    "a18_answer_pairs": "SELECT r, n FROM (SELECT r_name AS r, n_name AS n, row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS i, dense_rank() OVER (ORDER BY r_name) AS k FROM nation JOIN region ON n_regionkey = r_regionkey) WHERE i <= 2 AND k <= 3",
    "t8_autocomplete": W + "SELECT o AS text, count(*) AS n, max(p = 'rdfs:label') AS label FROM t WHERE o_k = 3 AND starts_with(lower(o), 'the l') GROUP BY 1 ORDER BY label DESC, n DESC, text LIMIT 10",
    "a20_token_frequencies": W + "SELECT token, count(*) AS n FROM (SELECT lower(unnest(list_filter(regexp_split_to_array(o, '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))) AS token FROM t WHERE p = 'rdfs:label') GROUP BY 1",
    "g8_abstract": W + """, k AS (SELECT s_k, s, min(o) AS c FROM t WHERE p = 'rdf:type' AND o_k < 3 GROUP BY 1, 2),
        m AS (SELECT CASE WHEN a.c IS NULL THEN t.s_k ELSE 1 END AS sk, coalesce(a.c, t.s) AS s, t.p, CASE WHEN b.c IS NULL THEN t.o_k ELSE 1 END AS ok, coalesce(b.c, t.o) AS o, dt, lang, t.s = t.o AND t.s_k = t.o_k AS was
            FROM t LEFT JOIN k a ON t.s = a.s AND t.s_k = a.s_k LEFT JOIN k b ON t.o = b.s AND t.o_k = b.s_k WHERE NOT (t.p = 'rdf:type' AND t.o_k < 3))
        SELECT s, p, o FROM (SELECT DISTINCT sk, s, p, ok, o, dt, lang FROM m WHERE sk <> ok OR s <> o OR was)""",
    "g16_labels": W + ", n AS (SELECT DISTINCT o_k, o FROM t WHERE p = 'urn:x:v/maker'), l AS (SELECT s_k, s, arg_min(o, (CASE WHEN lower(lang) = 'en' THEN 0 WHEN lower(lang) LIKE 'en-%' THEN 1 WHEN lang = '' THEN 2 ELSE 3 END, o)) AS label FROM t WHERE p = 'rdfs:label' AND o_k = 3 GROUP BY 1, 2) SELECT n.o AS node, coalesce(label, CASE WHEN n.o_k = 3 THEN n.o ELSE regexp_extract(n.o, '([^/#:]*)$', 1) END) AS label FROM n LEFT JOIN l ON n.o = l.s AND n.o_k = l.s_k",
    "w4_cardinality": W + "SELECT s, count(*) AS n FROM t WHERE p = 'urn:x:v/maker' GROUP BY s_k, s HAVING count(*) > 1",
    "w9_same_as": _COMP + " SELECT a.l AS node, least(a, min(b)).l AS component FROM r GROUP BY a",
    "w11_direct_subclasses": WR + "e AS (SELECT DISTINCT s, o FROM t WHERE p = 'rdfs:subClassOf' AND s <> o), f AS (SELECT e.s, x.o FROM e JOIN e x ON e.o = x.s UNION SELECT f.s, e.o FROM f JOIN e ON f.o = e.s) SELECT s, o FROM e WHERE (s, o) NOT IN (SELECT (s, o) FROM f)",
    "k8_rdf_json": W + "SELECT s AS subject, p, CASE o_k WHEN 1 THEN 'uri' WHEN 2 THEN 'bnode' ELSE 'literal' END AS type, o AS value, lang FROM t",
    "f4_describe": WR + "seeds AS (SELECT DISTINCT s_k AS k, s AS n FROM t WHERE p = 'rdf:type' AND o = 'urn:x:c/Place'), reached AS (SELECT k, n FROM seeds UNION SELECT t.o_k, t.o FROM reached r JOIN t ON t.s = r.n AND t.s_k = r.k WHERE t.o_k = 2) SELECT s, p, o FROM t WHERE (s_k, s) IN (SELECT (k, n) FROM reached)",
    "g5_merge_same_as": _COMP + """, c AS (SELECT a, least(a, min(b)) AS m FROM r GROUP BY a),
        d AS (SELECT k, l, least(count(*), 100) AS n FROM (SELECT s_k AS k, s AS l FROM t UNION ALL SELECT o_k, o FROM t WHERE o_k < 3) GROUP BY ALL),
        best AS (SELECT m, arg_min(a, (a.k, -coalesce(n, 0), a.l)) AS b FROM c LEFT JOIN d ON d.k = c.a.k AND d.l = c.a.l GROUP BY m), mp AS (SELECT a, b FROM c JOIN best ON c.m = best.m WHERE a <> b),
        x AS (SELECT DISTINCT coalesce(u.b, {'k': s_k, 'l': s}) AS s, p, coalesce(v.b, {'k': o_k, 'l': o}) AS o, dt, lang, s = o AND s_k = o_k AS was FROM t LEFT JOIN mp u ON u.a.k = s_k AND u.a.l = s LEFT JOIN mp v ON v.a.k = o_k AND v.a.l = o WHERE p <> 'owl:sameAs')
        SELECT p, count(*) AS n FROM (SELECT DISTINCT s, p, o, dt, lang FROM x WHERE s <> o OR was) GROUP BY p""",
    "g11_minimise": W + "SELECT p, count(*) AS n FROM t a WHERE NOT (p = 'skos:related' AND s > o AND EXISTS (SELECT 1 FROM t b WHERE b.s = a.o AND b.s_k = a.o_k AND b.o = a.s AND b.o_k = a.s_k AND b.p = 'skos:related')) AND NOT (p = 'urn:x:v/partOf' AND EXISTS (SELECT 1 FROM t b WHERE b.s = a.o AND b.s_k = a.o_k AND b.o = a.s AND b.o_k = a.s_k AND b.p = 'urn:x:v/hasPart')) GROUP BY p",
    "g15_schema": W + """, kind AS (SELECT DISTINCT s_k, s, o AS c FROM t WHERE p = 'rdf:type'), used AS (SELECT * FROM t WHERE p <> 'rdf:type' AND NOT regexp_matches(p, '^(rdf|rdfs|owl):')),
        one AS (SELECT s_k, s, min(c) AS c FROM kind GROUP BY 1, 2 HAVING count(*) = 1), cp AS (SELECT DISTINCT c AS s, 'rdfs:Class' AS o FROM kind WHERE NOT regexp_matches(c, '^(rdf|rdfs|owl):') UNION ALL SELECT DISTINCT p, 'rdf:Property' FROM used)
        SELECT s, 'rdf:type' AS p, o FROM cp UNION ALL SELECT s, 'rdfs:label', regexp_extract(s, '([^/#:]*)$', 1) FROM cp
        UNION ALL SELECT p, 'rdfs:domain', max(c) FROM used u LEFT JOIN one ON u.s = one.s AND u.s_k = one.s_k GROUP BY p HAVING count(DISTINCT coalesce(c, '')) = 1 AND max(c) IS NOT NULL
        UNION ALL SELECT p, 'rdfs:range', max(c) FROM (SELECT * FROM used WHERE o_k < 3) u LEFT JOIN one ON u.o = one.s AND u.o_k = one.s_k GROUP BY p HAVING count(DISTINCT coalesce(c, '')) = 1 AND max(c) IS NOT NULL""",
    "s14_ntriples_round_trip": W + "SELECT s, p, o_k, o, dt, lang FROM t",
}


def queries() -> dict:
    out = {n: _sparql(q, star) for n, (q, _) in STAR.items()}
    out |= {n: _sparql(q, statements) for n, (q, _) in STATEMENTS.items()}
    return out | FUNCTIONS


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in (STAR | STATEMENTS).items()} | FUNCTION_SQL
