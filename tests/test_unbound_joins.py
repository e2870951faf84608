"""Joins, OPTIONAL, MINUS and EXISTS on variables that may be unbound, as bags against nested loops; and their plans."""

import random
from collections import Counter

import pytest

from quadloom.engine import Engine
from quadloom.plans.algebra import XSD, Lit
from quadloom.sources.graphs import QuadGraph

R = random.Random(11)
TRIPLES = sorted({(f"urn:n{R.randrange(7)}", f"urn:p{R.randrange(3)}", f"urn:n{R.randrange(7)}") for _ in range(30)})


@pytest.fixture(scope="module")
def e(spark):
    return Engine(QuadGraph.from_triples(spark, TRIPLES), {"": "urn:"})


def scan(s, p, o):
    return [{s: a, o: b} for a, q, b in TRIPLES if q == f"urn:{p}" and (s != o or a == b)]


def agree(x, y):
    return all(y.get(k, v) == v for k, v in x.items())


def join(xs, ys, keep=lambda m: True):
    return [{**x, **y} for x in xs for y in ys if agree(x, y) and keep({**x, **y})]


def optional(xs, ys, keep=lambda m: True):
    out = []
    for x in xs:
        out += join([x], ys, keep) or [x]
    return out


P1, P2, BACK = scan("b", "p1", "c"), scan("c", "p2", "d"), scan("c", "p2", "a")
A = optional(scan("a", "p0", "b"), P1)  # ?c may be unbound
HEAD = "?a :p0 ?b OPTIONAL { ?b :p1 ?c }"
CASES = {
    f"{HEAD} OPTIONAL {{ ?c :p2 ?d }}": optional(A, P2),
    f"{HEAD} {{ ?c :p2 ?d }}": join(A, P2),
    f"{HEAD} MINUS {{ ?c :p2 ?d }}": [x for x in A if not any(agree(x, y) and x.keys() & y.keys() for y in P2)],
    f"{HEAD} FILTER NOT EXISTS {{ ?c :p2 ?d }}": [x for x in A if not any(agree(x, y) for y in P2)],
    f"{HEAD} FILTER EXISTS {{ ?c :p2 ?d FILTER(?d != ?a) }}": [x for x in A if any(agree(x, y) and y["d"] != x["a"] for y in P2)],
    f"{HEAD} FILTER(?a = ?b || EXISTS {{ ?c :p2 ?d }})": [x for x in A if x["a"] == x["b"] or any(agree(x, y) for y in P2)],
    f"{HEAD} OPTIONAL {{ ?c :p2 ?d FILTER(?d != ?a) }}": optional(A, P2, lambda m: m["d"] != m["a"]),
    f"{HEAD} OPTIONAL {{ ?c :p2 ?d FILTER(?d != :n1 && ?c != ?b) }}": optional(A, P2, lambda m: m["d"] != "urn:n1" and m["c"] != m["b"]),
    "?a :p0 ?b OPTIONAL { ?b :p1 ?c FILTER EXISTS { ?c :p2 ?a } }": optional(scan("a", "p0", "b"), P1, lambda m: any(agree(m, y) for y in BACK)),
    "?a :p0 ?b OPTIONAL { ?b :p1 ?c FILTER NOT EXISTS { ?c :p2 ?d } }": optional(scan("a", "p0", "b"), [x for x in P1 if not any(agree(x, y) for y in P2)]),
    f"{HEAD} OPTIONAL {{ ?c :p2 ?d FILTER NOT EXISTS {{ ?d :p0 ?a }} }}": optional(A, P2, lambda m: (m["d"], "urn:p0", m["a"]) not in TRIPLES),
    f"{{ {HEAD} }} {{ SELECT ?b ?c {{ ?b :p2 ?x OPTIONAL {{ ?b :p1 ?c }} }} }}": join(A, [{k: v for k, v in y.items() if k in ("b", "c")} for y in optional(scan("b", "p2", "x"), P1)]),
}


@pytest.mark.parametrize("pattern", list(CASES))
def test_against_nested_loops(e, pattern):
    got = Counter(tuple(r) for r in e.sparql(f"SELECT ?a ?b ?c ?d {{ {pattern} }}").collect())
    assert got == Counter(tuple(x.get(v) for v in "abcd") for x in CASES[pattern])


@pytest.mark.parametrize("pattern", ["MINUS { ?c :p2 ?d }", "FILTER NOT EXISTS { ?c :p2 ?d }", "OPTIONAL { ?c :p2 ?d }", "{ ?c :p2 ?d }"])
def test_no_nested_loop_in_the_plan(spark, e, pattern):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = e.sparql(f"SELECT * {{ {HEAD} {pattern} }}")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "BroadcastNestedLoopJoin" not in plan and "SortMergeJoin" in plan


FAR = [(f"urn:a{i}", "urn:p0", f"urn:b{i}") for i in range(9)] + [("urn:b1", "urn:p1", "urn:c1")] + [(f"urn:c{i}", "urn:p2", f"urn:d{i}") for i in range(300)]


def test_neighbours_of_a_product_share_the_larger_side(spark):
    e = Engine(QuadGraph.from_triples(spark, FAR), {"": "urn:"})
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = e.sparql(f"SELECT ?a ?b ?c ?d {{ {HEAD} OPTIONAL {{ ?c :p2 ?d }} }}").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert len(set(rows)) == len(rows) == 8 * 300 + 1
    assert sum(x.c != y.c for x, y in zip(rows, rows[1:])) < 900  # so files hold a value of ?c once for its eight rows


def test_a_condition_without_keys_broadcasts_a_few_rows(spark):
    e = Engine(QuadGraph.from_triples(spark, FAR), {"": "urn:"})
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = e.sparql(f"SELECT ?a ?d {{ {HEAD} OPTIONAL {{ ?c :p2 ?d FILTER(?d > ?a) }} }}")
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
        rows = Counter(tuple(r) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            below = lines[i + 1 : next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))]
            assert any("Limit" in y for y in below)
    far = [{"a": s, "b": o} for s, p, o in FAR if p == "urn:p0"], [{"b": "urn:b1", "c": "urn:c1"}], [{"c": s, "d": o} for s, p, o in FAR if p == "urn:p2"]
    assert rows == Counter((x["a"], x.get("d")) for x in optional(optional(far[0], far[1]), far[2], lambda m: False))  # IRIs have no order: an error


@pytest.mark.parametrize("least", [0, 1500, 1999, 2000])
def test_a_condition_that_few_or_no_rows_meet(spark, least):
    """2000 rows on the other side: more than those that are tried first."""
    rows = [(f"urn:a{i}", "urn:p0", f"urn:b{i % 4}") for i in range(6)] + [(f"urn:b{i}", "urn:v", Lit(str(least + i), XSD + "integer")) for i in range(4)]
    rows += [("urn:b1", "urn:p1", "urn:c7")] + [(f"urn:c{i}", "urn:w", Lit(str(i), XSD + "integer")) for i in range(2000)]
    e = Engine(QuadGraph.from_triples(spark, rows), {"": "urn:"})
    got = e.sparql("SELECT ?a ?c ?n { ?a :p0 ?b . ?b :v ?v OPTIONAL { ?b :p1 ?c } OPTIONAL { ?c :w ?n FILTER(?n >= ?v) } }").collect()
    expected = Counter()
    for i in range(6):
        partners = [n for n in ([7] if i % 4 == 1 else range(2000)) if n >= least + i % 4]
        expected.update((f"urn:a{i}", f"urn:c{n}", n) for n in partners)
        if not partners:
            expected[(f"urn:a{i}", "urn:c7" if i % 4 == 1 else None, None)] += 1
    assert Counter((r.a, r.c, None if r.n is None else int(getattr(r.n, "lex", r.n))) for r in got) == expected
