"""The core's data operators against brute force, with awkward input."""

import random
from collections import defaultdict

import pytest

from quadloom.operators import hierarchy, skew, wide
from quadloom.plans import core_queries

RDF = "s_k int, s_lex string, p_lex string, o_k int, o_lex string, o_dt string, o_lang string, g_iri string, extra string, n bigint, _task int"
PRED = "p_lex string, range_kind string, range_dt string, single_valued boolean, n bigint"


def rdf(spark, rows):
    return spark.createDataFrame([(1, s, p, k, o, dt, None, None, "x", 1, 2) for s, p, k, o, dt in rows], RDF)


def statements(n=3000, seed=1):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        p = "hot" if r.random() < 0.6 else f"p{r.randrange(40)}"
        o = "same" if r.random() < 0.3 else f"o{r.randrange(500)}"
        rows.append((f"s{r.randrange(200)}", p, r.choice([1, 3]), o, None))
    rows += [(None, "p1", 3, "x", None), ("s1", None, 3, "y", None), ("s1", "p1", 3, None, None)] + rows[:50]
    return rows


@pytest.mark.parametrize("tasks", [1, 3, 8])
def test_profile_matches_brute_force(spark, tasks):
    rows = statements()
    preds = spark.createDataFrame([("hot", "iri", None, False, 1), ("p1", "literal", "xsd:string", False, 1), ("p1", "literal", "xsd:string", False, 1)], PRED)
    got, plan = skew.profile_predicates(rdf(spark, rows), preds, tasks)
    got = {r.p_lex: (r.n_rows, r.n_subjects, r.n_objects, r.range_kind, r.n_off_range) for r in got.collect()}
    want = {}
    for p in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == p]
        kind = {"hot": "iri", "p1": "literal"}.get(p)
        off = sum(kind is not None and r[3] is not None and (r[2] == 3) != (kind == "literal") for r in mine)
        want[p] = (len(mine), len({r[0] for r in mine} - {None}), len({(r[2], r[3]) for r in mine if r[3] is not None}), kind, off)
    assert got == want
    assert plan.rows == len(rows)
    moved = {(r[1], 0, r[0]) for r in rows} | {(r[1], 1, r[2], r[3]) for r in rows}
    assert plan.total == len(moved)  # the load is what moves: one row per value


def test_plan_is_balanced_and_splits_the_hot_key():
    plan = skew.pack([("hot", 6000), ("warm", 1000)], {b: 40 for b in range(64)}, 8, 64)
    assert len(plan.heavy["hot"]) > 4
    assert max(plan.load) <= 1.5 * sum(plan.load) / 8


def test_labels_hit_every_partition(spark):
    labels = skew.task_labels(spark, 7)
    df = spark.createDataFrame([(x,) for x in labels], "t int").repartition(7, "t")
    assert [len(x) for x in df.rdd.glom().collect()] == [1] * 7


def test_heavy_predicates_and_empty(spark):
    rows = statements()
    preds = spark.createDataFrame([], PRED)
    assert [r.p_lex for r in skew.heavy_predicates(rdf(spark, rows), preds).collect()] == ["hot"]
    assert skew.heavy_predicates(rdf(spark, []), preds).collect() == []


CASES = [
    ("xsd:integer", ["007", "7", " +7\n"], 1), ("xsd:integer", ["7", "8"], 0), ("xsd:integer", ["7.0", "x", ""], 0), ("xsd:integer", ["-0", "0"], 1),
    ("xsd:integer", ["9" * 5000, "0" + "9" * 5000], 1), ("xsd:decimal", ["1.50", "1.5", "+1.5"], 1), ("xsd:decimal", ["1e2"], 0), ("xsd:decimal", [".5", "0.5"], 1),
    ("xsd:boolean", ["1", "true"], 1), ("xsd:boolean", ["TRUE"], 0), ("xsd:date", ["2020-02-29"], 1), ("xsd:date", ["2021-02-29"], 0), ("xsd:date", ["2020-01-01Z", "2020-01-01+00:00"], 1),
    ("xsd:date", ["2020-01-01", "2020-01-01Z"], 0), ("xsd:dateTime", ["2020-01-01T24:00:00Z", "2020-01-02T00:00:00.0Z"], 1), ("xsd:dateTime", ["2020-01-01T12:00:00+02:00", "2020-01-01T10:00:00Z"], 1),
    ("xsd:dateTime", ["2020-01-01T10:60:00Z"], 0), ("xsd:gYear", ["1900", " 1900"], 1), ("xsd:gYear", ["'15"], 0), ("xsd:string", ["a ", "a"], 1), ("xsd:string", ["a", "A"], 0), ("xsd:string", [""], 1),
]


def test_cells_by_value(spark):
    rows, preds = [], []
    for i, (dt, texts, _) in enumerate(CASES):
        preds.append((f"urn:v/{i}", "literal", dt, True, 0))
        rows += [("s", f"urn:v/{i}", 3, x, "any") for x in texts] + [("s", f"urn:v/{i}", 3, None, None)] * (i % 2)
    preds += [("urn:w/0", "literal", None, True, 0), ("urn:many", "literal", "xsd:string", False, 0), (None, "literal", None, True, 0)]
    rows += [("s", "urn:many", 3, "a", None), ("s", "urn:many", 3, "b", None), (None, "urn:v/0", 3, "5", None), (None, "urn:w/0", 3, "z", None)]
    df, pdf = rdf(spark, rows), spark.createDataFrame(preds, PRED)
    found = {(r.s_lex, r.p_lex) for r in wide.unclear_cells(df, pdf).collect()}
    assert found == {("s", f"urn:v/{i}") for i, c in enumerate(CASES) if not c[2]}
    out = {r.s_lex: r for r in wide.to_wide(df, pdf).collect()}
    assert set(out) == {"s", None}
    for i, (_, _, one) in enumerate(CASES):
        if i != 4:  # a number of 5000 digits is one value, but fits no column
            assert (out["s"][str(i)] is not None) == bool(one), CASES[i]
    assert out[None]["0"] == 5 and out[None]["0_2"] == "z"
    assert wide.to_wide(rdf(spark, []), pdf).count() == 0
    assert wide.unclear_cells(df, spark.createDataFrame([], PRED)).count() == 0


def graph_truth(links):
    up = defaultdict(set)
    for c, p in links:
        up[c].add(p)

    def above(n):
        seen, work = set(), list(up[n])
        while work:
            x = work.pop()
            if x not in seen:
                seen.add(x)
                work += up[x]
        return seen

    nodes = {x for e in links for x in e}
    return {n for n in nodes if n in above(n)}, {(a, n) for n in nodes for a in above(n)}, nodes, up


def random_links(seed, n=60, multi=False):
    r = random.Random(seed)
    links = {(f"n{i}", f"n{r.randrange(i)}") for i in range(1, n)}
    if multi:
        links |= {(f"n{i}", f"n{r.randrange(i)}") for i in range(1, n, 7)}
    links |= {("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("below1", "c1"), ("below2", "below1"), ("self", "self"), ("c2x", "self"), ("n3b", "n3"), ("c3", "above") if multi else ("q", "above")}
    return sorted(links)


@pytest.mark.parametrize("multi", [False, True])
@pytest.mark.parametrize("finish", [0, 5, 10_000])
def test_hierarchy_matches_brute_force(spark, finish, multi):
    links = random_links(3, multi=multi)
    df = spark.createDataFrame(links, "child string, parent string")
    cyc, pairs, nodes, up = graph_truth(links)
    assert {r.node_lex for r in hierarchy.cycle_nodes(df, finish).collect()} == cyc
    paths = hierarchy.hierarchy(df, finish).collect()
    assert {r.node for r in paths} == nodes
    for r in paths:
        if r.path:
            assert r.path[-1] == r.node and r.root == r.path[0] and r.depth == len(r.path) - 1 and not up[r.root]
            assert all(b in {c for c, p in links if p == a} for a, b in zip(r.path, r.path[1:]))
        else:
            assert r.state == ("cycle" if r.node in cyc else "below_cycle")
    if not multi:
        assert len(paths) == len(nodes)
    # one row per link with a way up, whose path goes on along the parent's own: the shortest, the least parent at a tie
    own = {}
    for r in sorted((r for r in paths if r.path), key=lambda r: (len(r.path), r.parent or "")):
        own.setdefault(r.node, r.path)
    with_way = {(c, p) for c, p in links if c not in cyc and p in own}
    assert {(r.node, r.parent) for r in paths if r.parent} == with_way and sum(bool(r.parent) for r in paths) == len(with_way)
    assert all(r.path == [*own[r.parent], r.node] for r in paths if r.parent)


@pytest.mark.parametrize("multi", [False, True])
@pytest.mark.parametrize("finish", [0, 5, 10_000])
def test_all_descendants_match_brute_force(spark, finish, multi):
    links = random_links(3, multi=multi) + [(f"u{i}", f"u{i - 1}") for i in range(1, 9)] + [("u0", "c2")]
    links += [("x", "c1"), ("y", "x"), ("c3", "y")] * multi  # a second cycle through c1, longer ways around
    down = defaultdict(set)
    for c, p in links:
        down[p].add(c)
    want = {}
    for n in {x for e in links for x in e}:
        front, distance = down[n], 1
        while front:
            want |= {(n, x): distance for x in front}
            front, distance = {c for x in front for c in down[x] if (n, c) not in want}, distance + 1
    assert set(want) == graph_truth(links)[1]
    rows = hierarchy.all_descendants(spark.createDataFrame(links, "child string, parent string"), finish).collect()
    assert len(rows) == len(want) and {(r.node_lex, r.descendant_lex): r.distance for r in rows} == want


def test_sizes_of_nodes_on_and_below_cycles(spark, tmp_path):
    links = [("a", "b"), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("r1", "r")]
    rdf(spark, [(c, "skos:broader", 1, p, None) for c, p in links]).write.parquet(f"{tmp_path}/rdf.parquet")
    sizes = {r.node_lex: (r.state, r.n_descendants) for r in core_queries.p6_paths(spark, str(tmp_path)).collect()}
    assert sizes == {"a": ("cycle", 5), "b": ("cycle", 5), "c": ("below_cycle", 2), "d": ("below_cycle", 1), "e": ("below_cycle", 0), "r": ("tree", 1), "r1": ("tree", 0)}
    pairs = core_queries.p6_descendants(spark, str(tmp_path)).collect()
    assert len(pairs) == 14 and ("a", "e", 4) in {tuple(r) for r in pairs} and ("a", "a", 2) in {tuple(r) for r in pairs}


def test_hierarchy_empty_and_statements(spark):
    none = rdf(spark, [])
    assert hierarchy.cycle_nodes(hierarchy.statement_links(none)).count() == 0
    assert hierarchy.hierarchy(hierarchy.statement_links(none)).count() == 0
    rows = [("a", "skos:broader", 1, "b", None), ("b", "skos:narrower", 1, "a", None), ("b", "urn:x:v/hasPart", 1, "c", None), ("c", "skos:broader", 1, None, None), (None, "skos:broader", 1, "b", None)]
    assert {tuple(r) for r in hierarchy.statement_links(rdf(spark, rows + rows)).collect()} == {("a", "b"), ("c", "b")}


@pytest.mark.parametrize("finish", [0, 10_000])
def test_stacked_diamonds_have_a_row_per_link(spark, finish):
    links = [x for i in range(30) for x in ((f"a{i}", f"t{i}"), (f"b{i}", f"t{i}"), (f"t{i + 1}", f"a{i}"), (f"t{i + 1}", f"b{i}"))]
    if not finish:
        links = links[:16]
    rows = hierarchy.hierarchy(spark.createDataFrame(links, "child string, parent string"), finish).collect()
    assert len(rows) == len(links) + 1 and all(r.state == "tree" for r in rows)


@pytest.mark.parametrize("finish", [0, 10_000])
def test_a_cycle_with_an_exit(spark, finish):
    links = [("a", "b"), ("b", "a"), ("b", "root"), ("under", "a"), ("tied", "a"), ("tied", "root"), ("mid", "a"), ("x", "mid"), ("y", "x"), ("x", "y")]
    rows = {(r.node, r.parent): (r.path, r.state) for r in hierarchy.hierarchy(spark.createDataFrame(links, "child string, parent string"), finish).collect()}
    assert rows == {("root", None): (["root"], "tree"), ("tied", "root"): (["root", "tied"], "tree")} | {(n, None): (None, "cycle") for n in "abxy"} | {(n, None): (None, "below_cycle") for n in ("under", "mid")}


def test_a_deep_chain_is_peeled_in_one_task(spark):
    links = [(f"n{i}", f"n{i - 1}") for i in range(1, 3000)] + [("n0", "top")]
    df = spark.createDataFrame(links, "child string, parent string")
    assert hierarchy.cycle_nodes(df).count() == 0
    assert hierarchy.hierarchy(df).selectExpr("max(depth) AS d").first().d == 3000


def test_equal_values_give_one_cell_in_any_order(spark):
    preds = spark.createDataFrame([("urn:x:d", "literal", "xsd:date", True, 1), ("urn:x:y", "literal", "xsd:gYear", True, 1), ("urn:x:n", "literal", "xsd:decimal", True, 1)], PRED)
    rows = [("s", "urn:x:d", 3, "2020-01-01+14:00", None), ("s", "urn:x:d", 3, "2019-12-31-10:00", None), ("s", "urn:x:n", 3, "1.123456789012", None), ("t", "urn:x:n", 3, "1.12345678900000", None), ("t", "urn:x:n", 3, "+01.123456789", None)]
    for order in (rows, rows[::-1]):
        got = {r.s_lex: (str(r.d), r.n) for r in wide.to_wide(rdf(spark, order).coalesce(1), preds).collect()}
        assert got["s"] == ("2019-12-31", None) and str(got["t"][1]).rstrip("0") == "1.123456789"
    assert wide.unclear_cells(rdf(spark, rows), preds).count() == 0
