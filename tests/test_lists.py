"""Lengths and places in lists against walking them: lists cut between tasks, shared, repeated, circular and without an end."""

import random
from collections import Counter

import pytest

from quadloom.engine import Engine
from quadloom.operators import lists
from quadloom.plans import property_functions
from quadloom.plans.algebra import RDF, Lit
from quadloom.sources.graphs import QuadGraph

R = random.Random(5)
FIRST, REST, NIL = RDF + "first", RDF + "rest", RDF + "nil"


def chain(name, n, end=NIL):
    cells = [f"{name}/{i}" for i in range(n)]
    return [(c, FIRST, f"urn:e/{c}") for c in cells] + list(zip(cells, [REST] * n, [*cells[1:], end]))


PLAIN = sum((chain(f"urn:l{k}", R.choice([1, 2, 3, 9, 40])) for k in range(12)), []) + chain("_:b", 5)
PLAIN = R.sample(PLAIN, len(PLAIN))
SHORT = chain("urn:l0", 2) + chain("urn:l1", 1) + chain("_:b", 3)
GRAPHS = {
    "plain": PLAIN,
    "repeated": [(*x, g) for g in ("urn:g1", "urn:g2") for x in PLAIN],
    "circular": PLAIN + chain("urn:o", 7, "urn:o/0") + chain("urn:self", 1, "urn:self/0"),
    "no end": PLAIN + chain("urn:open", 6, "urn:lost") + chain("urn:half", 4, "urn:single") + [("urn:single", FIRST, "urn:x")],
    "gaps": [x for x in PLAIN if x[:2] != ("urn:l3/0", FIRST)] + [("urn:alone", FIRST, "urn:x"), ("urn:l1/0", FIRST, "urn:second")],
    "shared": SHORT + chain("urn:t", 3, "urn:l0/0") + chain("urn:u", 2, "urn:l0/0"),
    "forked": SHORT + chain("urn:t", 3) + [("urn:t/0", REST, "urn:t/2"), ("urn:t/1", REST, "urn:l1/0")],
    "literal end": [*SHORT, ("urn:q", FIRST, "urn:x"), ("urn:q", REST, Lit("end"))],
    "empty": [("urn:a", "urn:p", "urn:b")],
}


def walked(triples):
    first, rest = {}, {}
    for s, p, o, *_ in triples:
        if p in (FIRST, REST) and not (p == REST and o == NIL):
            (first if p == FIRST else rest).setdefault(s, set()).add(o)
    lengths, index = Counter(), Counter()
    for s in first:
        seen, front, i = {s: 0}, [s], 0
        while front:
            i += 1
            front = list({y for x in front for y in rest.get(x, ()) if y not in seen})
            seen.update(dict.fromkeys(front, i))
        lengths[s, len(seen)] += 1
        index.update((s, i, e) for x, i in seen.items() for e in first.get(x, ()))
    return lengths, index


@pytest.mark.parametrize("name", list(GRAPHS))
def test_lists_against_walking_them(spark, monkeypatch, name):
    monkeypatch.setattr(lists, "BLOCK", 3)
    g = Engine(QuadGraph.from_triples(spark, GRAPHS[name]), {"rdf": RDF, "list": property_functions.LIST})
    lengths, index = walked(GRAPHS[name])
    assert Counter((r.l, int(r.n)) for r in g.sparql("SELECT DISTINCT ?l ?n { ?l rdf:first ?f ; list:length ?n }").collect()) == lengths
    assert Counter((r.l, int(r.i), r.x) for r in g.sparql("SELECT ?l ?i ?x { ?l list:index (?i ?x) }").collect()) == index


@pytest.mark.parametrize("name", ["plain", "repeated"])
def test_lists_are_not_walked_cell_by_cell(spark, monkeypatch, name):
    def reached(*_):
        raise AssertionError("pairs of cells, in as many rounds as the longest list has cells")

    monkeypatch.setattr(lists, "reached", reached)
    g = Engine(QuadGraph.from_triples(spark, GRAPHS[name]), {"rdf": RDF, "list": property_functions.LIST})
    lengths, index = walked(GRAPHS[name])
    assert g.sparql("SELECT DISTINCT ?l ?n { ?l rdf:first ?f ; list:length ?n }").count() == sum(lengths.values())
    assert g.sparql("SELECT ?l ?i ?x { ?l list:index (?i ?x) }").count() == sum(index.values())
