"""Entailment regimes: a graph with inferred triples. Plug-ins register under a name: QuadGraph -> QuadGraph."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom import terms as t
from quadloom.operators import paths
from quadloom.plans.algebra import RDF, RDFS, Iri, Triple, Var
from quadloom.runtime import Spool
from quadloom.sources.graphs import Graph, QuadGraph, Rel

REGIMES: dict[str, Callable[[QuadGraph], QuadGraph]] = {}
MAX_SCHEMA = 200_000
SKOSXL = "http://www.w3.org/2008/05/skos-xl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"


def regime(name: str):
    def put(f):
        REGIMES[name] = f
        return f

    return put


def apply(graph: Graph, name: str) -> Graph:
    if name not in REGIMES:
        raise ValueError(f"no entailment regime {name!r}; there are {', '.join(REGIMES)}")
    if name == "none":
        return graph
    return REGIMES[name](graph if isinstance(graph, QuadGraph) else as_quads(graph))


def as_quads(graph: Graph) -> QuadGraph:
    """A virtual graph as a quad table, for regimes that infer triples."""
    rel = graph.scan([Triple(Var("s"), Var("p"), Var("o"))], (Var("g"), None))[0]
    v = rel.env
    quads = rel.df.select(t.as_term(v["s"]).alias("s"), t.lexical(v["p"]).alias("p"), t.as_term(v["o"]).alias("o"), t.lexical(v["g"]).alias("g"), F.lit(None).cast("bigint").alias("g_line"))
    out = QuadGraph(quads)
    out.encode = graph.encode
    return out


def triples(graph: QuadGraph) -> DataFrame:
    return graph.quads.select("s", "p", "o").distinct()


def _iri(lex):
    return t.struct(1, lex)


def _with(graph: QuadGraph, inferred: DataFrame) -> QuadGraph:
    """Asserted quads, and inferred triples that no graph asserts, in no graph."""
    new = inferred.select("s", "p", "o").distinct().join(triples(graph), ["s", "p", "o"], "left_anti")
    return graph.derive(graph.quads.union(new.select("s", "p", "o", F.lit(None).cast("string"), F.lit(None).cast("bigint"))))


def closure(graph: QuadGraph, predicate: str) -> DataFrame:
    """(s, o) lexical forms: transitive and, for all terms it links, reflexive closure of a schema predicate."""
    edges = graph.quads.where(F.col("p") == graph.encode(predicate)).select(F.col("s.lex").alias("s"), F.col("o.lex").alias("o")).distinct()
    loops = edges.select("s").union(edges.select("o")).distinct().select("s", F.col("s").alias("o"))
    return paths.closure(edges).union(loops).distinct()


@regime("none")
def none(graph: QuadGraph) -> QuadGraph:
    return graph


@regime("rdf")
def rdf(graph: QuadGraph) -> QuadGraph:
    """Used predicates are properties, subjects are resources."""
    e = graph.encode
    q = graph.quads
    properties = q.select("p").distinct().select(_iri(F.col("p")).alias("s"), F.lit(e(RDF + "type")).alias("p"), _iri(e(RDF + "Property")).alias("o"))
    resources = q.select("s").distinct().select("s", F.lit(e(RDF + "type")).alias("p"), _iri(e(RDFS + "Resource")).alias("o"))
    return _with(graph, properties.union(resources))


def _expanded(graph: QuadGraph) -> DataFrame:
    """Triples, each also under the super-properties of its predicate."""
    sub = closure(graph, RDFS + "subPropertyOf").select(F.col("s").alias("p"), F.col("o").alias("sp"))
    base = triples(graph)
    return base.union(base.join(sub, "p").select("s", F.col("sp").alias("p"), "o")).distinct()


def _types(graph: QuadGraph, types: DataFrame) -> DataFrame:
    """(s, c): types with all super-classes."""
    sup = closure(graph, RDFS + "subClassOf").select(F.col("s").alias("c"), F.col("o").alias("sc"))
    return types.union(types.join(sup, "c").select("s", F.col("sc").alias("c"))).distinct()


def _hierarchies(graph: QuadGraph) -> DataFrame:
    e, out = graph.encode, None
    for p in (RDFS + "subClassOf", RDFS + "subPropertyOf"):
        part = closure(graph, p).select(_iri(F.col("s")).alias("s"), F.lit(e(p)).alias("p"), _iri(F.col("o")).alias("o"))
        out = part if out is None else out.union(part)
    return out


class RdfsLite(QuadGraph):
    """A graph under sub-properties and sub-classes that infers only what a pattern asks for: a pattern with a constant predicate
    reads the statements of that predicate's sub-properties and, for types, joins them with the closed schema. Patterns with a
    variable predicate read the whole entailed graph. Inferred triples are in no graph, so patterns within one read the asserted."""

    def __init__(self, base: QuadGraph) -> None:
        self.base, self.spark, self.compact, self.merged = base, base.spark, base.compact, False
        self.predicate_counts, self.triples = base.predicate_counts, None
        self.encode = base.encode

    @functools.cached_property
    def whole(self) -> QuadGraph:
        return _rdfs_lite(self.base)

    @property
    def quads(self) -> DataFrame:
        return self.whole.quads

    @functools.cached_property
    def _sub_properties(self) -> dict[str, set[str]]:
        """Property -> all properties below it; the property schema must fit the driver (checked)."""
        rows = closure(self.base, RDFS + "subPropertyOf").limit(MAX_SCHEMA + 1).collect()
        if len(rows) > MAX_SCHEMA:
            raise ValueError(f"more than {MAX_SCHEMA} pairs of sub-properties")
        out: dict[str, set[str]] = {}
        for r in rows:
            out.setdefault(r.o, {r.o}).add(r.s)
        return out

    def _asked(self, p: str, o=None) -> DataFrame:
        """s, p, o of one predicate, also inferred; with o those of one object alone where that narrows the search."""
        e = self.encode
        base = self.base._of_graph(None).where(F.col("p").isin(sorted(self._sub_properties.get(p, {p})))).select("s", F.lit(p).alias("p"), "o")
        if p == e(RDF + "type"):
            sup = closure(self.base, RDFS + "subClassOf").select(F.col("s").alias("c"), F.col("o").alias("sc"))
            sup = sup.where(F.col("sc") == e(o.value)) if isinstance(o, Iri) else sup
            types = base.select("s", F.col("o.lex").alias("c")).distinct().join(sup, "c")
            return base.union(types.select("s", F.lit(p).alias("p"), _iri(F.col("sc")).alias("o")))
        if p in (e(RDFS + "subClassOf"), e(RDFS + "subPropertyOf")):
            name = RDFS + "subClassOf" if p == e(RDFS + "subClassOf") else RDFS + "subPropertyOf"
            return base.union(closure(self.base, name).select(_iri(F.col("s")).alias("s"), F.lit(p).alias("p"), _iri(F.col("o")).alias("o")))
        return base

    def _one(self, triple: Triple, graph) -> Rel:
        if graph is not None:
            return self.base._one(triple, graph)
        if not isinstance(triple.p, Iri):
            return self.whole._one(triple, None)
        asked = self._asked(self.encode(triple.p.value), triple.o)
        return self.base.derive(asked.withColumn("g", F.lit(None).cast("string")).withColumn("g_line", F.lit(None).cast("bigint")))._one(triple, None)

    def edges(self, predicates: list[str] | None, graph, negated: bool = False) -> DataFrame:
        if graph is not None:
            return self.base.edges(predicates, graph, negated)
        if predicates is None or negated:
            return self.whole.edges(predicates, None, negated)
        out = None
        for p in predicates:
            part = self._asked(self.encode(p)).select("s", "o")
            out = part if out is None else out.union(part)
        return out.distinct()

    def edge_rows(self, predicates: list[str], graph) -> DataFrame:
        return self.edges(predicates, graph)


@regime("rdfslite")
def rdfs_lite(graph: QuadGraph) -> QuadGraph:
    """Sub-properties, sub-classes and types through these; no domains or ranges."""
    return RdfsLite(graph)


def _rdfs_lite(graph: QuadGraph) -> QuadGraph:
    e = graph.encode
    base = Spool(graph.spark).write(_expanded(graph))
    types = _types(graph, base.where(F.col("p") == e(RDF + "type")).select("s", F.col("o.lex").alias("c")))
    typed = types.select("s", F.lit(e(RDF + "type")).alias("p"), _iri(F.col("c")).alias("o"))
    return _with(graph, base.union(typed).union(_hierarchies(graph)))


@regime("rdfs")
def rdfs(graph: QuadGraph) -> QuadGraph:
    """rdfslite, and types from domains, ranges, use as predicate, and being a resource at all."""
    e = graph.encode
    spool = Spool(graph.spark)
    base = spool.write(_expanded(graph))
    has = lambda p: base.where(F.col("p") == e(p))
    domain = has(RDFS + "domain").select(F.col("s.lex").alias("p"), F.col("o.lex").alias("c"))
    rng = has(RDFS + "range").select(F.col("s.lex").alias("p"), F.col("o.lex").alias("c"))
    types = has(RDF + "type").select("s", F.col("o.lex").alias("c"))
    types = types.union(base.join(domain, "p").select("s", "c")).union(base.where("o.k < 3").join(rng, "p").select(F.col("o").alias("s"), "c"))
    types = types.union(base.select("p").distinct().select(_iri(F.col("p")).alias("s"), F.lit(e(RDF + "Property")).alias("c")))
    nodes = base.select("s").union(base.where("o.k < 3").select("o")).distinct()
    types = _types(graph, types).union(nodes.select("s", F.lit(e(RDFS + "Resource")).alias("c"))).distinct()
    typed = types.select("s", F.lit(e(RDF + "type")).alias("p"), _iri(F.col("c")).alias("o"))
    return _with(graph, base.union(typed).union(_hierarchies(graph)))


@regime("skosxl")
def skosxl(graph: QuadGraph) -> QuadGraph:
    """Labels as plain literals: concept xl:prefLabel label, label xl:literalForm text gives concept skos:prefLabel text; alt and hidden alike."""
    e = graph.encode
    q = triples(graph)
    form = q.where(F.col("p") == e(SKOSXL + "literalForm")).select(F.col("s").alias("label"), F.col("o").alias("text"))
    out = None
    for kind in ("prefLabel", "altLabel", "hiddenLabel"):
        part = q.where(F.col("p") == e(SKOSXL + kind)).select("s", F.col("o").alias("label")).join(form, "label").select("s", F.lit(e(SKOS + kind)).alias("p"), F.col("text").alias("o"))
        out = part if out is None else out.union(part)
    sub = None
    for kind in ("prefLabel", "altLabel", "hiddenLabel"):
        used = q.where(F.col("p") == e(SKOSXL + kind)).limit(1)
        part = used.select(_iri(e(SKOS + kind)).alias("s"), F.lit(e(RDFS + "subPropertyOf")).alias("p"), _iri(e(RDFS + "label")).alias("o"))
        sub = part if sub is None else sub.union(part)
    return _with(graph, out.union(sub))
