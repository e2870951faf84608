"""Engine: queries and updates over a graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom import terms as t
from quadloom.operators import entailment
from quadloom.operators.paths import reach
from quadloom.plans import property_functions, serql, sparql, updates
from quadloom.plans.algebra import Iri, Query
from quadloom.plans.compiler import Compiler
from quadloom.sources.graphs import Graph, QuadGraph


class Engine:
    """``endpoints``: named graphs for SERVICE; ``prefixes``: known to all queries, in addition to the usual ones."""

    def __init__(self, graph: Graph, prefixes: dict[str, str] | None = None, base: str = "", endpoints: dict[str, Graph] | None = None) -> None:
        self.graph, self.spark, self.base = graph, graph.spark, base
        self.prefixes = dict(prefixes or {})
        self.endpoints = endpoints or {}
        self.functions: dict[str, Callable] = dict(property_functions.REGISTRY)

    def with_prefix(self, prefix: str, iri: str) -> Engine:
        """A new engine that knows a further prefix, or another IRI for it."""
        return self._like({**self.prefixes, prefix: iri})

    def without_prefix(self, prefix: str) -> Engine:
        return self._like({k: v for k, v in self.prefixes.items() if k != prefix})

    def _like(self, prefixes: dict[str, str]) -> Engine:
        out = Engine(self.graph, prefixes, self.base, self.endpoints)
        out.functions = self.functions
        return out

    def compiler(self, entail: str = "none") -> Compiler:
        graph = entailment.apply(self.graph, entail) if entail != "none" else self.graph
        return Compiler(graph, self.base, self.endpoints, self.functions, self.graph)

    def parse(self, text: str) -> Query:
        return sparql.parse_query(text, base=self.base, prefixes=self.prefixes, property_functions=set(self.functions))

    def sparql(self, text: str, entail: str = "none", terms: bool = False) -> DataFrame:
        """SELECT: a column per variable, native or lexical (TERM structs with ``terms``). ASK: one boolean row, column ``answer``.
        CONSTRUCT and DESCRIBE: columns s, p, o (TERM, string, TERM)."""
        return self.run(self.parse(text), entail, terms)

    def serql(self, text: str, entail: str = "rdfs", terms: bool = False) -> DataFrame:
        return self.run(serql.parse(text, self.prefixes), entail, terms)

    def run(self, q: Query, entail: str = "none", terms: bool = False) -> DataFrame:
        c = self.compiler(entail)
        if q.form == "select":
            rel = c.select(q)
            return rel.df.select(*[(t.as_term(v) if terms else t.output(v)).alias(n) for n, v in rel.env.items()])
        if q.form == "ask":
            rel = c.where(q)
            return rel.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))
        if q.form == "construct":
            rel = c.where(q)
            return c.template(self._slice(c, rel, q), q.template)
        return self.describe(c, q)

    @staticmethod
    def _slice(c: Compiler, rel, q: Query):
        from quadloom.sources.graphs import Rel

        keys = []
        for e, down in q.order:
            keys += [k.desc_nulls_last() if down else k.asc_nulls_first() for k in t.sort_keys(c.scope(rel).value(e))]
        df = rel.df.orderBy(*keys) if keys else rel.df
        df = df.offset(q.offset) if q.offset else df
        df = df.limit(q.limit) if q.limit is not None else df
        return Rel(df, rel.env, rel.maybe)

    def describe(self, c: Compiler, q: Query) -> DataFrame:
        """Outgoing triples of the resources, and of the blank nodes that these reach through blank nodes; each once."""
        rel = self._slice(c, c.where(q), q)
        seeds = None
        for x in q.describe:
            v = c.scope(rel).value(x)
            part = (self.spark.range(1) if isinstance(x, Iri) else rel.df).select(t.as_term(v).alias("n"))
            seeds = part if seeds is None else seeds.union(part)
        return bounded_description(c.g, seeds)

    def update(self, text: str) -> Engine:
        """A new engine over a new snapshot; this one is unchanged. All requests of the text apply, or none."""
        if not isinstance(self.graph, QuadGraph):
            raise TypeError("only quad tables can be updated")
        graph = self.graph
        for u in sparql.parse_update(text, base=self.base, prefixes=self.prefixes, property_functions=set(self.functions)):
            graph = updates.apply(graph, u, self)
        out = Engine(graph, self.prefixes, self.base, self.endpoints)
        out.functions = self.functions
        return out


def all_triples(graph: Graph) -> DataFrame:
    """Distinct s (TERM), p (string), o (TERM) of a graph."""
    from quadloom.plans.algebra import Triple, Var

    rel = graph.scan([Triple(Var("s"), Var("p"), Var("o"))], None)[0]
    return rel.df.select(t.as_term(rel.env["s"]).alias("s"), t.lexical(rel.env["p"]).alias("p"), t.as_term(rel.env["o"]).alias("o"))


def bounded_description(graph: Graph, seeds: DataFrame) -> DataFrame:
    triples = all_triples(graph)
    seeds = seeds.where("n IS NOT NULL AND n.k < 3").distinct()
    blank = triples.where("o.k = 2").select("s", "o")
    inner = blank.where("s.k = 2")
    start = blank.join(seeds.select(F.col("n").alias("s")), "s", "left_semi")
    nodes = seeds.union(reach(start, inner).select("o")).distinct()
    return triples.join(nodes.select(F.col("n").alias("s")), "s", "left_semi").select("s", "p", "o").distinct()
