"""SPARQL Update on quad tables: every request makes a new snapshot from the one before."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom import terms as t
from quadloom.plans.algebra import Iri, Lit, Update, Var
from quadloom.plans.compiler import Compiler
from quadloom.sources.graphs import QUADS, QuadGraph

#: The graph that data without GRAPH goes to; reading sees the union of all graphs.
DEFAULT = "user"
KEYS = ["s", "p", "o", "g"]


def apply(graph: QuadGraph, u: Update, engine) -> QuadGraph:
    match u.kind:
        case "insert_data":
            return insert(graph, _data(graph, u.insert))
        case "delete_data":
            out = graph
            for everywhere in (True, False):  # a triple without a graph goes from every graph, whatever stands beside it
                part = [(g, x) for g, x in u.delete if (g is None) == everywhere]
                out = delete(out, _data(graph, part), everywhere) if part else out
            return out
        case "modify":
            return modify(graph, u, engine)
        case "clear" | "drop":
            return clear(graph, u.target)
        case "create":
            return graph
        case "add":
            return add(graph, u.source, u.target)
        case "copy":
            return graph if u.source == u.target else add(clear(graph, u.target), u.source, u.target)
        case "move":
            return graph if u.source == u.target else clear(add(clear(graph, u.target), u.source, u.target), u.source)
        case "load":
            from quadloom.sources.readers import load

            try:
                return insert(graph, load(graph.spark, u.source, graph=u.target or DEFAULT).quads)
            except Exception:
                if u.silent:
                    return graph
                raise
    raise ValueError(f"no update: {u.kind}")


def insert(graph: QuadGraph, quads: DataFrame) -> QuadGraph:
    """A quad that the table holds already is not added again."""
    new = quads.select(*KEYS, "g_line").dropDuplicates(KEYS)
    return graph.derive(graph.quads.union(_without(new, graph.quads, KEYS)))


def _without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Anti-join that takes nulls as equal; the right side is renamed, as both may come from one table."""
    gone = gone.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    return rows.join(gone, [rows[k].eqNullSafe(gone[f"_{k}"]) for k in keys], "left_anti")


def delete(graph: QuadGraph, quads: DataFrame, any_graph: bool = False) -> QuadGraph:
    return graph.derive(_without(graph.quads, quads, KEYS[:3] if any_graph else KEYS))


def clear(graph: QuadGraph, target: str) -> QuadGraph:
    g = F.col("g")
    keep = {"ALL": F.lit(False), "DEFAULT": ~g.eqNullSafe(F.lit(DEFAULT)), "NAMED": g.eqNullSafe(F.lit(DEFAULT)) | g.isNull()}.get(target)
    return graph.derive(graph.quads.where(keep if keep is not None else ~g.eqNullSafe(F.lit(graph.encode(target)))))


def _name(graph: QuadGraph, g: str) -> str:
    return DEFAULT if g == "DEFAULT" else graph.encode(g)


def add(graph: QuadGraph, source: str, target: str) -> QuadGraph:
    rows = graph.quads.where(F.col("g") == _name(graph, source)).withColumn("g", F.lit(_name(graph, target)))
    return insert(graph, rows)


def _data(graph: QuadGraph, quads: list) -> DataFrame:
    """Blank nodes are fresh in each request, one per label."""
    request = uuid.uuid4().hex[:16]

    def cell(x):
        if isinstance(x, Var):
            return (2, f"_:d{request}_{x.name.strip('~')}", "", "")
        if isinstance(x, Iri):
            return (1, graph.encode(x.value), "", "")
        return (3, x.lex, "" if x.dt in t.STRINGS else graph.encode(x.dt), x.lang)

    for _, x in quads:
        if not isinstance(x.p, Iri) or isinstance(x.s, Lit):
            raise ValueError("data holds a path or a literal subject")
    rows = [(cell(x.s), graph.encode(x.p.value), cell(x.o), graph.encode(g.value) if g else DEFAULT, None) for g, x in quads]
    return graph.spark.createDataFrame(rows, QUADS)


def modify(graph: QuadGraph, u: Update, engine) -> QuadGraph:
    """The pattern is solved once, on the snapshot before; deletions apply before insertions."""
    c = Compiler(graph, engine.base, engine.endpoints, engine.functions)
    if u.using or u.using_named:
        c.default, c.named = set(u.using), set(u.using_named)
    elif u.graph:
        c.default = {u.graph}
    rel = c.sequence(u.where)
    if u.delete and u.insert:
        from quadloom.runtime import Spool

        df = Spool(graph.spark).write(rel.df)  # both templates read the same solutions
        rel = type(rel)(df, {n: t.Val(v.kind, df[n], v.prefix, v.dt) for n, v in rel.env.items()}, rel.maybe)
    out = graph
    for quads, act in ((u.delete, "delete"), (u.insert, "insert")):
        by_graph: dict[object, list] = {}
        for g, x in quads:
            by_graph.setdefault(g, []).append(x)
        for g, triples in by_graph.items():
            if g is None:
                rows = c.template(rel, triples).withColumn("g", F.lit(graph.encode(u.graph) if u.graph else DEFAULT))
                everywhere = act == "delete" and not u.graph
            else:
                name = t.lexical(c.scope(rel).value(g))
                bound = type(rel)(rel.df.withColumn("~g", name), rel.env, rel.maybe)
                rows = _with_graph(c, bound, triples)
                everywhere = False
            rows = rows.select("s", "p", "o", "g", F.lit(None).cast("bigint").alias("g_line"))
            out = delete(out, rows, everywhere) if act == "delete" else insert(out, rows)
    return out


def _with_graph(c: Compiler, rel, triples: list) -> DataFrame:
    scope = c.scope(rel)
    cells = [F.struct(t.as_term(scope.value(x.s)).alias("s"), t.lexical(scope.value(x.p)).alias("p"), t.as_term(scope.value(x.o)).alias("o")) for x in triples]
    rows = rel.df.select(F.col("`~g`").alias("g"), F.explode(F.array(*cells)).alias("t")).select("t.*", "g")
    return rows.where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL AND g IS NOT NULL")


def remove_all(graph: QuadGraph, triples: DataFrame) -> QuadGraph:
    """Removes uploaded triples (s, p, o) from every graph."""
    return graph.derive(_without(graph.quads, triples, KEYS[:3]))


def remove_matching(graph: QuadGraph, s=None, p: str | None = None, o=None) -> QuadGraph:
    """Removes the statements that fit all given terms (Iri, Lit, or None for any)."""
    hit = F.lit(True)
    for col, x in ((F.col("s"), s), (F.col("o"), o)):
        if x is not None:
            hit = hit & (col == t.as_term(t.constant(x, graph.encode)))
    if p is not None:
        hit = hit & (F.col("p") == graph.encode(p))
    return graph.derive(graph.quads.where(~hit))


def difference(before: QuadGraph, after: QuadGraph) -> DataFrame:
    """The change log of an update: op ('add' or 'remove') and the quad."""
    a, b = before.quads.select(*KEYS).distinct(), after.quads.select(*KEYS).distinct()
    added = _without(b, a, KEYS).select(F.lit("add").alias("op"), *KEYS)
    return added.union(_without(a, b, KEYS).select(F.lit("remove").alias("op"), *KEYS))


def statistics(before: QuadGraph, after: QuadGraph) -> DataFrame:
    """triples_added, triples_removed, subjects_touched."""
    d = difference(before, after)
    return d.agg(F.count(F.when(F.col("op") == "add", 1)).alias("triples_added"), F.count(F.when(F.col("op") == "remove", 1)).alias("triples_removed"), F.count_distinct("s").alias("subjects_touched"))


def record(before: QuadGraph, after: QuadGraph, txn: int, ts, user: str) -> DataFrame:
    """The change log of one transaction: txn, ts, user, op, and the quad. A quad that was there before, or never was, leaves no entry."""
    changes = difference(before, after)
    return changes.select(F.lit(txn).cast("bigint").alias("txn"), F.lit(ts).cast("timestamp").alias("ts"), F.lit(user).alias("user"), "op", *KEYS)


class Tracked:
    """A graph whose updates are logged with their user and time, and can be taken back.

    ``engine``: over the graph as it is; ``log``: all changes so far (see record), ready for history().
    """

    def __init__(self, engine, log: DataFrame | None = None, txn: int = 0) -> None:
        self.engine, self.txn = engine, txn
        spark = engine.spark
        self.log = log if log is not None else spark.createDataFrame([], f"txn bigint, ts timestamp, user string, op string, {QUADS.rsplit(',', 1)[0]}")

    def _next(self, engine, user: str, ts) -> Tracked:
        from quadloom.runtime import Spool

        new = Spool(self.engine.spark).write(record(self.engine.graph, engine.graph, self.txn + 1, ts, user))
        return Tracked(engine, self.log.union(new), self.txn + 1)

    def update(self, text: str, user: str, ts) -> Tracked:
        return self._next(self.engine.update(text), user, ts)

    def with_graph(self, graph: QuadGraph, user: str, ts) -> Tracked:
        engine = type(self.engine)(graph, self.engine.prefixes, self.engine.base, self.engine.endpoints)
        engine.functions = self.engine.functions
        return self._next(engine, user, ts)

    def assert_(self, quads: DataFrame, user: str, ts) -> Tracked:
        return self.with_graph(insert(self.engine.graph, quads.select(*KEYS, F.lit(None).cast("bigint").alias("g_line"))), user, ts)

    def retract(self, quads: DataFrame, user: str, ts) -> Tracked:
        return self.with_graph(delete(self.engine.graph, quads), user, ts)

    def take_back(self, txn: int, user: str, ts) -> Tracked:
        """Undoes one transaction, as a new one: what it added goes, what it removed comes back."""
        of = self.log.where(F.col("txn") == txn)
        graph = delete(self.engine.graph, of.where("op = 'add'"))
        back = of.where("op = 'remove'").select(*KEYS, F.lit(None).cast("bigint").alias("g_line"))
        return self.with_graph(insert(graph, back), user, ts)


def history(log: DataFrame, until, user: str | None = None) -> DataFrame:
    """Quads as of a time from a change log (txn, ts, user, op, s, p, o, g): the last change of each quad decides."""
    rows = log.where(F.col("ts") <= F.lit(until))
    rows = rows.where(F.col("user") == user) if user is not None else rows
    last = rows.groupBy(*KEYS).agg(F.max_by("op", F.struct("ts", "txn")).alias("op"))
    return last.where("op = 'add'").select(*KEYS)
