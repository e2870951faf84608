"""Query algebra to DataFrames. The plan stays declarative; Catalyst and adaptive execution choose the physical work.

What Catalyst can't know is settled here: which patterns one scan answers, the order of the joins, which variables may be
unbound (plain or null-compatible join), EXISTS as semi or anti join, property paths as joins, unions and closures.
"""

from __future__ import annotations

import dataclasses
import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom import terms as t
from quadloom.functions.expressions import Scope
from quadloom.operators.paths import closure, reach
from quadloom.plans.algebra import (
    RDF, Aggregate, Alt, Bgp, Call, Exists, Extend, Filter, InGraph, Inverse, Iri, Join, LeftJoin, Lit, Minus, Negated, Once, PropertyFunction, Query, Repeat, Seq, Service, SubSelect, Triple, Union, Values, Var, expression_vars, has_aggregate, visible,
)
from quadloom.plans import serql
from quadloom.sources.graphs import Graph, Rel, bind, union_rels
from quadloom.terms import TERM, Val


#: Rows of the other side that a condition without keys is tried on before all of them.
FEW = 1000


class Compiler:
    def __init__(self, graph: Graph, base: str = "", endpoints: dict[str, Graph] | None = None, property_functions: dict[str, Callable] | None = None, asserted: Graph | None = None) -> None:
        """``asserted``: the graph without entailment, where graph has some."""
        self.g, self.spark, self.base = graph, graph.spark, base
        self.asserted = asserted or graph
        self.endpoints, self.functions = endpoints or {}, property_functions or {}
        self.counter = itertools.count()
        self.default: set[str] | None = None
        self.named: set[str] | None = None

    def fresh(self, hint: str = "h") -> str:
        return f"~{hint}{next(self.counter)}_"

    def scope(self, rel: Rel, flags: dict | None = None) -> Scope:
        return Scope(rel.env, self.g.encode, self.base, flags)

    def unit(self) -> Rel:
        df = self.spark.range(1).select(F.lit(1).alias("~"))
        df._quadloom_unit = True
        return Rel(df, {})

    # patterns; graph is None, an Iri, or (Var, allowed graphs)
    def pattern(self, node, graph=None) -> Rel:
        match node:
            case Bgp():
                return self.bgp(node.triples, graph)
            case Join():
                return self.join(self.pattern(node.left, graph), self.pattern(node.right, graph))
            case LeftJoin():
                return self.left_join(self.pattern(node.left, graph), node.right, node.condition, graph)
            case Union():
                return union_rels([self.pattern(node.left, graph), self.pattern(node.right, graph)])
            case Minus():
                return self.minus(self.pattern(node.left, graph), self.pattern(node.right, graph))
            case Filter():
                return self.filter(self.pattern(node.child, graph), node.condition, graph)
            case Extend():
                rel = self.pattern(node.child, graph)
                return self.extend(rel, node.var.name, node.expr, graph)
            case InGraph():
                ctx = node.graph if isinstance(node.graph, Iri) else (node.graph, self.named)
                if isinstance(ctx, Iri) and self.named is not None and ctx.value not in self.named:
                    ctx = (Var(self.fresh("g")), set())
                return self.pattern(node.child, ctx)
            case Values():
                return self.values(node)
            case SubSelect():
                rel = Compiler.select(self, node.query, graph)
                return Rel(rel.df, {k: v for k, v in rel.env.items() if not k.startswith("~")}, rel.maybe)
            case Service():
                return self.service(node)
            case PropertyFunction():
                raise ValueError("a property function must follow a pattern")
        raise TypeError(f"no pattern: {node!r}")

    def bgp(self, triples: list[Triple], graph) -> Rel:
        ctx = graph if graph is not None else self.default
        triples = [y for x in triples for y in self.unfold(x)]
        plain = [x for x in triples if isinstance(x.p, Iri | Var)]
        direct = [x for x in plain if isinstance(x.p, Iri) and x.p.value in serql.DIRECT]
        rels = self.g.scan(entailed, ctx) if (entailed := [x for x in plain if x not in direct]) else []
        rels += self.asserted.scan([Triple(x.s, Iri(serql.DIRECT[x.p.value]), x.o) for x in direct], ctx) if direct else []
        sizes = []
        for r in rels:
            own = [x for x in plain if all(not isinstance(n, Var) or n.name in r.env for n in (x.s, x.p, x.o))]
            sizes.append(min([self.g.estimate(x, set()) for x in own] or [1e9]))
        for x in triples:
            if not isinstance(x.p, Iri | Var):
                rels.append(self.path_pattern(x, ctx))
                sizes.append(1e5)
        if not rels:
            return self.unit()
        # connected patterns join first, the smallest estimate leading: a cross join stays where the query has one
        left = list(range(len(rels)))
        first = min(left, key=lambda i: sizes[i])
        left.remove(first)
        out = rels[first]
        while left:
            linked = [i for i in left if set(rels[i].env) & set(out.env)] or left
            nxt = min(linked, key=lambda i: sizes[i])
            left.remove(nxt)
            out = self.join(out, rels[nxt])
        return out

    def unfold(self, x: Triple) -> list[Triple]:
        """Sequences and inverses of a path as plain patterns over hidden variables, which keep their native types."""
        match x.p:
            case Inverse(q):
                return self.unfold(Triple(x.o, q, x.s))
            case Seq(parts):
                nodes = [x.s, *[Var(self.fresh("m")) for _ in parts[1:]], x.o]
                return [y for a, q, b in zip(nodes, parts, nodes[1:]) for y in self.unfold(Triple(a, q, b))]
        return [x]

    def apart(self, rel: Rel, names) -> tuple[DataFrame, dict[str, Val]]:
        """The Rel with some columns renamed, so that both sides of a join stay apart."""
        df, env = rel.df, dict(rel.env)
        for n in names:
            new = self.fresh(n.strip("~_"))
            df = df.withColumnRenamed(n, new)
        renamed = dict(zip(rel.df.columns, df.columns))
        for n, v in env.items():
            env[n] = Val(v.kind, df[renamed.get(n, n)], v.prefix, v.dt)
        return df, env

    def join(self, a: Rel, b: Rel) -> Rel:
        shared = [n for n in a.env if n in b.env]
        if not shared:
            if not a.env and a.df.columns == ["~"]:
                return Rel(b.df, b.env, b.maybe) if self._is_unit(a) else self._cross(a, b)
            if not b.env and b.df.columns == ["~"] and self._is_unit(b):
                return a
            return self._cross(a, b)
        loose = [n for n in shared if n in a.maybe or n in b.maybe]
        if len(loose) == len(shared):  # no key is always bound
            return self._split_join(a, b, loose)
        df, env = self.apart(b, shared)
        left = a.df
        cond = F.lit(True)
        for n in shared:
            x, y = t.unify(a.env[n], env[n])
            cond = cond & ((x == y) | x.isNull() | y.isNull() if n in loose else x == y)
        return self._merge(left.join(df, cond), a, env, b, shared, loose)

    def _is_unit(self, r: Rel) -> bool:
        return getattr(r.df, "_quadloom_unit", False)

    def _cross(self, a: Rel, b: Rel) -> Rel:
        df = b.df.withColumnRenamed("~", self.fresh()) if "~" in b.df.columns and "~" in a.df.columns else b.df
        return Rel(a.df.crossJoin(df), {**a.env, **{n: Val(v.kind, df[n], v.prefix, v.dt) for n, v in b.env.items()}}, a.maybe | b.maybe)

    def _merge(self, df: DataFrame, a: Rel, env: dict[str, Val], b: Rel, shared, loose) -> Rel:
        values = {}
        for n, v in a.env.items():
            if n in loose:
                w = env[n]
                if v.kind == w.kind and v.prefix == w.prefix and v.dt == w.dt:
                    v = Val(v.kind, F.coalesce(v.col, w.col), v.prefix, v.dt)
                else:
                    v = Val("term", F.coalesce(t.as_term(v), t.as_term(w)))
            values[n] = v
        for n, v in env.items():
            values.setdefault(n, v)
        maybe = {n for n in (a.maybe | b.maybe) if not (n in shared and not (n in a.maybe and n in b.maybe))}
        return bind(df, values, maybe)

    def _parts(self, a: Rel, b: Rel, loose: list[str]):
        """Null-compatible matching without nested loops: a's rows by the loose variables that they leave unbound, and for each part
        the ways in which rows of b may agree with it: b's rows, renamed, its variables, and the condition (None: all agree)."""
        sides = lambda names, rel: itertools.product(*[(False, True) if n in rel.maybe else (False,) for n in names])
        for unbound in sides(loose, a):
            left, held = a.df, [n for n, u in zip(loose, unbound) if not u]
            for n, u in zip(loose, unbound):
                if n in a.maybe:
                    left = left.where(a.env[n].col.isNull() if u else a.env[n].col.isNotNull())
            ways = []
            for free in sides(held, b):
                right = b.df
                for n, f in zip(held, free):
                    if n in b.maybe:
                        right = right.where(b.env[n].col.isNull() if f else b.env[n].col.isNotNull())
                df, env = self.apart(Rel(right, b.env), b.df.columns)
                cond = None
                for x, y in (t.unify(a.env[n], env[n]) for n, f in zip(held, free) if not f):
                    cond = x == y if cond is None else cond & (x == y)
                ways.append((df, env, cond))
            yield left, ways

    def _split_join(self, a: Rel, b: Rel, loose: list[str], extra: Callable | None = None) -> Rel:
        """One equi-join for each way in which the variables are bound. ``extra``: variables of b to a further condition."""
        parts = []
        for left, ways in self._parts(a, b, loose):
            for df, env, cond in ways:
                if cond is not None:
                    joined = left.join(df, cond if extra is None else cond & extra(env))
                else:  # unbound on one side: each row has each partner
                    joined = self._product(left, df, None if extra is None else extra(env))
                parts.append(self._merge(joined, Rel(left, a.env), env, b, loose, loose))
        out = union_rels(parts)
        out.maybe = {n for n in (a.maybe | b.maybe) if not (n in loose and not (n in a.maybe and n in b.maybe))}
        return out

    @staticmethod
    def _product(left: DataFrame, df: DataFrame, cond: Column | None) -> DataFrame:
        """Rows of b with the rows of a that leave the variables unbound. These, often few, are shuffled, so that adaptive execution
        knows their size, and innermost: neighbouring rows of the result then share what b binds, which files hold once."""
        left = left.hint("rebalance")
        return df.crossJoin(left) if cond is None else df.join(left, cond)

    def _by_condition(self, rest: DataFrame, df: DataFrame, cond: Column) -> tuple[DataFrame, DataFrame]:
        """The rows that have, and those that lack, a row of b under a condition without keys. Most that have one find it among a few
        rows of b; only the others meet all of b, which is never broadcast."""
        among = lambda x, ys: x.join(ys, [x[n].eqNullSafe(ys[f"{n}="]) for n in x.columns], "left_anti")
        open_ = rest.join(df.limit(FEW), cond, "left_anti")
        found = self._product(open_, df, cond).select(*[open_[n].alias(f"{n}=") for n in open_.columns]).distinct()
        lack = among(open_, found)
        return among(rest, lack.select(*[lack[n].alias(f"{n}=") for n in lack.columns]).distinct()), lack

    def _select(self, a: Rel, b: Rel, loose: list[str], keep: bool, extra: Callable | None = None, overlap: bool = False) -> DataFrame:
        """a's rows that have (``keep``) or lack a row of b that agrees with them. ``overlap``: some variable must be bound on both sides."""
        out: list[DataFrame] = []
        for rest, ways in self._parts(a, b, loose):
            for df, env, cond in ways:
                if cond is None and overlap:
                    continue
                if cond is None and extra is None:  # any row of b will do
                    hit, rest = rest.where(df.exists()), rest.where(~df.exists())
                elif cond is None:
                    hit, rest = self._by_condition(rest, df, extra(env))
                else:
                    cond = cond if extra is None else cond & extra(env)
                    hit, rest = rest.join(df, cond, "left_semi"), rest.join(df, cond, "left_anti")
                if keep:
                    out.append(hit)
            if not keep:
                out.append(rest)
        whole = out[0] if out else a.df.limit(0)
        for x in out[1:]:
            whole = whole.union(x)
        return whole

    def _again(self, df: DataFrame, rel: Rel) -> Rel:
        """The Rel over rows of its own columns that went through a union."""
        return Rel(df, {n: Val(v.kind, df[n], v.prefix, v.dt) for n, v in rel.env.items()}, rel.maybe)

    def left_join(self, a: Rel, node, condition, graph) -> Rel:
        if isinstance(node, Filter) and condition is None:
            condition, node = node.condition, node.child
        b = self.pattern(node, graph)
        shared = [n for n in a.env if n in b.env]
        tests = []
        for e in _conjuncts(condition) if condition is not None else ():
            if expression_vars(e) | _named(_exists(e)) <= (set(b.env) | (_named(_exists(e)) - set(a.env))) - set(shared):
                b = self.filter(b, e, graph)  # says nothing of a
            else:
                tests.append(e)
        if any(_exists(e) for e in tests):
            return self._left_join_numbered(a, b, tests, graph)
        loose = [n for n in shared if n in a.maybe or n in b.maybe]

        def holds(env: dict[str, Val]) -> Column:
            merged = {**env, **{n: self._either(v, env[n]) if n in loose else v for n, v in a.env.items()}}
            scope, out = Scope(merged, self.g.encode, self.base), F.lit(True)
            for e in tests:
                out = out & F.coalesce(scope.test(e), F.lit(False))
            return out

        new = [n for n in b.env if n not in a.env]
        maybe = a.maybe | set(new)
        if shared and len(loose) == len(shared):
            extra = holds if tests else None
            matched = self._split_join(a, b, loose, extra)
            alone = self._again(self._select(a, b, loose, False, extra), a)
            out = union_rels([matched, alone])
            return Rel(out.df, out.env, maybe)
        df, env = self.apart(b, [n for n in b.df.columns if n in a.df.columns])
        cond = F.lit(True)
        for n in shared:
            x, y = t.unify(a.env[n], env[n])
            cond = cond & ((x == y) | x.isNull() | y.isNull() if n in loose else x == y)
        joined = a.df.join(df, cond & holds(env) if tests else cond, "left")
        values = {n: self._either(v, env[n]) if n in loose else v for n, v in a.env.items()}
        return bind(joined, values | {n: env[n] for n in new}, maybe)

    def _left_join_numbered(self, a: Rel, b: Rel, tests: list, graph) -> Rel:
        """OPTIONAL whose filter holds EXISTS over variables of both sides: rows are numbered once, solved, and joined back."""
        from quadloom.runtime import Spool

        row = self.fresh("row")
        a = self._again(Spool(self.spark).write(bind(a.df, a.env, a.maybe).df.withColumn(row, F.monotonically_increasing_id())), a)
        inner = self.join(Rel(a.df, {**a.env, row: Val("num", a.df[row], dt="integer")}, a.maybe), b)
        for e in tests:
            inner = self.filter(inner, e, graph)
        df, env = self.apart(inner, inner.df.columns)
        joined = a.df.join(df, a.df[row] == env[row].col, "left")
        values = {n: self._either(v, env[n]) if n in a.maybe else v for n, v in a.env.items()}
        new = [n for n in b.env if n not in a.env]
        return bind(joined, values | {n: env[n] for n in new}, a.maybe | set(new))

    @staticmethod
    def _either(v: Val, w: Val) -> Val:
        """The value of a variable that one side may leave unbound."""
        if (v.kind, v.prefix, v.dt) == (w.kind, w.prefix, w.dt):
            return Val(v.kind, F.coalesce(v.col, w.col), v.prefix, v.dt)
        return Val("term", F.coalesce(t.as_term(v), t.as_term(w)))

    def minus(self, a: Rel, b: Rel) -> Rel:
        shared = [n for n in a.env if n in b.env]
        if not shared:
            return a
        loose = [n for n in shared if n in a.maybe or n in b.maybe]
        if len(loose) == len(shared):
            return self._again(self._select(a, b, loose, False, overlap=True), a)
        df, env = self.apart(b, b.df.columns)
        cond = F.lit(True)
        for n in shared:
            x, y = t.unify(a.env[n], env[n])
            cond = cond & ((x == y) | x.isNull() | y.isNull() if n in loose else x == y)
        return Rel(a.df.join(df, cond, "left_anti"), a.env, a.maybe)

    def filter(self, rel: Rel, condition, graph) -> Rel:
        for part in _conjuncts(condition):
            negated = False
            while isinstance(part, Call) and part.name == "!" and isinstance(part.args[0], Exists):
                part, negated = part.args[0], not negated
            if isinstance(part, Exists):
                rel = self._exists_join(rel, part, graph, part.negated == negated)
            else:
                rel, flags = self._flags(rel, part, graph)
                rel = Rel(rel.df.where(self.scope(rel, flags).test(part)), rel.env, rel.maybe)
        return rel

    def _exists_join(self, rel: Rel, e: Exists, graph, keep: bool) -> Rel:
        """The solutions for which the pattern has a solution (``keep``), or has none; negation of e is up to the caller."""
        node, inner = e.pattern, None
        if isinstance(node, Filter) and not expression_vars(node.condition) <= set(visible(node.child)):
            node, inner = node.child, node.condition  # the filter sees variables of the outer solution
        b = self.pattern(node, graph)
        holds = None
        if inner is not None:
            if _exists(inner):
                raise ValueError("EXISTS within EXISTS over variables of the outer solution")
            holds = lambda env: F.coalesce(Scope({**env, **rel.env}, self.g.encode, self.base).test(inner), F.lit(False))
        shared = [n for n in rel.env if n in b.env]
        loose = [n for n in shared if n in rel.maybe or n in b.maybe]
        if len(loose) == len(shared):
            return self._again(self._select(rel, b, loose, keep, holds), rel)
        df, env = self.apart(b, b.df.columns)
        cond = F.lit(True)
        for n in shared:
            x, y = t.unify(rel.env[n], env[n])
            cond = cond & ((x == y) | x.isNull() | y.isNull() if n in loose else x == y)
        cond = cond & holds(env) if holds else cond
        return Rel(rel.df.join(df, cond, "left_semi" if keep else "left_anti"), rel.env, rel.maybe)

    def _flags(self, rel: Rel, e, graph) -> tuple[Rel, dict[int, Column]]:
        """For EXISTS inside a larger expression: a flag column per pattern, by outer join with its distinct shared variables; where
        these may be unbound or the pattern's filter sees the outer solution, by a semi and an anti join."""
        flags = {}
        for x in _exists(e):
            flag = self.fresh("f")
            b = self.pattern(x.pattern, graph)
            shared = [n for n in rel.env if n in b.env]
            outer = isinstance(x.pattern, Filter) and not expression_vars(x.pattern.condition) <= set(visible(x.pattern.child))
            if outer or not shared or any(n in rel.maybe or n in b.maybe for n in shared):
                rel = bind(rel.df, rel.env, rel.maybe)
                yes, no = (self._exists_join(rel, x, graph, k).df.withColumn(flag, F.lit(k)) for k in (True, False))
                rel = self._again(yes.union(no), rel)
                hit = rel.df[flag]
            else:
                df, env = self.apart(b, b.df.columns)
                keys = [t.unify(rel.env[n], env[n]) for n in shared]
                right = df.select(*[y.alias(f"{flag}{i}") for i, (_, y) in enumerate(keys)]).distinct().withColumn(flag, F.lit(True))
                cond = F.lit(True)
                for i, (y, _) in enumerate(keys):
                    cond = cond & (y == right[f"{flag}{i}"])
                joined = rel.df.join(right, cond, "left")
                rel = Rel(joined.drop(*[f"{flag}{i}" for i in range(len(keys))]), rel.env, rel.maybe)
                hit = rel.df[flag].isNotNull()
            flags[id(x)] = ~hit if x.negated else hit
        return rel, flags

    def extend(self, rel: Rel, name: str, expr, graph=None) -> Rel:
        rel, flags = self._flags(rel, expr, graph)
        v = self.scope(rel, flags).value(expr)
        if name in rel.env and name in rel.maybe:
            x, y = t.unify(rel.env[name], v)
            rel = Rel(rel.df.where(x.isNull() | (x == y)), {k: w for k, w in rel.env.items() if k != name}, rel.maybe)
        sure = isinstance(expr, Iri | Lit) or isinstance(expr, Var) and expr.name in rel.env and expr.name not in rel.maybe
        return bind(rel.df, {**{n: w for n, w in rel.env.items() if n != name}, name: v}, (rel.maybe - {name}) | (set() if sure else {name}))

    def values(self, node: Values) -> Rel:
        names = [v.name for v in node.vars]
        if not names:
            return self.unit() if node.rows else Rel(self.unit().df.limit(0), {})

        def cell(x):
            if x is None:
                return None
            if isinstance(x, Iri):
                return (1, self.g.encode(x.value), "", "")
            return (3, x.lex, "" if x.dt in t.STRINGS else self.g.encode(x.dt), x.lang)

        df = self.spark.createDataFrame([tuple(map(cell, r)) for r in node.rows], ", ".join(f"`{n}` {TERM}" for n in names))
        maybe = {n for i, n in enumerate(names) if any(r[i] is None for r in node.rows)}
        plain = {}
        for i, n in enumerate(names):  # columns of one kind stay native, so that they join with native keys
            kinds = {type(r[i]) for r in node.rows if r[i] is not None}
            strings = all(r[i] is None or isinstance(r[i], Lit) and not r[i].lang and r[i].dt in ("", *t.STRINGS) for r in node.rows)
            plain[n] = Val("iri", F.col(f"`{n}`.lex")) if kinds == {Iri} else Val("str", F.col(f"`{n}`.lex")) if kinds == {Lit} and strings else Val("term", F.col(f"`{n}`"))
        return bind(df, plain, maybe)

    def service(self, node: Service) -> Rel:
        name = node.endpoint.value if isinstance(node.endpoint, Iri) else None
        if name not in self.endpoints:
            if node.silent:
                return self.unit()
            raise ValueError(f"no endpoint is registered as {name}")
        other = Compiler(self.endpoints[name], self.base, self.endpoints, self.functions)
        try:
            return other.pattern(node.child)
        except Exception:  # whatever fails within a silent service gives one solution without bindings
            if node.silent:
                return self.unit()
            raise

    # property paths
    def path_pattern(self, x: Triple, graph) -> Rel:
        ends = [(x.s, Val("term", F.col("s"))), (x.o, Val("term", F.col("o")))]
        if isinstance(graph, tuple):  # nodes carry their graph along the path
            tagged = Compiler(Tagged(self.g, graph)).path(x.p, None)
            pairs = tagged.select(F.col("s.n").alias("s"), F.col("o.n").alias("o"), F.col("s.g").alias("g"))
            ends.append((graph[0], Val("iri", F.col("g"))))
        else:
            pairs = self.path(x.p, graph, x.s if not isinstance(x.s, Var) else None, x.o if not isinstance(x.o, Var) else None)
        values, tests = {}, []
        for node, v in ends:
            col = v.col
            if not isinstance(node, Var):
                tests.append(col == t.as_term(t.constant(node, self.g.encode)))
            elif node.name in values:
                tests.append(t.same_term(values[node.name], v))
            else:
                values[node.name] = v
        for c in tests:
            pairs = pairs.where(c)
        return bind(pairs, values)

    def path(self, p, graph, s=None, o=None) -> DataFrame:
        """(s, o) pairs of a path; s and o are constants that bind an end, which seed the closures."""
        const = lambda n: t.as_term(t.constant(n, self.g.encode))
        match p:
            case Iri():
                df = self.g.edges([p.value], graph)
                df = df.where(F.col("s") == const(s)) if s is not None else df
                return df.where(F.col("o") == const(o)) if o is not None else df
            case Inverse(q):
                return self.path(q, graph, o, s).select(F.col("o").alias("s"), F.col("s").alias("o"))
            case Seq(parts):
                out = self.path(parts[0], graph, s, o if len(parts) == 1 else None)
                for k, q in enumerate(parts[1:], 1):
                    nxt = self.path(q, graph, None, o if k == len(parts) - 1 else None).select(F.col("s").alias("_m"), F.col("o").alias("_o"))
                    out = out.join(nxt, out["o"] == nxt["_m"]).select("s", F.col("_o").alias("o"))
                return out
            case Alt(parts):
                out = self.path(parts[0], graph, s, o)
                for q in parts[1:]:
                    out = out.union(self.path(q, graph, s, o))
                return out
            case Negated(forward, backward):
                out = None
                if forward or not backward:
                    out = self.g.edges(list(forward), graph, negated=True)
                if backward:
                    back = self.g.edges(list(backward), graph, negated=True).select(F.col("o").alias("s"), F.col("s").alias("o"))
                    out = back if out is None else out.union(back)
                return out
            case Once(q):
                return self.path(q, graph, s, o).distinct()
            case Repeat(q, least, many):
                return self._repeat(q, least, many, graph, s, o)
        raise TypeError(f"no path: {p!r}")

    def _repeat(self, q, least: int, many: bool, graph, s, o) -> DataFrame:
        const = lambda n: t.as_term(t.constant(n, self.g.encode))
        if s is None and o is not None:  # backward from the bound end
            return self._repeat(Inverse(q), least, many, graph, o, None).select(F.col("o").alias("s"), F.col("s").alias("o"))
        if many:
            edges = self.path(q, graph)
            out = reach(edges.where(F.col("s") == const(s)), edges) if s is not None else closure(edges)
        else:
            out = self.path(q, graph, s)
        if least == 0:
            if s is not None:
                zero = self.spark.range(1).select(const(s).alias("s"), const(s).alias("o"))
            else:
                zero = self.g.nodes(graph).select(F.col("n").alias("s"), F.col("n").alias("o"))
            out = out.union(zero).distinct()
        return out.where(F.col("o") == const(o)) if o is not None else out

    # query forms
    def sequence(self, node, graph=None) -> Rel:
        """A pattern in which property functions apply to what comes before them."""
        if isinstance(node, Join) and isinstance(node.right, PropertyFunction):
            return self.apply(node.right, self.sequence(node.left, graph), graph)
        if isinstance(node, PropertyFunction):
            return self.apply(node, self.unit(), graph)
        if isinstance(node, Join):
            return self.join(self.sequence(node.left, graph), self.pattern(node.right, graph))
        if isinstance(node, Filter):
            return self.filter(self.sequence(node.child, graph), node.condition, graph)
        if isinstance(node, Extend):
            return self.extend(self.sequence(node.child, graph), node.var.name, node.expr, graph)
        return self.pattern(node, graph)

    def apply(self, call: PropertyFunction, rel: Rel, graph) -> Rel:
        return self.functions[call.name](self, rel, call.subject, call.object, graph)

    def where(self, q: Query, graph=None) -> Rel:
        keep = self.default, self.named
        if q.default_graphs or q.named_graphs:
            self.default, self.named = set(q.default_graphs), set(q.named_graphs)
        try:
            rel = self.sequence(q.where, graph)
            return self.join(rel, self.values(q.values)) if q.values else rel
        finally:
            self.default, self.named = keep

    def select(self, q: Query, graph=None) -> Rel:
        if q.values and (q.group or q.items and any(has_aggregate(e) for _, e in q.items)):
            inner, values = q.values, None
            q = Query(**{**q.__dict__, "values": None})
            return self.join(self.select(q, graph), self.values(inner))
        rel = self.where(q, graph)
        items = q.items if q.items is not None else [(Var(n), Var(n)) for n in rel.env if not n.startswith("~")]
        order = q.order
        if q.group or any(has_aggregate(e) for _, e in items) or any(map(has_aggregate, q.having)):
            rel, items, order = self.aggregate(rel, q, items, graph)
        for v, e in items:
            if v is not e and v != e:
                rel = self.extend(rel, v.name, e, graph)
            elif v.name not in rel.env:
                rel = bind(rel.df, {**rel.env, v.name: Val("term", F.lit(None).cast(TERM))}, rel.maybe | {v.name})
        names = [v.name for v, _ in items]
        keys = []
        for e, down in order:
            for k in t.sort_keys(self.scope(rel).value(e)):
                keys.append(k.desc_nulls_last() if down else k.asc_nulls_first())
        picked = {n: rel.env[n] for n in dict.fromkeys(names)}
        if q.distinct and keys:
            # distinct rows in the order of their first place
            ranked = rel.df.select(*[rel.env[n].col.alias(n) for n in picked], *[k.alias(f"~k{i}") for i, k in enumerate(self._bare(order, rel))])
            rel2 = ranked.groupBy(*[f"`{n}`" for n in picked]).agg(*[F.min(f"`~k{i}`").alias(f"~k{i}") for i in range(len(self._bare(order, rel)))])
            downs = [down for e, down in order for _ in t.sort_keys(self.scope(rel).value(e))]
            rel2 = rel2.orderBy(*[F.col(f"`~k{i}`").desc_nulls_last() if d else F.col(f"`~k{i}`").asc_nulls_first() for i, d in enumerate(downs)])
            out = bind(rel2, {n: Val(v.kind, F.col(f"`{n}`"), v.prefix, v.dt) for n, v in picked.items()}, rel.maybe & set(picked))
        else:
            df = rel.df.orderBy(*keys) if keys else rel.df
            out = bind(df, picked, rel.maybe & set(picked))
            if q.distinct:
                out = Rel(out.df.distinct(), out.env, out.maybe)
        df = out.df.offset(q.offset) if q.offset else out.df
        df = df.limit(q.limit) if q.limit is not None else df
        return Rel(df, {n: Val(v.kind, df[n], v.prefix, v.dt) for n, v in out.env.items()}, out.maybe)

    def _bare(self, order, rel: Rel) -> list[Column]:
        return [k for e, _ in order for k in t.sort_keys(self.scope(rel).value(e))]

    def aggregate(self, rel: Rel, q: Query, items, graph) -> tuple[Rel, list, list]:
        for v, e in q.group:
            if v is not e:
                rel = self.extend(rel, v.name, e, graph)
        keys = {v.name: rel.env.get(v.name) or Val("term", F.lit(None).cast(TERM)) for v, _ in q.group}
        found: dict[Aggregate, str] = {}

        def lift(e):
            match e:
                case Aggregate():
                    return Var(found.setdefault(e, self.fresh("a")))
                case Call(name, args):
                    return Call(name, tuple(map(lift, args)))
            return e

        items = [(v, v if v is e else lift(e)) for v, e in items]
        having = [lift(e) for e in q.having]
        order = [(lift(e), down) for e, down in q.order]
        scope = self.scope(rel)
        aggs, kinds = [], {}
        for a, name in found.items():
            col, kind, dt = self._aggregate(a, scope, rel)
            aggs.append(col.alias(name))
            kinds[name] = (kind, dt)
        grouped = rel.df.groupBy(*[v.col.alias(n) for n, v in keys.items()])
        df = grouped.agg(*aggs) if aggs else grouped.agg(F.count(F.lit(1)).alias(self.fresh("n")))
        env = {n: Val(v.kind, df[n], v.prefix, v.dt) for n, v in keys.items()}
        env |= {n: Val(k, df[n], dt=dt) for n, (k, dt) in kinds.items()}
        out = Rel(df, env, (rel.maybe & set(keys)) | set(kinds))
        for e in having:
            out = self.filter(out, e, graph)
        return out, items, order

    def _aggregate(self, a: Aggregate, scope: Scope, rel: Rel) -> tuple[Column, str, str]:
        if a.arg is None:
            if a.distinct:
                return F.count_distinct(F.struct(*[v.col for v in rel.env.values()])), "num", "integer"
            return F.count(F.lit(1)), "num", "integer"
        v = scope.value(a.arg)
        match a.name:
            case "count":
                return (F.count_distinct(v.col) if a.distinct else F.count(v.col)), "num", "integer"
            case "sum":
                n = t.number(v)
                zero = F.lit(0).cast("bigint" if v.dt == "integer" else "double")
                return F.coalesce((F.sum_distinct if a.distinct else F.sum)(n), zero), "num", v.dt or "double"
            case "avg":
                n = t.number(v).cast("double")
                mean = F.sum_distinct(n) / F.count_distinct(n) if a.distinct else F.avg(n)
                return F.coalesce(F.when(F.count(n) > 0, mean), F.lit(0.0)), "num", "decimal" if v.dt != "double" else "double"
            case "min" | "max":
                best = F.min if a.name == "min" else F.max
                if v.kind == "term":
                    return F.when(F.count(v.col) > 0, best(F.when(v.col.isNotNull(), t.order_value(v)))["t"]), "term", ""
                return (best(t.lexical(v)), "iri", "") if v.kind == "key" else (best(t.order_value(v)), v.kind, v.dt)
            case "sample":
                return self._aggregate(dataclasses.replace(a, name="min"), scope, rel)  # the least is as good as any, and the same in every run
            case "group_concat":
                s = t.lexical(v)
                parts = F.sort_array(F.collect_set(s) if a.distinct else F.collect_list(s))
                return F.array_join(parts, a.separator), "str", ""
        raise ValueError(f"no aggregate: {a.name}")

    def template(self, rel: Rel, triples: list[Triple]) -> DataFrame:
        """(s, p, o) of a CONSTRUCT: rows with an unbound or ill-placed term give no triple; blank nodes are fresh in each row."""
        labels = {n.name for x in triples for n in (x.s, x.o) if isinstance(n, Var) and n.name.startswith("~") and n.name not in rel.env}
        df = rel.df.withColumn("~row", F.regexp_replace(F.uuid(), "-", "")) if labels else rel.df
        env = dict(rel.env)
        for n in labels:
            env[n] = Val("term", t.struct(2, F.concat(F.lit(f"_:{n.strip('~')}_"), F.col("`~row`"))))
        scope = Scope(env, self.g.encode, self.base)
        cells = [F.struct(t.as_term(scope.value(x.s)).alias("s"), t.lexical(scope.value(x.p)).alias("p"), t.as_term(scope.value(x.o)).alias("o"), _is_iri(scope.value(x.p)).alias("ok")) for x in triples]
        out = df.select(F.explode(F.array(*cells)).alias("t")).select("t.*")
        return out.where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL AND ok AND s.k < 3").select("s", "p", "o")


class Tagged(Graph):
    """A graph whose nodes are structs of graph and term, for paths under GRAPH with a variable."""

    def __init__(self, graph: Graph, context: tuple) -> None:
        self.inner, self.context, self.spark = graph, context, graph.spark

    def encode(self, iri: str) -> str:
        return self.inner.encode(iri)

    def edges(self, predicates: list[str] | None, graph, negated: bool = False) -> DataFrame:
        v = [Var("~ts"), Var("~tp"), Var("~to")]
        rel = self.inner.scan([Triple(*v)], self.context)[0]
        g, p = t.lexical(rel.env[self.context[0].name]), t.lexical(rel.env["~tp"])
        df = rel.df
        if predicates is not None:
            inside = p.isin([self.encode(x) for x in predicates])
            df = df.where(~inside if negated else inside)
        node = lambda n: F.struct(g.alias("g"), t.as_term(rel.env[n]).alias("n"))
        return df.select(node("~ts").alias("s"), node("~to").alias("o")).distinct()

    def nodes(self, graph) -> DataFrame:
        e = self.edges(None, None)
        return e.select(F.col("s").alias("n")).union(e.where("o.n.k < 3").select("o")).distinct()


def _is_iri(v: Val) -> Column:
    return v.col["k"] == 1 if v.kind == "term" else F.lit(t.is_resource(v))


def _conjuncts(e) -> list:
    if isinstance(e, Call) and e.name == "&&":
        return _conjuncts(e.args[0]) + _conjuncts(e.args[1])
    return [e]


def _named(x) -> set[str]:
    """Every variable named anywhere in a pattern or expression."""
    if isinstance(x, Var):
        return {x.name}
    if isinstance(x, tuple | list):
        return set().union(*map(_named, x)) if x else set()
    if dataclasses.is_dataclass(x):
        return set().union(*[_named(getattr(x, f.name)) for f in dataclasses.fields(x)])
    return set()


def _exists(e) -> list[Exists]:
    match e:
        case Exists():
            return [e]
        case Call():
            return [x for a in e.args for x in _exists(a)]
    return []
