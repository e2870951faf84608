"""Graphs that queries scan: quad tables, and virtual graphs over ordinary tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import terms as t
from quadloom.plans.algebra import RDF, XSD, Iri, Lit, Triple, Var
from quadloom.terms import TERM, Val

TOKEN_BREAK = r"[^\p{L}\p{N}]+"
TOKEN_BUCKETS = 64


def token_bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(TOKEN_BUCKETS)).cast("int")


QUADS = "s struct<k:int,lex:string,dt:string,lang:string>, p string, o struct<k:int,lex:string,dt:string,lang:string>, g string, g_line bigint"


@dataclass
class Rel:
    """Solutions: a DataFrame, the typed variables in it, and the variables that may be unbound."""

    df: DataFrame
    env: dict[str, Val]
    maybe: set[str] = field(default_factory=set)


def bind(df: DataFrame, values: dict[str, Val], maybe: set[str] = frozenset()) -> Rel:
    """A Rel whose columns are named after its variables."""
    df = df.select(*[v.col.alias(n) for n, v in values.items()]) if values else df.select(F.lit(1).alias("~"))
    return Rel(df, {n: Val(v.kind, df[n], v.prefix, v.dt) for n, v in values.items()}, set(maybe))


class Graph:
    """encode: IRI of a query to the form that the table holds."""

    spark: SparkSession

    def encode(self, iri: str) -> str:
        return iri

    def scan(self, triples: list[Triple], graph) -> list[Rel]:
        """One Rel per group of triples that a single scan answers. graph: None (all), an Iri, a Var, or a set of IRIs."""
        raise NotImplementedError

    def estimate(self, triple: Triple, bound: set[str]) -> float:
        const = lambda x: not isinstance(x, Var) or x.name in bound
        s, p, o = const(triple.s), isinstance(triple.p, Iri), const(triple.o)
        return {(True, True): 1.0, (True, False): 10.0, (False, True): 100.0, (False, False): 10_000.0}[(s, o)] * (1 if p else 50)

    def edges(self, predicates: list[str] | None, graph, negated: bool = False) -> DataFrame:
        """Distinct (s, o) TERM pairs over the predicates; all of them where None; all others where negated."""
        raise NotImplementedError

    def edge_rows(self, predicates: list[str], graph) -> DataFrame:
        """(s, o) TERM pairs over the predicates in the order of the table; a pair may be there more than once."""
        return self.edges(predicates, graph)

    def nodes(self, graph) -> DataFrame:
        """Distinct subjects and resource objects, column n."""
        e = self.edges(None, graph)
        return e.select(F.col("s").alias("n")).union(e.where("o.k < 3").select("o")).distinct()


class QuadGraph(Graph):
    """A table s (TERM), p, o (TERM), g, g_line. Partition it by p for pruning. ``compact``: namespaces to the short forms it uses.

    A triple that several graphs hold, or one graph twice, counts once in the union of all graphs, and once in each graph.
    ``merged`` states that no quad is held twice, which spares the scans a distinct; see ``store``.
    """

    def __init__(self, quads: DataFrame, compact: dict[str, str] | None = None, merged: bool = False, predicate_counts: dict[str, int] | None = None, triples: DataFrame | None = None) -> None:
        self.quads, self.spark, self.compact, self.merged = quads, quads.sparkSession, compact or {}, merged
        self.predicate_counts = predicate_counts or {}
        self.tokens: DataFrame | None = None  # token, s, p, o, bucket: where a store keeps an index of words
        self.triples = triples  # the union of all graphs, each triple once, where a store keeps it

    @classmethod
    def from_statements(cls, rdf: DataFrame, compact: dict[str, str] | None = None) -> QuadGraph:
        """From flattened statements (s_k, s_lex, p_lex, o_k, o_lex, o_dt, o_lang, g_iri, g_line); rows without a term are none."""
        dt = F.when(F.col("o_dt").isin(t.STRINGS), "").otherwise(F.coalesce("o_dt", F.lit("")))
        quads = rdf.where("s_lex IS NOT NULL AND p_lex IS NOT NULL AND o_lex IS NOT NULL").select(
            t.struct(F.coalesce("s_k", F.lit(1)), F.col("s_lex")).alias("s"), F.col("p_lex").alias("p"), t.struct(F.coalesce("o_k", F.lit(1)), F.col("o_lex"), dt, F.coalesce("o_lang", F.lit(""))).alias("o"), F.col("g_iri").alias("g"), "g_line"
        )
        return cls(quads, compact or {RDF: "rdf:", "http://www.w3.org/2000/01/rdf-schema#": "rdfs:", "http://www.w3.org/2002/07/owl#": "owl:", "http://www.w3.org/2004/02/skos/core#": "skos:", XSD: "xsd:"})

    def store(self, path: str) -> QuadGraph:
        """Writes the graph for many queries: triples of the union and quads, each once, partitioned by predicate and sorted by subject.

        Bound predicates then prune files, bound subjects row groups, and scans need no distinct. Beside them lie the number of
        triples of each predicate, for the order of joins, and an index of the words of plain literals, for text search.
        """
        put = lambda df, name: df.repartition("p", F.pmod(F.xxhash64("s"), F.lit(16))).sortWithinPartitions("p", "s").write.partitionBy("p").parquet(f"{path}/{name}")
        put(self.quads.select("s", "p", "o").distinct(), "triples")
        put(self.quads.select("s", "p", "o", "g").distinct().withColumn("g_line", F.lit(None).cast("bigint")), "quads")
        stored = self.spark.read.schema(QUADS).parquet(f"{path}/triples").select("s", "p", "o")
        stored.groupBy("p").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/counts")
        literals = stored.where("o.k = 3 AND o.dt = ''")
        tokens = literals.select(F.explode(F.array_distinct(F.transform(F.split("o.lex", TOKEN_BREAK), lambda w: F.lower(w)))).alias("token"), "s", "p", "o").where("token <> ''")
        tokens = tokens.withColumn("bucket", token_bucket(F.col("token")))
        tokens.repartition("bucket", F.pmod(F.xxhash64("s"), F.lit(16))).sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{path}/tokens")
        return QuadGraph.open(self.spark, path, self.compact)

    @classmethod
    def open(cls, spark: SparkSession, path: str, compact: dict[str, str] | None = None) -> QuadGraph:
        cols = ["s", "p", "o", "g", "g_line"]
        read = lambda name, k: spark.read.schema(QUADS).parquet(f"{path}/{name}").select(*cols[:k])
        out = cls(read("quads", 5), compact, merged=True, triples=read("triples", 3))
        out.tokens = spark.read.schema(f"token string, s {TERM}, p string, o {TERM}, bucket int").parquet(f"{path}/tokens")
        out._counted(spark.read.schema("p string, n bigint").parquet(f"{path}/counts"))
        return out

    @classmethod
    def from_triples(cls, spark: SparkSession, triples: list[tuple], graph: str | None = "user") -> QuadGraph:
        """From (s, p, o) or (s, p, o, g) of strings and Lits; '_:x' is a blank node."""

        def term(x):
            if isinstance(x, Lit):
                return (3, x.lex, "" if x.dt in t.STRINGS else x.dt, x.lang)
            x = x.value if isinstance(x, Iri) else x
            return (2 if x.startswith("_:") else 1, x, "", "")

        rows = [(term(q[0]), q[1].value if isinstance(q[1], Iri) else q[1], term(q[2]), q[3] if len(q) > 3 else graph, None) for q in triples]
        return cls(spark.createDataFrame(rows, QUADS))

    def encode(self, iri: str) -> str:
        for space, short in self.compact.items():
            if iri.startswith(space):
                return short + iri[len(space) :]
        return iri

    def derive(self, quads: DataFrame) -> QuadGraph:
        return QuadGraph(quads, self.compact)

    def estimate(self, triple: Triple, bound: set[str]) -> float:
        n = super().estimate(triple, bound)
        if isinstance(triple.p, Iri) and self.predicate_counts:
            n *= max(1, self.predicate_counts.get(self.encode(triple.p.value), 0)) / max(1, max(self.predicate_counts.values()))
        return n

    def with_statistics(self) -> QuadGraph:
        """Counts per predicate, for the order of joins."""
        self._counted(self.quads.groupBy("p").agg(F.count(F.lit(1)).alias("n")))
        return self

    def _counted(self, counts: DataFrame) -> None:
        """The vocabulary is assumed to fit the driver; where it does not, joins are ordered by constants alone."""
        rows = counts.limit(100_001).collect()
        if len(rows) <= 100_000:
            self.predicate_counts = {r.p: r.n for r in rows}

    def _of_graph(self, graph) -> DataFrame:
        q = self.quads
        if graph is None and self.triples is not None:
            return self.triples
        if isinstance(graph, Iri):
            return q.where(F.col("g") == self.encode(graph.value))
        if isinstance(graph, set):
            return q.where(F.col("g").isin([self.encode(x) for x in graph]))
        if isinstance(graph, tuple):  # a variable over named graphs
            return q.where(F.col("g").isNotNull() if graph[1] is None else F.col("g").isin([self.encode(x) for x in graph[1]]))
        return q

    def scan(self, triples: list[Triple], graph) -> list[Rel]:
        return [self._one(x, graph) for x in triples]

    def _one(self, triple: Triple, graph) -> Rel:
        df = self._of_graph(graph)
        values: dict[str, Val] = {}
        again = []
        parts = [(triple.s, Val("term", F.col("s"))), (triple.p, Val("iri", F.col("p"))), (triple.o, Val("term", F.col("o")))]
        if isinstance(graph, tuple):
            parts.append((graph[0], Val("iri", F.col("g"))))
        for node, v in parts:
            if isinstance(node, Var):
                if node.name in values:
                    a, b = t.unify(values[node.name], v)
                    again.append(a == b)
                else:
                    values[node.name] = v
            elif v.kind == "iri":
                df = df.where(v.col == self.encode(node.value))
            elif isinstance(node, Iri):
                df = df.where((v.col["lex"] == self.encode(node.value)) & (v.col["k"] < 3))
            else:
                df = df.where((v.col["k"] == 3) & (v.col["lex"] == node.lex) & (v.col["dt"] == ("" if node.dt in t.STRINGS else self.encode(node.dt))) & (F.lower(v.col["lang"]) == node.lang.lower()))
        for c in again:
            df = df.where(c)
        rel = bind(df, values)
        # a store holds each quad once, so only sets of several graphs may still hold a triple twice
        once = self.merged and not isinstance(graph, set) and (graph is not None or self.triples is not None)
        if not once:
            rel = bind(rel.df.distinct(), rel.env) if values else Rel(rel.df.limit(1), {})
        return rel

    def edges(self, predicates: list[str] | None, graph, negated: bool = False) -> DataFrame:
        df = self._of_graph(graph)
        if predicates is not None:
            inside = F.col("p").isin([self.encode(p) for p in predicates])
            df = df.where(~inside if negated else inside)
        return df.select("s", "o").distinct()

    def edge_rows(self, predicates: list[str], graph) -> DataFrame:
        return self._of_graph(graph).where(F.col("p").isin([self.encode(p) for p in predicates])).select("s", "o")


@dataclass
class Column_:
    """A column of a mapped table: a literal, or the key of another subject prefix."""

    name: str
    kind: str = "str"  # str, num, bool, ts, key, lang
    dt: str = ""
    prefix: str = ""
    lang: str = ""  # column that holds the language tag


@dataclass
class Mapping:
    """Rows of a table as subjects <prefix><key>, of a class, with one predicate per column. A null cell is no triple."""

    table: str
    prefix: str
    key: str | None  # None: a blank node per row
    columns: dict[str, Column_]
    class_iri: str
    graph: str


_FLAT = {"string": ("str", ""), "boolean": ("bool", ""), "timestamp": ("ts", ""), "timestamp_ntz": ("ts", ""), "date": ("ts", "")} | {k: ("num", "integer") for k in ("tinyint", "smallint", "int", "bigint")} | {k: ("num", "double") for k in ("float", "double")}


class VirtualGraph(Graph):
    """Tables as graphs: patterns that share a subject over one table collapse to one scan of the columns they name."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], mappings: list[Mapping], base: str = "urn:t:") -> None:
        self.spark, self.tables, self.base = spark, tables, base
        self.mappings = mappings
        self.by_predicate: dict[str, list[Mapping]] = {}
        for m in mappings:
            for p in m.columns:
                self.by_predicate.setdefault(base + p, []).append(m)

    def _candidates(self, triples: list[Triple], graph) -> list[Mapping]:
        out = list(self.mappings)
        for x in triples:
            if isinstance(x.p, Iri):
                if x.p.value == RDF + "type":
                    out = [m for m in out if not isinstance(x.o, Iri) or m.class_iri == x.o.value]
                else:
                    out = [m for m in out if any(m is y for y in self.by_predicate.get(x.p.value, ()))]
            if isinstance(x.s, Iri):
                out = [m for m in out if m.key and x.s.value.startswith(m.prefix)]
        if isinstance(graph, Iri):
            out = [m for m in out if m.graph == graph.value]
        if isinstance(graph, set):
            out = [m for m in out if m.graph in graph]
        if isinstance(graph, tuple) and graph[1] is not None:
            out = [m for m in out if m.graph in graph[1]]
        return out

    def scan(self, triples: list[Triple], graph) -> list[Rel]:
        stars: dict[object, list[Triple]] = {}
        for x in triples:
            stars.setdefault(x.s, []).append(x)
        out = []
        for star in stars.values():
            groups = [star]
            if not self._candidates(star, graph) or any(isinstance(x.p, Var) for x in star):
                groups = [[x] for x in star]  # the patterns lie in several tables
            out += [self._star(g, graph) for g in groups]
        return out

    def _star(self, star: list[Triple], graph) -> Rel:
        rels = []
        for m in self._candidates(star, graph):
            rels += self._table(m, star, graph)
        if not rels:
            names = dict.fromkeys(x.name for tr in star for x in (tr.s, tr.p, tr.o) if isinstance(x, Var))
            if isinstance(graph, tuple):
                names[graph[0].name] = None
            empty = self.spark.createDataFrame([], ", ".join(f"`{n}` {TERM}" for n in names) or "`~` int")
            return bind(empty, {n: Val("term", F.col(f"`{n}`")) for n in names})
        return union_rels(rels)

    def _subject(self, m: Mapping) -> Val:
        if m.key is None:
            file = F.xxhash64(F.col("_metadata.file_path"))
            return Val("key", F.concat_ws("_", file.cast("string"), F.col("_metadata.row_index").cast("string")), f"_:{m.table}_")
        return Val("key", F.col(m.key), m.prefix)

    def _table(self, m: Mapping, star: list[Triple], graph) -> list[Rel]:
        df = self.tables[m.table]
        subject = self._subject(m)
        options: list[list[tuple[Triple, str | None]]] = [[]]
        for x in star:
            if isinstance(x.p, Var):
                choices = [(x, p) for p in m.columns] + [(x, None)]
            else:
                choices = [(x, None if x.p.value == RDF + "type" else x.p.value[len(self.base) :])]
            options = [o + [c] for o in options for c in choices]
        out = []
        for chosen in options:
            values: dict[str, Val] = {}
            tests: list[Column] = []

            def put(node, v: Val) -> None:
                if not isinstance(node, Var):
                    c = t.constant(node)
                    if v.kind == "key" and isinstance(node, Iri):
                        if not node.value.startswith(v.prefix):
                            tests.append(F.lit(False))
                            return
                        rest = node.value[len(v.prefix) :]
                        tests.append(v.col == F.lit(rest).try_cast(dict(df.dtypes).get(m.key, "string") if v.col is subject.col else "bigint"))
                    else:
                        tests.append(t.equal(v, c))
                elif node.name in values:
                    a, b = t.unify(values[node.name], v)
                    tests.append(a == b)
                else:
                    values[node.name] = v

            put(star[0].s, subject)
            for x, p in chosen:
                if isinstance(x.p, Var):
                    put(x.p, Val("iri", F.lit(RDF + "type" if p is None else self.base + p)))
                if p is None:
                    put(x.o, Val("iri", F.lit(m.class_iri)))
                else:
                    tests.append(F.col(m.columns[p].name).isNotNull())
                    put(x.o, self._cell(m.columns[p]))
            if isinstance(graph, tuple):
                put(graph[0], Val("iri", F.lit(m.graph)))
            rows = df
            for c in tests:
                rows = rows.where(c)
            out.append(bind(rows, values))
        return out

    @staticmethod
    def _cell(c: Column_) -> Val:
        col = F.col(c.name)
        if c.kind == "key":
            return Val("key", col, c.prefix)
        if c.lang:
            return Val("term", t.struct(3, col, "", F.coalesce(c.lang, F.lit(""))))
        if c.kind == "ts":
            return Val("ts", col.cast("timestamp_ntz"))
        return Val(c.kind, col, dt=c.dt)

    def edges(self, predicates: list[str] | None, graph, negated: bool = False) -> DataFrame:
        names = list(self.by_predicate) + [RDF + "type"]
        if predicates is not None:
            names = [n for n in names if (n in predicates) != negated]
        out = None
        for n in names:
            rel = self.scan([Triple(Var("s"), Iri(n), Var("o"))], graph)[0]
            part = rel.df.select(t.as_term(rel.env["s"]).alias("s"), t.as_term(rel.env["o"]).alias("o"))
            out = part if out is None else out.union(part)
        return out.distinct() if out is not None else self.spark.createDataFrame([], f"s {TERM}, o {TERM}")


def union_rels(rels: list[Rel]) -> Rel:
    """Bag union; a variable that some part lacks may be unbound, one of mixed kinds becomes a TERM."""
    if len(rels) == 1:
        return rels[0]
    names = dict.fromkeys(n for r in rels for n in r.env)
    kinds = {}
    for n in names:
        seen = {(v.kind, v.prefix, v.dt) for r in rels if (v := r.env.get(n))}
        kinds[n] = seen.pop() if len(seen) == 1 else ("term", "", "")
    parts, maybe = [], set().union(*[r.maybe for r in rels])
    for r in rels:
        cols = []
        for n, (kind, _, _) in kinds.items():
            if n not in r.env:
                maybe.add(n)
                like = next(x.env[n] for x in rels if n in x.env)
                source = next(x.df for x in rels if n in x.env)
                kind_name = TERM if kind == "term" else source.select(like.col).schema[0].dataType
                cols.append(F.lit(None).cast(kind_name).alias(n))
            else:
                cols.append((t.as_term(r.env[n]) if kind == "term" else r.env[n].col).alias(n))
        parts.append(r.df.select(*cols) if cols else r.df.select(F.lit(1).alias("~")))
    df = parts[0]
    for p in parts[1:]:
        df = df.union(p)
    return Rel(df, {n: Val(k, df[n], prefix, dt) for n, (k, prefix, dt) in kinds.items()}, maybe)


def map_table(name: str, df: DataFrame, prefix: str, key: str | None, links: dict[str, tuple[str, str]] | None = None, lang: dict[str, str] | None = None, rename: dict[str, str] | None = None, base: str = "urn:t:") -> Mapping:
    """A mapping from the table's own types. links: column -> (predicate, subject prefix it points to)."""
    columns = {}
    for col, kind in df.dtypes:
        if links and col in links:
            predicate, to = links[col]
            columns[predicate] = Column_(col, "key", prefix=to)
        elif col != key and (kind in _FLAT or kind.startswith("decimal")):
            k, dt = _FLAT.get(kind, ("num", "decimal"))
            if not (lang and col in lang.values()):
                columns[(rename or {}).get(col, col)] = Column_(col, k, dt, lang=(lang or {}).get(col, ""))
    return Mapping(name, prefix, key, columns, f"{base}{name.capitalize()}", f"{base}g/{name}")


_CATALOG: dict[tuple[str, str], VirtualGraph] = {}


def star_schema(spark: SparkSession, sf_dir: str) -> VirtualGraph:
    """The test tables as one virtual graph; each table is a named graph urn:t:g/<table>. Schemas are read once a session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CATALOG:
        _CATALOG[key] = _star_schema(spark, sf_dir)
    return _CATALOG[key]


def _star_schema(spark: SparkSession, sf_dir: str) -> VirtualGraph:
    from quadloom.runtime import table

    names = "region nation customer supplier part orders lineitem events documents embeddings".split()
    t_ = {n: table(spark, sf_dir, n) for n in names}
    u = lambda x: f"urn:t:{x}/"
    ms = [
        map_table("region", t_["region"], u("region"), "r_regionkey"),
        map_table("nation", t_["nation"], u("nation"), "n_nationkey", {"n_regionkey": ("n_regionkey", u("region"))}),
        map_table("customer", t_["customer"], u("customer"), "c_custkey", {"c_nationkey": ("c_nationkey", u("nation"))}),
        map_table("supplier", t_["supplier"], u("supplier"), "s_suppkey", {"s_nationkey": ("s_nationkey", u("nation"))}),
        map_table("part", t_["part"], u("part"), "p_partkey"),
        map_table("orders", t_["orders"], u("orders"), "o_orderkey", {"o_custkey": ("o_custkey", u("customer"))}),
        map_table("lineitem", t_["lineitem"], "_:lineitem_", None, {"l_orderkey": ("l_orderkey", u("orders")), "l_partkey": ("l_partkey", u("part")), "l_suppkey": ("l_suppkey", u("supplier"))}),
        map_table("events", t_["events"], u("event"), "event_id", {"user_id": ("user", u("user"))}),
        map_table("documents", t_["documents"], u("doc"), "doc_id", lang={"text": "lang"}),
        map_table("embeddings", t_["embeddings"], u("vec"), "vec_id"),
    ]
    return VirtualGraph(spark, t_, ms)
