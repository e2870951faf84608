"""Predicates that are functions over rows: a registry by IRI. A function gets the compiler, the solutions so far, the argument
lists of subject and object, and the graph; it returns the solutions joined with what it finds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom import terms as t
from quadloom.operators import fulltext, lists
from quadloom.plans.algebra import RDF, Iri, Lit, Repeat, Seq, Triple, Var
from quadloom.runtime import Spool
from quadloom.sources.graphs import Rel, bind, token_bucket
from quadloom.terms import Val

REGISTRY: dict[str, object] = {}
APF, LIST, RDFS = "http://jena.hpl.hp.com/ARQ/property#", "http://jena.hpl.hp.com/ARQ/list#", "http://www.w3.org/2000/01/rdf-schema#"
FIRST, REST, NIL = RDF + "first", RDF + "rest", RDF + "nil"


def register(*iris: str):
    def put(f):
        for iri in iris:
            REGISTRY[iri] = f
        return f

    return put


def join_pairs(c, rel: Rel, found: DataFrame, nodes: list, columns: list[str]) -> Rel:
    """Joins columns of TERMs with nodes, which may be variables or constants."""
    values, tests = {}, []
    for node, name in zip(nodes, columns):
        col = F.col(name)
        v = Val("num", col, dt="integer") if dict(found.dtypes)[name] == "bigint" else Val("term", col)
        if isinstance(node, Var):
            if node.name in values:
                tests.append(t.equal(values[node.name], v))
            else:
                values[node.name] = v
        else:
            tests.append(F.coalesce(t.equal(v, t.constant(node, c.g.encode)), F.lit(False)))
    for x in tests:
        found = found.where(x)
    return c.join(rel, bind(found, values))


@register(APF + "assign")
def assign(c, rel: Rel, subject: list, obj: list, graph) -> Rel:
    s, o = subject[0], obj[0]
    if isinstance(s, Var) and s.name not in rel.env:
        return c.extend(rel, s.name, o, graph)
    if isinstance(o, Var) and o.name not in rel.env:
        return c.extend(rel, o.name, s, graph)
    scope = c.scope(rel)
    return Rel(rel.df.where(t.equal(scope.value(s), scope.value(o))), rel.env, rel.maybe)


@register(LIST + "member")
def list_member(c, rel: Rel, subject: list, obj: list, graph) -> Rel:
    return c.join(rel, c.bgp([Triple(subject[0], Seq((Repeat(Iri(REST), 0, True), Iri(FIRST))), obj[0])], graph))


def containers(c, graph) -> DataFrame:
    """(s, o) of the numbered membership properties."""
    rel = c.g.scan([Triple(Var("s"), Var("p"), Var("o"))], graph)[0]
    p = t.lexical(rel.env["p"])
    return rel.df.where(p.rlike(r"(rdf-syntax-ns#|rdf:)_[0-9]+$")).select(t.as_term(rel.env["s"]).alias("s"), t.as_term(rel.env["o"]).alias("o"))


@register(RDFS + "member")
def member(c, rel: Rel, subject: list, obj: list, graph) -> Rel:
    return join_pairs(c, rel, containers(c, graph), [subject[0], obj[0]], ["s", "o"])


def _typed(kind: str):
    def run(c, rel: Rel, subject: list, obj: list, graph) -> Rel:
        typed = c.g.edges([RDF + "type"], graph).where(F.col("o.lex") == c.g.encode(RDF + kind)).select("s")
        return join_pairs(c, rel, containers(c, graph).join(typed, "s", "left_semi"), [subject[0], obj[0]], ["s", "o"])

    return run


for _name in ("bag", "seq", "alt"):
    REGISTRY[APF + _name] = _typed(_name.capitalize())


def list_places(c, graph, spool: Spool) -> tuple[DataFrame, DataFrame | None] | None:
    """Places of the cells in lists; None where rest does not form lists, whichever way its statements repeat."""
    nil = c.g.encode(NIL)
    for rows in (c.g.edge_rows([REST], graph), c.g.edges([REST], graph)):
        s, o, last = lists.key(F.col("s")), lists.key(F.col("o")), F.col("o.lex") == nil
        found = lists.places(rows.select(F.when(last | o.isNotNull(), s).alias("s"), F.when(~last, o).alias("o")), spool)
        if found is not None:
            return found
    return None


def list_cells(c, graph, heads: DataFrame, spool: Spool) -> DataFrame:
    """(list, cell, i): each head with the cells from it on, counted from 0."""
    return lists.reached(c.g.edges([REST], graph).where(F.col("o.lex") != c.g.encode(NIL)), heads, spool)


def _circular(heads: DataFrame, circular: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Heads (column list) in open and in circular lists."""
    cells = circular.select(lists.node(F.col("cell")).alias("list"))
    return heads.join(cells, "list", "left_anti"), heads.join(cells, "list", "left_semi")


@register(LIST + "length")
def list_length(c, rel: Rel, subject: list, obj: list, graph) -> Rel:
    spool = Spool(c.spark)
    heads = c.g.edges([FIRST], graph).select(F.col("s").alias("list")).distinct()
    counted = lambda hs: list_cells(c, graph, hs, spool).groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    found = list_places(c, graph, spool)
    if found is None:
        n = counted(heads)
    else:
        places, circular = found
        around = None
        if circular is not None:
            heads, around = _circular(heads, circular)
        n = heads.join(places.select(lists.node(F.col("cell")).alias("list"), "n"), "list", "left").select("list", F.coalesce("n", F.lit(1)).alias("n"))
        n = n if around is None else n.union(counted(around))
    nil = c.spark.range(1).select(t.struct(1, c.g.encode(NIL)).alias("list"), F.lit(0).cast("bigint").alias("n"))
    return join_pairs(c, rel, n.union(nil), [subject[0], obj[0]], ["list", "n"])


@register(LIST + "index")
def list_index(c, rel: Rel, subject: list, obj: list, graph) -> Rel:
    spool = Spool(c.spark)
    first = c.g.edges([FIRST], graph).select(F.col("s").alias("cell"), F.col("o").alias("e"))
    walked = lambda hs: list_cells(c, graph, hs, spool).join(first, "cell").select("list", "i", "e")
    found = list_places(c, graph, spool)
    if found is None:
        pairs = walked(first.select(F.col("cell").alias("list")).distinct())
    else:
        places, circular = found
        placed = first.join(places.select(lists.node(F.col("cell")).alias("cell"), "chain", "pos"), "cell", "left")
        placed = spool.write(placed.select("cell", "e", F.coalesce("chain", lists.key(F.col("cell"))).alias("chain"), F.coalesce("pos", F.lit(0)).alias("pos")))
        heads = placed.select(F.col("cell").alias("list"), F.col("chain").alias("of"), F.col("pos").alias("from"))
        if placed.select(F.xxhash64("cell")).distinct().count() < placed.count():  # some cell holds several elements
            heads = heads.distinct()
        around = None
        if circular is not None:
            heads, around = _circular(heads, circular)
        pairs = heads.join(placed, (F.col("of") == F.col("chain")) & (F.col("pos") >= F.col("from"))).select("list", (F.col("pos") - F.col("from")).alias("i"), "e")
        pairs = pairs if around is None else pairs.union(walked(around.select("list").distinct()))
    return join_pairs(c, rel, pairs, [subject[0], obj[0], obj[1]], ["list", "i", "e"])


@register("urn:quadloom:text#match")
def match(c, rel: Rel, subject: list, obj: list, graph) -> Rel:
    """?s txt:match "query", or ?s txt:match (?p "query") or (?p "query" ?o). Over a store, queries with a whole word that all
    matches hold read the index of words; others read the literals."""
    p, query, o = (Var("~mp"), obj[0], Var("~mo")) if len(obj) == 1 else (obj[0], obj[1], obj[2] if len(obj) > 2 else Var("~mo"))
    if not isinstance(query, Lit):
        raise ValueError("the text query must be a literal")
    tree = fulltext.parse(query.lex)
    index = getattr(c.g, "tokens", None) if graph is None and c.default is None else None
    if index is not None and (words := fulltext.needed(tree)):
        word = max(words, key=lambda w: (len(w), w))  # the longest is likely the rarest
        hits = index.where((F.col("bucket") == token_bucket(F.lit(word))) & (F.col("token") == word)).select("s", "p", "o")
        found = bind(hits, {"s": Val("term", F.col("s")), "p": Val("iri", F.col("p")), "o": Val("term", F.col("o"))})
    else:
        found = c.g.scan([Triple(Var("s"), Var("p"), Var("o"))], graph)[0]
    text, lang = t.text(found.env["o"]), t.as_term(found.env["o"])["lang"]
    rows = found.df.where(fulltext.condition(tree, text, lang, query.lang))
    rows = rows.select(t.as_term(found.env["s"]).alias("s"), t.struct(1, t.lexical(found.env["p"])).alias("p"), t.as_term(found.env["o"]).alias("o"))
    return join_pairs(c, rel, rows, [subject[0], p, o], ["s", "p", "o"])


