"""Graph to graph: descriptions, identity merging, bagging, abstraction, schema inference, labels. Graphs are DataFrames of
s (TERM), p (string), o (TERM), each triple once; the vocabulary is named by full IRIs unless ``names`` maps it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadloom import terms as t
from quadloom.operators.paths import closure, components, reach
from quadloom.operators.ranking import number
from quadloom.plans.algebra import OWL, RDF, RDFS
from quadloom.runtime import Spool
from quadloom.terms import TERM

LABELS = [RDFS + "label", "http://www.w3.org/2004/02/skos/core#prefLabel", "http://purl.org/dc/elements/1.1/title", "http://purl.org/dc/terms/title", "http://xmlns.com/foaf/0.1/name", "http://www.w3.org/2004/02/skos/core#altLabel"]
_same: Callable[[str], str] = lambda x: x


def iri(x) -> Column:
    return t.struct(1, x)


# G1, G2: concise bounded descriptions
def cbd(triples: DataFrame, seeds: DataFrame, symmetric: bool = False, keep: Column | None = None) -> DataFrame:
    """Triples of the seeds (column n) and of the blank nodes that these lead to; with ``symmetric`` also the triples that lead to them."""
    triples = triples.where(keep) if keep is not None else triples
    inner = triples.where("s.k = 2 AND o.k = 2").select("s", "o")
    start = triples.where("o.k = 2").join(seeds.select(F.col("n").alias("s")), "s", "left_semi").select("s", "o")
    out = triples.join(seeds.select(F.col("n").alias("s")).union(reach(start, inner).select("o")).distinct(), "s", "left_semi")
    if symmetric:
        back = triples.where("s.k = 2").select(F.col("o").alias("s"), F.col("s").alias("o"))
        start = back.join(seeds.select(F.col("n").alias("s")), "s", "left_semi")
        nodes = seeds.select(F.col("n").alias("o")).union(reach(start, back.where("s.k = 2")).select("o")).distinct()
        out = out.union(triples.join(nodes, "o", "left_semi").select("s", "p", "o"))
    return out.select("s", "p", "o").distinct()


def graph_cbd(triples: DataFrame, part: DataFrame) -> DataFrame:
    seeds = part.select(F.col("s").alias("n")).union(part.where("o.k < 3").select("o")).distinct()
    return part.select("s", "p", "o").union(cbd(triples, seeds)).distinct()


# G3: reifications, also of the statements about statements
def with_reifications(triples: DataFrame, part: DataFrame, names=_same) -> DataFrame:
    spool = Spool(triples.sparkSession)
    p = lambda x: triples.where(F.col("p") == names(RDF + x)).select(F.col("s").alias("st"), F.col("o").alias(x))
    statements = spool.write(p("subject").join(p("predicate"), "st").join(p("object"), "st"))
    known = front = spool.write(part.select("s", "p", "o").distinct())
    while not front.isEmpty():
        hit = statements.join(front, (F.col("subject") == F.col("s")) & (F.col("predicate.lex") == F.col("p")) & (F.col("object") == F.col("o"))).select(F.col("st").alias("s")).distinct()
        front = spool.write(triples.join(hit, "s", "left_semi").select("s", "p", "o").join(known, ["s", "p", "o"], "left_anti"))
        known = known.union(front)
    return known


# G4
def with_labels(triples: DataFrame, part: DataFrame, names=_same) -> DataFrame:
    nodes = resources(part).select(F.col("n").alias("s"))
    wanted = [names(RDFS + x) for x in ("label", "comment", "seeAlso")]
    return part.select("s", "p", "o").union(triples.where(F.col("p").isin(wanted)).join(nodes, "s", "left_semi").select("s", "p", "o")).distinct()


# G10
def resources(triples: DataFrame, kinds: tuple[str, ...] = ("s", "p", "o")) -> DataFrame:
    """Distinct resources (column n) in the named places."""
    parts = {"s": triples.select(F.col("s").alias("n")), "p": triples.select(iri(F.col("p")).alias("n")), "o": triples.where("o.k < 3").select(F.col("o").alias("n"))}
    out = None
    for k in kinds:
        out = parts[k] if out is None else out.union(parts[k])
    return out.distinct()


# G9
def map_graph(triples: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replaces resources by mapping (a, b); triples fall together, and loops that were none before are dropped."""
    m = lambda x: mapping.select(F.col("a").alias(f"a{x}"), F.col("b").alias(f"b{x}"))
    ms, mp, mo = m("s"), mapping.where("a.k = 1").select(F.col("a.lex").alias("ap"), F.col("b.lex").alias("bp")), m("o")
    j = triples.join(ms, triples["s"] == ms["as"], "left").join(mp, triples["p"] == mp["ap"], "left").join(mo, triples["o"] == mo["ao"], "left")
    new_s, new_o = F.coalesce("bs", "s"), F.coalesce("bo", "o")
    return j.where((new_s != new_o) | (F.col("s") == F.col("o"))).select(new_s.alias("s"), F.coalesce("bp", "p").alias("p"), new_o.alias("o")).distinct()


# G5: representatives of owl:sameAs classes
def same_as_map(triples: DataFrame, names=_same) -> DataFrame:
    """(a, b): each resource of an identity class and its representative: named before blank, the most edges (counted up to 100), the least name."""
    comp = components(triples.where(F.col("p") == names(OWL + "sameAs")).select(F.col("s").alias("a"), F.col("o").alias("b")).where("b.k < 3"))
    comp = Spool(triples.sparkSession).write(comp)
    ends = triples.select(F.col("s").alias("node")).union(triples.where("o.k < 3").select("o"))
    degree = ends.join(comp, "node", "left_semi").groupBy("node").agg(F.least(F.count(F.lit(1)), F.lit(100)).alias("n"))
    ranked = comp.join(degree, "node", "left")
    best = ranked.groupBy("component").agg(F.min_by("node", F.struct(F.col("node.k").alias("k"), (-F.coalesce("n", F.lit(0))).alias("n"), F.col("node.lex").alias("l"))).alias("b"))
    return comp.join(best, "component").select(F.col("node").alias("a"), "b").where("a <> b")


def merge_same_as(triples: DataFrame, names=_same) -> DataFrame:
    rest = triples.where(F.col("p") != names(OWL + "sameAs"))
    return map_graph(rest, same_as_map(triples, names))


# G6: nodes of one class with the same edges become a bag
def bagify(triples: DataFrame, names=_same, bag_prefix: str = "_:bag_") -> tuple[DataFrame, DataFrame]:
    """(graph, members): resources alike in type and in all other edges become one bag; members are (bag, member).

    The edge set of a node is told by its size and 128 bits of commutative fingerprint, so a hub's edges are never gathered.
    """
    out_edges = triples.select(F.col("s").alias("n"), F.struct(F.lit("out").alias("d"), "p", F.col("o").alias("x")).alias("e"))
    in_edges = triples.where("o.k < 3").select(F.col("o").alias("n"), F.struct(F.lit("in").alias("d"), "p", F.col("s").alias("x")).alias("e"))
    mark = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "e"))
    sets = out_edges.union(in_edges).distinct().groupBy("n").agg(F.struct(F.count(F.lit(1)).alias("c"), mark("a").alias("x"), mark("b").alias("y")).alias("es"))
    groups = sets.groupBy("es").agg(F.count(F.lit(1)).alias("size"), F.min("n.lex").alias("first")).where("size > 1")
    bags = groups.select("es", t.struct(2, F.concat(F.lit(bag_prefix), F.sha2("first", 256).substr(1, 16))).alias("bag"))
    members = Spool(triples.sparkSession).write(sets.join(bags, "es").select("bag", F.col("n").alias("member")))
    mapped = map_graph(triples, members.select(F.col("member").alias("a"), F.col("bag").alias("b")))
    typed = members.select(F.col("bag").alias("s"), F.lit(names(RDF + "type")).alias("p"), iri(names(RDF + "Bag")).alias("o")).distinct()
    numbered = number(members, "bag", "member", "i").select(F.col("bag").alias("s"), F.concat(F.lit(names(RDF + "_")), F.col("i").cast("string")).alias("p"), F.col("member").alias("o"))
    return mapped.union(typed).union(numbered), members


# G7: parallel edges under their nearest common super-property
def merge_properties(triples: DataFrame, schema: DataFrame, names=_same) -> DataFrame:
    """Edges between the same nodes by several properties become one edge by their nearest common ancestor, where there is one."""
    up = _depths(schema.where(F.col("p") == names(RDFS + "subPropertyOf")))
    par = triples.groupBy("s", "o").agg(F.collect_set("p").alias("ps")).where(F.size("ps") > 1)
    each = par.select("s", "o", F.size("ps").alias("n"), F.explode("ps").alias("p"))
    anc = each.join(up, "p").groupBy("s", "o", "n", "anc").agg(F.count_distinct("p").alias("covers"), F.max("depth").alias("depth")).where("covers = n")
    best = anc.groupBy("s", "o").agg(F.min_by("anc", F.struct("depth", "anc")).alias("anc"))
    merged = best.select("s", F.col("anc").alias("p"), "o")
    rest = triples.join(best.select("s", "o"), ["s", "o"], "left_anti").select("s", "p", "o")
    return rest.union(merged)


def _depths(sub: DataFrame) -> DataFrame:
    """(p, anc, depth): each property with its ancestors, itself at depth 0."""
    spool = Spool(sub.sparkSession)
    edges = spool.write(sub.select(F.col("s.lex").alias("a"), F.col("o.lex").alias("b")).distinct())
    known = front = spool.write(edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("p"), F.col("a").alias("anc"), F.lit(0).alias("depth")))
    while not front.isEmpty():
        step = front.join(edges, front["anc"] == edges["a"]).select("p", F.col("b").alias("anc"), (F.col("depth") + 1).alias("depth")).distinct()
        front = spool.write(step.join(known, ["p", "anc"], "left_anti"))
        known = known.union(front)
    return known


# G8: instances to classes
def abstract(triples: DataFrame, names=_same, merge: DataFrame | None = None) -> DataFrame:
    """The graph with each typed node replaced by its class (the least of several), and classes by ``merge`` (a, b) where given.
    Literals stay as they are."""
    typing = (F.col("p") == names(RDF + "type")) & (F.col("o.k") < 3)
    kind = triples.where(typing).groupBy(F.col("s").alias("a")).agg(F.min("o").alias("b"))
    out = map_graph(triples.where(~typing), kind)
    return map_graph(out, merge) if merge is not None else out


# G11
def minimise(triples: DataFrame, schema: DataFrame, names=_same) -> DataFrame:
    """Drops edges that others imply: by a super-property, by symmetry (the greater subject goes), by an inverse property (the
    greater property goes). Of properties that are each other's sub-properties the least stays. Edges to literals all stay."""
    literals, triples = triples.where("o.k = 3"), triples.where("o.k < 3")
    below = closure(_pairs(schema, names(RDFS + "subPropertyOf"))).where("s <> o").select(F.col("s").alias("q"), F.col("o").alias("p"))
    mutual = below.select(F.col("p").alias("q"), F.col("q").alias("p")).where("p < q")
    sub = below.join(mutual, ["q", "p"], "left_anti")
    implied = triples.select("s", F.col("p").alias("q"), "o").join(sub, "q").select("s", "p", "o")
    out = triples.join(implied, ["s", "p", "o"], "left_anti")
    sym = schema.where((F.col("p") == names(RDF + "type")) & (F.col("o.lex") == names(OWL + "SymmetricProperty"))).select(F.col("s.lex").alias("p"))
    twice = out.join(sym, "p", "left_semi").select(F.col("o").alias("s"), "p", F.col("s").alias("o")).where("s.lex > o.lex")
    out = out.join(twice, ["s", "p", "o"], "left_anti")
    inv = schema.where(F.col("p") == names(OWL + "inverseOf")).select(F.least("s.lex", "o.lex").alias("q"), F.greatest("s.lex", "o.lex").alias("p")).where("p <> q").distinct()
    back = out.select(F.col("o").alias("s"), F.col("p").alias("q"), F.col("s").alias("o")).join(inv, "q").select("s", "p", "o")
    return out.join(back, ["s", "p", "o"], "left_anti").select("s", "p", "o").union(literals.select("s", "p", "o"))


def _pairs(schema: DataFrame, predicate: str) -> DataFrame:
    return schema.where(F.col("p") == predicate).select(F.col("s.lex").alias("s"), F.col("o.lex").alias("o")).distinct()


# G12, G13: components of identity as bags
def smash(triples: DataFrame, names=_same) -> DataFrame:
    """Each owl:sameAs component becomes one bag of its members; edges go to the bag."""
    comp = components(triples.where((F.col("p") == names(OWL + "sameAs")) & (F.col("o.k") < 3)).select(F.col("s").alias("a"), F.col("o").alias("b")))
    comp = Spool(triples.sparkSession).write(comp.select(F.col("node").alias("a"), t.struct(2, F.concat(F.lit("_:smash_"), F.sha2("component.lex", 256).substr(1, 16))).alias("b")))
    rest = map_graph(triples.where(F.col("p") != names(OWL + "sameAs")), comp)
    return rest.union(number(comp, "b", "a", "i").select(F.col("b").alias("s"), F.concat(F.lit(names(RDF + "_")), F.col("i").cast("string")).alias("p"), F.col("a").alias("o")))


def combine_bags(members: DataFrame) -> DataFrame:
    """(bags, members): bags that share a member become one. members: (bag, member)."""
    comp = components(members.select(F.col("bag").alias("a"), F.col("member").alias("b")))
    return members.join(comp, members["bag"] == comp["node"]).select(F.col("component").alias("bag"), "member").distinct()


# G14
def blank_variables(triples: DataFrame) -> DataFrame:
    """Blank nodes renamed to _:v1, _:v2, ... in the order of their names. Numbers come from a sort, not from one task."""
    from quadloom.runtime import shuffle_partitions

    nodes = triples.select(F.col("s").alias("n")).union(triples.select("o")).where("n.k = 2").distinct()
    ranged = nodes.repartitionByRange(shuffle_partitions(triples.sparkSession), "n.lex").sortWithinPartitions("n.lex").withColumn("part", F.spark_partition_id())
    ranged = Spool(triples.sparkSession).write(ranged)
    counts = {r.part: r.c for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("c")).collect()}  # one row a partition
    base, at = {}, 0
    for k in sorted(counts):
        base[k], at = at, at + counts[k]
    offset = F.create_map(*[F.lit(x) for k, v in base.items() for x in (k, v)]) if base else F.create_map(F.lit(0), F.lit(0))
    place = F.element_at(offset, F.col("part")) + F.row_number().over(Window.partitionBy("part").orderBy("n.lex"))
    return map_graph(triples, ranged.select(F.col("n").alias("a"), t.struct(2, F.concat(F.lit("_:v"), place.cast("string"))).alias("b")))


# G15
def schema(triples: DataFrame, names=_same, skip: tuple[str, ...] = (RDF, RDFS, OWL, "rdf:", "rdfs:", "owl:")) -> DataFrame:
    """Classes and properties in use, with domain and range where the instances have a single one. Well-known vocabularies are left out."""
    kind = triples.where(F.col("p") == names(RDF + "type")).select(F.col("s").alias("n"), F.col("o.lex").alias("c"))
    used = triples.where((F.col("p") != names(RDF + "type")) & ~_starts(F.col("p"), skip))
    n = lambda x: F.lit(names(x))
    classes = kind.select("c").distinct().where(~_starts(F.col("c"), skip)).select(iri(F.col("c")).alias("s"), n(RDF + "type").alias("p"), iri(names(RDFS + "Class")).alias("o"))
    props = used.select("p").distinct().select(iri(F.col("p")).alias("s"), n(RDF + "type").alias("p"), iri(names(RDF + "Property")).alias("o"))
    first = kind.groupBy("n").agg(F.collect_set("c").alias("cs")).where(F.size("cs") == 1).select("n", F.col("cs")[0].alias("c"))

    def single(ends: DataFrame, what: str) -> DataFrame:
        c = ends.join(first, ends["n"] == first["n"], "left").groupBy("p").agg(F.count_distinct(F.coalesce("c", F.lit(""))).alias("k"), F.max("c").alias("c")).where("k = 1 AND c IS NOT NULL")
        return c.select(iri(F.col("p")).alias("s"), n(RDFS + what).alias("p"), iri(F.col("c")).alias("o"))

    domains = single(used.select("p", F.col("s").alias("n")), "domain")
    ranges = single(used.where("o.k < 3").select("p", F.col("o").alias("n")), "range")
    labels = classes.union(props).select("s", n(RDFS + "label").alias("p"), t.struct(3, F.regexp_extract("s.lex", r"([^/#:]*)$", 1)).alias("o"))
    return classes.union(props).union(domains).union(ranges).union(labels)


def _starts(c: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


# G16, G18
def labels(triples: DataFrame, nodes: DataFrame, language: str = "", properties: list[str] | None = None, names=_same) -> DataFrame:
    """(n, label): the label by preference of property, then of language, then the least; else the name's last part."""
    order = [names(p) for p in properties or LABELS]
    rank = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("p"))
    lang = F.when(F.lower("o.lang") == language.lower(), 0).when(F.lower("o.lang").startswith(language.lower() + "-") & F.lit(bool(language)), 1).when(F.col("o.lang") == "", 2).otherwise(3)
    best = triples.where(F.col("p").isin(order) & (F.col("o.k") == 3)).groupBy(F.col("s").alias("n")).agg(F.min_by("o.lex", F.struct(rank.alias("r"), lang.alias("l"), F.col("o.lex").alias("x"))).alias("label"))
    fallback = F.when(F.col("n.k") == 3, F.col("n.lex")).otherwise(F.regexp_extract("n.lex", r"([^/#:]*)$", 1))
    return nodes.select("n").distinct().join(best, "n", "left").select("n", F.coalesce("label", fallback).alias("label"))


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


# G17
def descriptions(triples: DataFrame, nodes: DataFrame, names=_same) -> DataFrame:
    wanted = [names(x) for x in (RDFS + "comment", "http://purl.org/dc/elements/1.1/description", "http://purl.org/dc/terms/description", "http://www.w3.org/2004/02/skos/core#definition")]
    found = triples.where(F.col("p").isin(wanted) & (F.col("o.k") == 3)).select(F.col("s").alias("n"), F.col("o.lex").alias("description"))
    return nodes.select("n").distinct().join(found, "n")


# G19
def context(triples: DataFrame, seeds: DataFrame, transitive: list[str], related: list[str], steps: int = 3, schema: DataFrame | None = None, bags: bool = False, names=_same) -> DataFrame:
    """Up to ``steps`` links to parents over the transitive properties, and the related resources of the seeds.

    With a schema, edges that others imply are left out (see minimise); with ``bags``, resources alike become bags (see bagify).
    """
    spool = Spool(triples.sparkSession)
    up = triples.where(F.col("p").isin(transitive) & (F.col("o.k") < 3))
    front = seeds.select(F.col("n").alias("s")).distinct()
    out = triples.where(F.col("p").isin(related)).join(front, "s", "left_semi").select("s", "p", "o")
    for _ in range(steps):
        step = spool.write(up.join(front, "s", "left_semi").select("s", "p", "o"))
        out = out.union(step)
        front = step.select(F.col("o").alias("s")).distinct()
    out = out.distinct()
    out = minimise(out, schema, names) if schema is not None else out
    return bagify(out, names)[0] if bags else out


# G20
def path_from_named(triples: DataFrame, targets: DataFrame, max_steps: int | None = None) -> DataFrame:
    """n, steps, path (array of resources, a named node first): shortest ways from a named node to each blank target, of any length.

    ``max_steps`` raises rather than leaving longer ways out. A target that no named node leads to has no row.
    """
    spool = Spool(triples.sparkSession)
    back = spool.write(triples.where("o.k = 2").select(F.col("o").alias("at"), F.col("s").alias("up")).distinct())
    front = spool.write(targets.where("n.k = 2").select("n", F.col("n").alias("at"), F.array("n").alias("path")))
    seen, found = front.select("n", "at"), None
    steps = 0
    while True:
        steps += 1
        step = front.join(back, "at").groupBy("n", F.col("up").alias("at")).agg(F.min(F.concat(F.array("up"), "path")).alias("path"))
        step = spool.write(step.join(seen, ["n", "at"], "left_anti").select("n", "at", "path"))
        if step.isEmpty():
            break
        if max_steps is not None and steps > max_steps:
            raise RuntimeError(f"there are ways of more than {max_steps} steps")
        hits = step.where("at.k = 1").groupBy("n").agg(F.min("path").alias("path"))
        found = hits if found is None else found.union(hits.join(found, "n", "left_anti"))
        found = spool.write(found)
        front = step.where("at.k = 2").join(found, "n", "left_anti")
        seen = seen.union(step.select("n", "at"))
    if found is None:
        return targets.select("n", F.lit(0).alias("steps"), F.array().cast(f"array<{TERM}>").alias("path")).limit(0)
    return found.select("n", (F.size("path") - 1).alias("steps"), "path")


# S21
def extract(triples: DataFrame, schema_part: bool = True, data_part: bool = True, names=_same, inferred: DataFrame | None = None) -> DataFrame:
    """The triples about classes and properties, those about all else, or both. ``inferred``: triples that a regime adds; without
    them the extract holds explicit triples only."""
    if inferred is not None:
        triples = triples.select("s", "p", "o").union(inferred.select("s", "p", "o")).distinct()
    kinds = [names(x) for x in (RDFS + "Class", OWL + "Class", RDF + "Property", OWL + "ObjectProperty", OWL + "DatatypeProperty")]
    about = triples.where((F.col("p") == names(RDF + "type")) & F.col("o.lex").isin(kinds)).select("s").distinct()
    if schema_part and data_part:
        return triples
    if not schema_part and not data_part:
        return triples.limit(0)
    return triples.join(about, "s", "left_semi" if schema_part else "left_anti").select("s", "p", "o")
