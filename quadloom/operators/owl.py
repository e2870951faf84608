"""OWL and rules over triples (s TERM, p, o TERM). Class expressions are read from the schema, which must fit the driver (checked)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom import terms as t
from quadloom.operators.paths import closure, components
from quadloom.plans.algebra import OWL, RDF, RDFS
from quadloom.runtime import Spool

MAX_SCHEMA = 200_000
_SAME = lambda x: x


@dataclass
class Restriction:
    """all_from, some_from: classes, all of which must hold; has_value: values (k, lex), all of which must be there."""

    on: str
    all_from: tuple[str, ...] = ()
    some_from: tuple[str, ...] = ()
    has_value: tuple[tuple[int, str], ...] = ()
    least: int | None = None
    most: int | None = None


@dataclass
class Schema:
    """Schema triples on the driver: subject -> predicate -> objects (k, lex)."""

    facts: dict[str, dict[str, list[tuple[int, str]]]] = field(default_factory=dict)
    names: object = _SAME

    def get(self, s: str, p: str) -> list[tuple[int, str]]:
        return self.facts.get(s, {}).get(self.names(p), [])

    def one(self, s: str, p: str) -> str | None:
        got = self.get(s, p)
        return got[0][1] if got else None

    def items(self, head: str) -> list[str]:
        out, seen = [], set()
        while head and head != self.names(RDF + "nil") and head not in seen:
            seen.add(head)
            out += [x for _, x in self.get(head, RDF + "first")]
            head = self.one(head, RDF + "rest")
        return out


_SCHEMA = [OWL + x for x in ("onProperty", "allValuesFrom", "someValuesFrom", "hasValue", "cardinality", "minCardinality", "maxCardinality", "unionOf", "intersectionOf", "complementOf", "oneOf", "equivalentClass", "inverseOf")] + [RDF + "first", RDF + "rest", RDFS + "subClassOf", RDFS + "subPropertyOf"]


def read_schema(triples: DataFrame, names=_SAME) -> Schema:
    kinds = [names(OWL + x) for x in ("TransitiveProperty", "SymmetricProperty", "Restriction", "Class", "FunctionalProperty")]
    rows = triples.where(F.col("p").isin([names(p) for p in _SCHEMA]) | ((F.col("p") == names(RDF + "type")) & F.col("o.lex").isin(kinds))).limit(MAX_SCHEMA + 1).collect()
    if len(rows) > MAX_SCHEMA:
        raise ValueError(f"a schema of more than {MAX_SCHEMA} triples")
    out = Schema(names=names)
    for r in rows:
        out.facts.setdefault(r.s.lex, {}).setdefault(r.p, []).append((r.o.k, r.o.lex))
    return out


# W1, W2
def restriction(sc: Schema, cls: str) -> Restriction | None:
    on = sc.one(cls, OWL + "onProperty")
    if on is None:
        return None
    names = lambda p: tuple(sorted({x for _, x in sc.get(cls, p)}))
    r = Restriction(on, names(OWL + "allValuesFrom"), names(OWL + "someValuesFrom"), tuple(sorted(set(sc.get(cls, OWL + "hasValue")))))
    exact = sc.one(cls, OWL + "cardinality")
    low, high = exact or sc.one(cls, OWL + "minCardinality"), exact or sc.one(cls, OWL + "maxCardinality")
    r.least, r.most = int(low) if low else None, int(high) if high else None
    return r


def superclasses(sc: Schema, cls: str) -> set[str]:
    seen, work = {cls}, [cls]
    while work:
        for _, c in sc.get(work.pop(), RDFS + "subClassOf"):
            if c not in seen:
                seen.add(c)
                work.append(c)
    return seen


def merged_restriction(sc: Schema, cls: str, prop: str) -> Restriction:
    """All restrictions of a class and its super-classes on a property: the strictest cardinalities, all value classes."""
    out = Restriction(prop)
    for c in sorted(superclasses(sc, cls)):
        r = restriction(sc, c)
        if r and r.on == prop:
            out.least = max(x for x in (out.least, r.least, 0) if x is not None) if r.least is not None or out.least is not None else None
            out.most = min((x for x in (out.most, r.most) if x is not None), default=None)
            both = lambda a, b: tuple(sorted({*a, *b}))
            out.all_from, out.some_from, out.has_value = both(out.all_from, r.all_from), both(out.some_from, r.some_from), both(out.has_value, r.has_value)
    return out


# W3, W4
def cardinalities(triples: DataFrame, prop: str) -> DataFrame:
    """s, n: distinct values of a property per subject."""
    return triples.where(F.col("p") == prop).groupBy("s").agg(F.count_distinct("o").alias("n"))


def satisfies_restriction(triples: DataFrame, sc: Schema, r: Restriction, depth: int = 0) -> DataFrame:
    """Subjects (column n) that satisfy a restriction; those without any value satisfy all-from and at-most."""
    subjects = triples.select(F.col("s").alias("n")).distinct()
    values = triples.where(F.col("p") == r.on).select(F.col("s").alias("n"), F.col("o").alias("v")).distinct()
    out = subjects
    for k, lex in r.has_value:
        out = out.join(values.where((F.col("v.k") == k) & (F.col("v.lex") == lex)), "n", "left_semi")
    for c in r.some_from:
        good = satisfies(triples, sc, c, depth + 1).select(F.col("n").alias("v"))
        out = out.join(values.join(good, "v", "left_semi"), "n", "left_semi")
    for c in r.all_from:
        good = satisfies(triples, sc, c, depth + 1).select(F.col("n").alias("v"))
        out = out.join(values.join(good, "v", "left_anti"), "n", "left_anti")
    if r.least is not None or r.most is not None:
        counts = values.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
        c = F.coalesce("c", F.lit(0))
        ok = (c >= r.least if r.least is not None else F.lit(True)) & (c <= r.most if r.most is not None else F.lit(True))
        out = out.join(counts, "n", "left").where(ok).select("n")
    return out


# W5
def description(sc: Schema, cls: str, depth: int = 0):
    """A tree: ('union'|'intersection', [..]), ('complement', x), ('one_of', [..]), ('restriction', r), ('class', name), ('thing',), ('nothing',)."""
    if depth > 50:
        raise ValueError("a class expression that contains itself")
    if cls in (sc.names(OWL + "Thing"), sc.names(RDFS + "Resource")):
        return ("thing",)
    if cls == sc.names(OWL + "Nothing"):
        return ("nothing",)
    for p, kind in ((OWL + "unionOf", "union"), (OWL + "intersectionOf", "intersection")):
        if head := sc.one(cls, p):
            return (kind, [description(sc, c, depth + 1) for c in sc.items(head)])
    if c := sc.one(cls, OWL + "complementOf"):
        return ("complement", description(sc, c, depth + 1))
    if head := sc.one(cls, OWL + "oneOf"):
        return ("one_of", sc.items(head))
    if r := restriction(sc, cls):
        return ("restriction", r)
    return ("class", cls)


# W6, W7
def satisfies(triples: DataFrame, sc: Schema, cls: str, depth: int = 0) -> DataFrame:
    """Resources (column n) that satisfy a class expression."""
    return _satisfies(triples, sc, description(sc, cls), depth)


def _satisfies(triples: DataFrame, sc: Schema, tree, depth: int) -> DataFrame:
    if depth > 20:
        raise ValueError("class expressions nested too deep")
    nodes = triples.select(F.col("s").alias("n")).union(triples.where("o.k < 3").select("o")).distinct()
    match tree:
        case ("union", parts):
            out = _satisfies(triples, sc, parts[0], depth + 1)
            for x in parts[1:]:
                out = out.union(_satisfies(triples, sc, x, depth + 1))
            return out.distinct()
        case ("intersection", parts):
            out = _satisfies(triples, sc, parts[0], depth + 1)
            for x in parts[1:]:
                out = out.join(_satisfies(triples, sc, x, depth + 1), "n", "left_semi")
            return out
        case ("thing",):
            return nodes
        case ("nothing",):
            return nodes.limit(0)
        case ("complement", x):
            return nodes.join(_satisfies(triples, sc, x, depth + 1), "n", "left_anti")
        case ("one_of", items):
            return nodes.where(F.col("n.lex").isin(items))
        case ("restriction", r):
            return satisfies_restriction(triples, sc, r, depth + 1)
        case ("class", c):
            subs = subclasses(sc, c)
            named = triples.where((F.col("p") == sc.names(RDF + "type")) & F.col("o.lex").isin(sorted(subs))).select(F.col("s").alias("n"))
            for e in {x for x in subs for _, x in sc.get(x, OWL + "equivalentClass")}:
                if description(sc, e)[0] != "class":
                    named = named.union(satisfies(triples, sc, e, depth + 1))
            return named.distinct()
    raise TypeError(f"no class expression: {tree!r}")


individual_of = satisfies


# W11
def subclasses(sc: Schema, cls: str) -> set[str]:
    down: dict[str, list[str]] = {}
    for s, ps in sc.facts.items():
        for _, o in ps.get(sc.names(RDFS + "subClassOf"), []):
            down.setdefault(o, []).append(s)
    seen, work = {cls}, [cls]
    while work:
        for c in down.get(work.pop(), ()):
            if c not in seen:
                seen.add(c)
                work.append(c)
    return seen


def direct_subclasses(triples: DataFrame, names=_SAME) -> DataFrame:
    """(s, o): sub-class links that no longer way implies."""
    edges = triples.where(F.col("p") == names(RDFS + "subClassOf")).where("s <> o").select("s", "o").distinct()
    far = edges.join(closure(edges).select(F.col("s").alias("o"), F.col("o").alias("o2")), "o").select("s", F.col("o2").alias("o")).distinct()
    return edges.join(far, ["s", "o"], "left_anti")


# W9
def same_as(triples: DataFrame, names=_SAME) -> DataFrame:
    """(node, component) of owl:sameAs, symmetric and transitive."""
    return components(triples.where((F.col("p") == names(OWL + "sameAs")) & (F.col("o.k") < 3)).select(F.col("s").alias("a"), F.col("o").alias("b")))


# W8
def has(triples: DataFrame, sc: Schema, prop: str, names=_SAME) -> DataFrame:
    """(s, o) of a property: by its sub-properties, inverses, symmetry, transitivity, and through owl:sameAs."""
    subs = {prop}
    while True:
        more = {s for s, ps in sc.facts.items() for _, o in ps.get(names(RDFS + "subPropertyOf"), []) if o in subs} - subs
        if not more:
            break
        subs |= more
    of = lambda p, k: any(x == names(OWL + k) for _, x in sc.get(p, RDF + "type"))
    pairs = triples.where(F.col("p").isin(sorted(subs))).select("s", "o")
    inverse = {x for p in subs for _, x in sc.get(p, OWL + "inverseOf")} | {s for s, ps in sc.facts.items() for _, o in ps.get(names(OWL + "inverseOf"), []) if o in subs}
    inverse |= {p for p in subs if of(p, "SymmetricProperty")}
    if inverse:
        pairs = pairs.union(triples.where(F.col("p").isin(sorted(inverse)) & (F.col("o.k") < 3)).select(F.col("o").alias("s"), F.col("s").alias("o")))
    for s in sc.facts:
        r = restriction(sc, s)
        if r and r.on in subs and r.has_value:
            members = triples.where((F.col("p") == names(RDF + "type")) & F.col("o.lex").isin(sorted(subclasses(sc, s)))).select("s")
            for k, lex in r.has_value:
                pairs = pairs.union(members.select("s", t.struct(k, F.lit(lex)).alias("o")))
    pairs = pairs.distinct()
    comp = Spool(triples.sparkSession).write(same_as(triples, names))
    a, b = comp.select(F.col("node").alias("s"), F.col("component").alias("cs")), comp.select(F.col("node").alias("o"), F.col("component").alias("co"))
    canon = pairs.join(a, "s", "left").join(b, "o", "left").select(F.coalesce("cs", "s").alias("s"), F.coalesce("co", "o").alias("o")).distinct()
    if any(of(p, "TransitiveProperty") for p in subs):
        canon = closure(canon)
    back_s, back_o = comp.select(F.col("component").alias("s"), F.col("node").alias("s2")), comp.select(F.col("component").alias("o"), F.col("node").alias("o2"))
    return canon.join(back_s, "s", "left").join(back_o, "o", "left").select(F.coalesce("s2", "s").alias("s"), F.coalesce("o2", "o").alias("o")).distinct()


# W10
def apply_rules(engine, rules: list[tuple[str, str]], max_rounds: int = 50):
    """Rules (body, head) as SPARQL group and template text, to a fix-point; a new engine over the graph with all they derive."""
    spool = Spool(engine.spark)
    graph = engine.graph
    for _ in range(max_rounds):
        before = spool.write(graph.quads)
        work = type(engine)(graph.derive(before), engine.prefixes, engine.base, engine.endpoints)
        new = None
        for body, head in rules:
            part = work.sparql(f"CONSTRUCT {{ {head} }} WHERE {{ {body} }}")
            new = part if new is None else new.union(part)
        held = before.select("s", "p", "o")
        fresh = spool.write(new.distinct().join(held, ["s", "p", "o"], "left_anti"))
        if fresh.isEmpty():
            return work
        graph = graph.derive(before.union(fresh.select("s", "p", "o", F.lit("inferred").alias("g"), F.lit(None).cast("bigint").alias("g_line"))))
    raise RuntimeError(f"the rules don't end within {max_rounds} rounds")


# W12
def find(triples: DataFrame, sc: Schema, text: str, how: str = "substring", cls: str | None = None) -> DataFrame:
    """Resources (column n) that have a literal with the text: substring, word, prefix or exact, in any case; of a class if given."""
    low = F.lower("o.lex")
    test = {"substring": low.contains(text.lower()), "prefix": low.startswith(text.lower()), "exact": low == text.lower(), "word": F.array_contains(F.split(low, r"[^\p{L}\p{N}]+"), text.lower())}[how]
    hits = triples.where((F.col("o.k") == 3) & test).select(F.col("s").alias("n")).distinct()
    return hits.join(satisfies(triples, sc, cls), "n", "left_semi") if cls else hits
