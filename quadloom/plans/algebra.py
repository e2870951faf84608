"""Nodes of the query algebra. Both query languages parse to these; the compiler turns them into DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Lit:
    lex: str
    dt: str = ""
    lang: str = ""


Node = Var | Iri | Lit


# expressions
@dataclass(frozen=True)
class Call:
    """An operator or function: its name in lower case (an IRI for functions called by IRI) and its arguments."""

    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Exists:
    pattern: object
    negated: bool = False


@dataclass(frozen=True)
class Aggregate:
    name: str
    arg: object = None  # None: *
    distinct: bool = False
    separator: str = " "


# paths
@dataclass(frozen=True)
class Inverse:
    path: object


@dataclass(frozen=True)
class Seq:
    parts: tuple


@dataclass(frozen=True)
class Alt:
    parts: tuple


@dataclass(frozen=True)
class Repeat:
    """min 0 or 1; many: without upper bound."""

    path: object
    least: int
    many: bool


@dataclass(frozen=True)
class Once:
    """Each pair that a path connects, once."""

    path: object


@dataclass(frozen=True)
class Negated:
    forward: tuple
    backward: tuple


# patterns
@dataclass
class Triple:
    s: object
    p: object  # Node or path
    o: object


@dataclass
class Bgp:
    triples: list[Triple] = field(default_factory=list)


@dataclass
class Join:
    left: object
    right: object


@dataclass
class LeftJoin:
    left: object
    right: object
    condition: object = None


@dataclass
class Union:
    left: object
    right: object


@dataclass
class Minus:
    left: object
    right: object


@dataclass
class Filter:
    condition: object
    child: object


@dataclass
class Extend:
    child: object
    var: Var
    expr: object


@dataclass
class InGraph:
    graph: object
    child: object


@dataclass
class Values:
    vars: list[Var]
    rows: list[tuple]  # of Node or None


@dataclass
class SubSelect:
    query: Query


@dataclass
class Service:
    endpoint: object
    child: object
    silent: bool


@dataclass
class PropertyFunction:
    """A pattern whose predicate is a registered function over rows; subject and object may be argument lists."""

    name: str
    subject: list
    object: list


@dataclass
class Query:
    form: str  # select, construct, ask, describe
    where: object
    items: list[tuple[Var, object]] | None = None  # None: *
    distinct: bool = False
    reduced: bool = False
    template: list[Triple] = field(default_factory=list)
    describe: list = field(default_factory=list)
    default_graphs: list[str] = field(default_factory=list)
    named_graphs: list[str] = field(default_factory=list)
    group: list[tuple[Var, object]] = field(default_factory=list)
    having: list = field(default_factory=list)
    order: list[tuple[object, bool]] = field(default_factory=list)  # expression, descending
    limit: int | None = None
    offset: int = 0
    values: Values | None = None


@dataclass
class Update:
    kind: str
    delete: list = field(default_factory=list)  # (graph, Triple)
    insert: list = field(default_factory=list)
    where: object = None
    graph: str | None = None
    source: str | None = None
    target: str | None = None
    silent: bool = False
    using: list[str] = field(default_factory=list)
    using_named: list[str] = field(default_factory=list)


def variables(node) -> list[str]:
    """Names of the variables that a pattern may bind, in order of first appearance; hidden ones start with '~'."""
    out: dict[str, None] = {}

    def walk(n) -> None:
        match n:
            case Var(name):
                out[name] = None
            case Triple():
                for x in (n.s, n.p, n.o):
                    if isinstance(x, Var):
                        walk(x)
            case Bgp():
                for t in n.triples:
                    walk(t)
            case Join() | LeftJoin() | Union():
                walk(n.left)
                walk(n.right)
            case Minus():
                walk(n.left)
            case Filter():
                walk(n.child)
            case Extend():
                walk(n.child)
                walk(n.var)
            case InGraph():
                walk(n.graph)
                walk(n.child)
            case Service():
                walk(n.child)
            case Values():
                for v in n.vars:
                    walk(v)
            case PropertyFunction():
                for v in [*n.subject, *n.object]:
                    walk(v)
            case SubSelect():
                q = n.query
                for v in [v for v, _ in q.items] if q.items is not None else [Var(x) for x in visible(q.where)]:
                    walk(v)

    walk(node)
    return list(out)


def visible(node) -> list[str]:
    return [v for v in variables(node) if not v.startswith("~")]


def expression_vars(e) -> set[str]:
    match e:
        case Var(name):
            return {name}
        case Call():
            return set().union(*map(expression_vars, e.args)) if e.args else set()
        case Aggregate():
            return expression_vars(e.arg) if e.arg is not None else set()
        case tuple() | list():
            return set().union(*map(expression_vars, e)) if e else set()
    return set()


def has_aggregate(e) -> bool:
    match e:
        case Aggregate():
            return True
        case Call():
            return any(map(has_aggregate, e.args))
        case tuple() | list():
            return any(map(has_aggregate, e))
    return False
