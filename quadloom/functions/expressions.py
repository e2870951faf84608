"""Expressions of queries as columns: operators, built-in functions, casts, functions called by IRI."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom import terms as t
from quadloom.plans.algebra import XSD, Aggregate, Call, Exists, Iri, Lit, Var
from quadloom.terms import Val

#: Functions called by IRI: IRI -> function of the argument values.
REGISTRY: dict[str, Callable[..., Val]] = {}


class UnknownFunction(KeyError):
    pass


def register(*iris: str):
    """Registers a function of Val arguments under one or more IRIs."""

    def put(f):
        for iri in iris:
            REGISTRY[iri] = f
        return f

    return put


class Scope:
    """Variables at a point of a query, and what expressions need to know of the query."""

    def __init__(self, env: dict[str, Val], encode=lambda x: x, base: str = "", flags: dict[int, Column] | None = None) -> None:
        self.env, self.encode, self.base, self.flags = env, encode, base, flags or {}

    def value(self, e) -> Val:
        match e:
            case Var(name):
                return self.env.get(name) or Val("term", F.lit(None).cast(t.TERM))
            case Iri() | Lit():
                return t.constant(e, self.encode)
            case Exists():
                return Val("bool", self.flags[id(e)])
            case Aggregate():
                raise ValueError("an aggregate stands outside SELECT, HAVING or ORDER BY")
            case Call(name, args):
                return self.call(name, args)
        raise TypeError(f"no expression: {e!r}")

    def test(self, e) -> Column:
        return t.effective(self.value(e))

    def call(self, name: str, args: tuple) -> Val:
        if name in ("||", "&&"):
            a, b = self.test(args[0]), self.test(args[1])
            return Val("bool", a | b if name == "||" else a & b)
        if name == "!":
            return Val("bool", ~self.test(args[0]))
        if name == "bound":
            return Val("bool", self.value(args[0]).col.isNotNull())
        if name == "if":
            return _choose(self.test(args[0]), self.value(args[1]), self.value(args[2]))
        if name == "in":
            x = self.value(args[0])
            out = F.lit(False)
            for a in args[1:]:
                out = out | t.equal(x, self.value(a))
            return Val("bool", out)
        if name in ("iri", "uri"):
            return _iri(self.value(args[0]), self.base)
        values = [self.value(a) for a in args]
        if name in _BUILT_IN:
            try:
                return _BUILT_IN[name](*values)
            except TypeError as e:
                raise ValueError(f"{name.upper()} with {len(values)} arguments") from e
        if name in REGISTRY:
            return REGISTRY[name](*values)
        if name.startswith(XSD):
            return cast(name[len(XSD) :], values[0])
        raise UnknownFunction(name)


def _choose(test: Column, a: Val, b: Val) -> Val:
    if a.kind == b.kind and a.kind != "key" and a.dt == b.dt:
        return Val(a.kind, F.when(test, a.col).when(~test, b.col), dt=a.dt)
    if {a.kind, b.kind} == {"num"}:
        return Val("num", F.when(test, a.col).when(~test, b.col), dt="double" if "double" in (a.dt, b.dt) else "decimal")
    return Val("term", F.when(test, t.as_term(a)).when(~test, t.as_term(b)))


def _coalesce(*vs: Val) -> Val:
    if len({(v.kind, v.dt) for v in vs}) == 1 and vs[0].kind != "key":
        return Val(vs[0].kind, F.coalesce(*[v.col for v in vs]), dt=vs[0].dt)
    if {v.kind for v in vs} == {"num"}:
        return Val("num", F.coalesce(*[v.col.cast("double") for v in vs]), dt="double")
    return Val("term", F.coalesce(*[t.as_term(v) for v in vs]))


# numbers
def _arithmetic(op: str) -> Callable[[Val, Val], Val]:
    def run(a: Val, b: Val) -> Val:
        x, y = t.number(a), t.number(b)
        dt = "double" if a.kind != "num" or b.kind != "num" or "double" in (a.dt, b.dt) else "decimal" if "decimal" in (a.dt, b.dt) or op == "/" else "integer"
        if op == "/":
            return Val("num", F.try_divide(x.cast("double"), y.cast("double")), dt=dt)
        do = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]
        return Val("num", do(x, y), dt=dt)

    return run


def _numeric(f: Callable[[Column], Column], keep: bool = True) -> Callable[[Val], Val]:
    return lambda v: Val("num", f(t.number(v)), dt=(v.dt or "double") if keep else "integer")


def _round(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


# strings: a language or type of the first argument is kept
def _keep(v: Val, c: Column) -> Val:
    if v.kind == "term":
        return Val("term", F.when(c.isNotNull(), t.struct(3, c, "", v.col["lang"])))
    return Val("str", c)


def _substr(v: Val, start: Val, n: Val | None = None) -> Val:
    """Positions count from 1; what lies before the text is left out, as in XPath."""
    s, a = t.text(v), t.number(start).cast("double")
    first = _round(a)
    until = F.length(s) + 1 if n is None else first + _round(t.number(n).cast("double"))
    lo = F.greatest(first, F.lit(1)).cast("int")
    hi = F.least(until, F.length(s) + 1).cast("int")
    return _keep(v, s.substr(lo, F.greatest(hi - lo, F.lit(0))))


def _compatible(a: Val, b: Val) -> Column:
    """Argument compatibility: the second has no language, or that of the first."""
    lang = lambda v: v.col["lang"] if v.kind == "term" else F.lit("")
    return (lang(b) == "") | (F.lower(lang(a)) == F.lower(lang(b)))


def _binary(f: Callable[[Column, Column], Column]) -> Callable[[Val, Val], Val]:
    def run(a: Val, b: Val) -> Val:
        c = f(t.text(a), t.text(b))
        return Val("bool", c if "term" not in (a.kind, b.kind) else F.when(_compatible(a, b), c))

    return run


def _before(v: Val, part: Val) -> Val:
    s, p = t.text(v), t.text(part)
    at = F.position(p, s)
    found = _keep(v, s.substr(F.lit(1), at - 1))
    none = t.as_term(Val("str", F.lit(""))) if v.kind == "term" else F.lit("")
    return Val(found.kind, F.when(at > 0, found.col).when(at == 0, none))


def _after(v: Val, part: Val) -> Val:
    s, p = t.text(v), t.text(part)
    at = F.position(p, s)
    found = _keep(v, s.substr(at + F.length(p), F.length(s)))
    none = t.as_term(Val("str", F.lit(""))) if v.kind == "term" else F.lit("")
    return Val(found.kind, F.when(at > 0, found.col).when(at == 0, none))


def _concat(*vs: Val) -> Val:
    if not vs:
        return Val("str", F.lit(""))
    parts = [t.text(v) for v in vs]
    c = F.concat(*parts)
    if all(v.kind == "str" for v in vs):
        return Val("str", c)
    langs = [v.col["lang"] if v.kind == "term" else F.lit("") for v in vs]
    same = F.lit(True)
    for x in langs[1:]:
        same = same & (x == langs[0])
    return Val("term", F.when(c.isNotNull(), t.struct(3, c, "", F.when(same, langs[0]).otherwise(""))))


def _flags(v: Val | None) -> Column:
    return F.lit("") if v is None else F.when(F.length(t.text(v)) > 0, F.concat(F.lit("(?"), F.regexp_replace(t.text(v), "[^imsxq]", ""), F.lit(")"))).otherwise("")


def _regex(v: Val, pattern: Val, flags: Val | None = None) -> Val:
    return Val("bool", F.regexp_like(t.text(v), F.concat(_flags(flags), t.text(pattern))))


def _replace(v: Val, pattern: Val, by: Val, flags: Val | None = None) -> Val:
    return _keep(v, F.regexp_replace(t.text(v), F.concat(_flags(flags), t.text(pattern)), t.text(by)))


def _lang_matches(lang: Val, wanted: Val) -> Val:
    a, b = F.lower(t.text(lang)), F.lower(t.text(wanted))
    return Val("bool", F.when(b == "*", a != "").otherwise((a == b) | a.startswith(F.concat(b, F.lit("-")))))


# terms
def _kind(k: int) -> Callable[[Val], Val]:
    def run(v: Val) -> Val:
        match v.kind:
            case "term":
                return Val("bool", v.col["k"] == k)
            case "iri":
                return Val("bool", F.when(v.col.isNotNull(), v.col.startswith("_:") == F.lit(k == 2)) if k < 3 else F.when(v.col.isNotNull(), F.lit(False)))
            case "key":
                return Val("bool", F.when(v.col.isNotNull(), F.lit(k == (2 if v.prefix.startswith("_:") else 1))))
        return Val("bool", F.when(v.col.isNotNull(), F.lit(k == 3)))

    return run


def _is_numeric(v: Val) -> Val:
    return Val("bool", F.when(v.col.isNotNull(), t.number(v).isNotNull()))


def _lang(v: Val) -> Val:
    if v.kind == "term":
        return Val("str", F.when(v.col["k"] == 3, v.col["lang"]))
    return Val("str", F.when(v.col.isNotNull(), F.lit(None if t.is_resource(v) else "").cast("string")))


def _datatype(v: Val) -> Val:
    if v.kind == "term":
        lit = F.when(v.col["lang"] != "", F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")).when(v.col["dt"] == "", F.lit(XSD + "string")).otherwise(v.col["dt"])
        return Val("iri", F.when(v.col["k"] == 3, lit))
    dt = {"str": XSD + "string", "num": XSD + (v.dt or "double"), "bool": XSD + "boolean", "ts": XSD + "dateTime"}.get(v.kind)
    return Val("iri", F.when(v.col.isNotNull(), F.lit(dt).cast("string")))


def _iri(v: Val, base: str) -> Val:
    if t.is_resource(v):
        return v
    lex = F.when(v.col["k"] == 1, v.col["lex"]).otherwise(t.text(v)) if v.kind == "term" else t.text(v)
    if not base:
        return Val("iri", lex)

    def resolve(refs: pd.Series) -> pd.Series:
        return refs.map(lambda s: urljoin(base, s), na_action="ignore")

    relative = F.pandas_udf(resolve, "string")(lex)  # absolute ones need it not
    return Val("iri", F.when(lex.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), lex).otherwise(relative))


def _strdt(v: Val, dt: Val) -> Val:
    name = t.lexical(dt)
    return Val("term", F.when(t.text(v).isNotNull() & name.isNotNull(), t.struct(3, t.text(v), F.when(name.isin(t.STRINGS), "").otherwise(name))))


def _strlang(v: Val, lang: Val) -> Val:
    return Val("term", F.when(t.text(v).isNotNull(), t.struct(3, t.text(v), "", t.text(lang))))


def _bnode(label: Val | None = None) -> Val:
    if label is None:
        return Val("iri", F.concat(F.lit("_:u"), F.regexp_replace(F.uuid(), "-", "")))
    return Val("iri", F.concat(F.lit("_:l"), F.sha2(t.text(label), 256)))


# times
def _stamp_text(v: Val) -> Column:
    return F.when(v.col["dt"].isin(t.TIMES), v.col["lex"]) if v.kind == "term" else t.lexical(v) if v.kind == "ts" else F.lit(None).cast("string")


def _field(pattern: str, kind: str) -> Callable[[Val], Val]:
    """Read from the lexical form, as zones must not move the fields."""
    return lambda v: Val("num", F.regexp_extract(_stamp_text(v), pattern, 1).try_cast(kind), dt="integer" if kind == "bigint" else "decimal")


def _part(f: Callable[[Column], Column], pattern: str, kind: str = "bigint") -> Callable[[Val], Val]:
    text = _field(pattern, kind)
    return lambda v: Val("num", f(v.col).cast(kind), dt="integer" if kind == "bigint" else "decimal") if v.kind == "ts" else text(v)


def _tz(v: Val) -> Val:
    return Val("str", F.regexp_extract(_stamp_text(v), r"(Z|[+-]\d\d:\d\d)$", 1))


def _timezone(v: Val) -> Val:
    z = F.regexp_extract(_stamp_text(v), r"(Z|[+-]\d\d:\d\d)$", 1)
    h, m = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
    body = F.concat(F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""))
    lex = F.when((z == "Z") | (body == ""), "PT0S").otherwise(F.concat(F.when(z.startswith("-"), "-").otherwise(""), F.lit("PT"), body))
    return Val("term", F.when(z != "", t.struct(3, lex, XSD + "dayTimeDuration")))


def _hash(f: Callable[[Column], Column]) -> Callable[[Val], Val]:
    return lambda v: Val("str", f(F.encode(t.text(v), "UTF-8")))


def cast(name: str, v: Val) -> Val:
    """xsd:<name>(v); what doesn't fit is an error."""
    lex = F.trim(t.lexical(v)) if not t.is_resource(v) else F.lit(None).cast("string")
    if v.kind == "term":
        lex = F.when(v.col["k"] == 3, lex)
    if name == "string":
        return Val("str", t.lexical(v))
    if name in t._INTEGERS:
        n = F.when(lex.rlike(r"^[+-]?\d+$"), lex.try_cast("bigint")).when(lex.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") & F.lit(v.kind == "num"), lex.try_cast("double").try_cast("bigint"))
        if v.kind == "term":
            n = F.coalesce(n, F.when(t.number(v).isNotNull(), t.number(v).try_cast("bigint")))
        if v.kind == "bool":
            n = v.col.cast("bigint")
        return Val("num", n, dt="integer")
    if name in ("decimal", "double", "float"):
        n = v.col.cast("double") if v.kind in ("bool", "num") else lex.try_cast("double")
        return Val("num", n, dt="decimal" if name == "decimal" else "double")
    if name == "boolean":
        if v.kind == "num":
            return Val("bool", v.col != 0)
        low = F.lower(lex)
        return Val("bool", F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False))
    if name in ("dateTime", "date"):
        if v.kind == "ts":
            return v
        ok = lex.rlike(r"^-?\d{4,}-\d\d-\d\d(T\d\d:\d\d:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)?$")
        return Val("ts", F.when(ok, lex.try_cast("timestamp").cast("timestamp_ntz")))
    raise UnknownFunction(XSD + name)


_BUILT_IN: dict[str, Callable[..., Val]] = {
    "=": lambda a, b: Val("bool", t.equal(a, b)),
    "!=": lambda a, b: Val("bool", ~t.equal(a, b)),
    **{op: (lambda a, b, op=op: Val("bool", t.less(a, b, op))) for op in ("<", ">", "<=", ">=")},
    **{op: _arithmetic(op) for op in ("+", "-", "*", "/")},
    "neg": _numeric(lambda c: F.negative(c)),
    "pos": _numeric(lambda c: c),
    "coalesce": _coalesce,
    "sameterm": lambda a, b: Val("bool", t.same_term(a, b)),
    "isiri": _kind(1),
    "isuri": _kind(1),
    "isblank": _kind(2),
    "isliteral": _kind(3),
    "isnumeric": _is_numeric,
    "str": lambda v: Val("str", t.lexical(v)),
    "lang": _lang,
    "datatype": _datatype,
    "strdt": _strdt,
    "strlang": _strlang,
    "uuid": lambda: Val("iri", F.concat(F.lit("urn:uuid:"), F.uuid())),
    "struuid": lambda: Val("str", F.uuid()),
    "bnode": _bnode,
    "strlen": lambda v: Val("num", F.length(t.text(v)).cast("bigint"), dt="integer"),
    "substr": _substr,
    "ucase": lambda v: _keep(v, F.upper(t.text(v))),
    "lcase": lambda v: _keep(v, F.lower(t.text(v))),
    "strstarts": _binary(lambda a, b: a.startswith(b)),
    "strends": _binary(lambda a, b: a.endswith(b)),
    "contains": _binary(lambda a, b: a.contains(b)),
    "strbefore": _before,
    "strafter": _after,
    "encode_for_uri": lambda v: Val("str", F.replace(F.replace(F.replace(F.url_encode(t.text(v)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))),
    "concat": _concat,
    "langmatches": _lang_matches,
    "regex": _regex,
    "replace": _replace,
    "abs": _numeric(F.abs),
    "round": _numeric(_round),
    "ceil": _numeric(F.ceil),
    "floor": _numeric(F.floor),
    "rand": lambda: Val("num", F.rand(), dt="double"),
    "now": lambda: Val("ts", F.localtimestamp()),
    "year": _part(F.year, r"^(-?\d+)-"),
    "month": _part(F.month, r"^-?\d+-(\d\d)"),
    "day": _part(F.day, r"^-?\d+-\d\d-(\d\d)"),
    "hours": _part(F.hour, r"T(\d\d):"),
    "minutes": _part(F.minute, r"T\d\d:(\d\d)"),
    "seconds": _part(lambda c: F.date_part(F.lit("SECOND"), c), r"T\d\d:\d\d:([\d.]+)", "double"),
    "timezone": _timezone,
    "tz": _tz,
    "md5": _hash(F.md5),
    "sha1": _hash(F.sha1),
    "sha256": _hash(lambda c: F.sha2(c, 256)),
    "sha384": _hash(lambda c: F.sha2(c, 384)),
    "sha512": _hash(lambda c: F.sha2(c, 512)),
}

# Namespaces of the function libraries.
_FN = "http://www.w3.org/2005/xpath-functions#"
_AFN = "http://jena.hpl.hp.com/ARQ/function#"
_FN_JAVA, _AFN_JAVA = "java:com.hp.hpl.jena.sparql.function.library.", "java:com.hp.hpl.jena.query.function.library."


for _ns in (_FN, _AFN, _FN_JAVA, _AFN_JAVA):
    REGISTRY[_ns + "strlen"] = REGISTRY[_ns + "string-length"] = _BUILT_IN["strlen"]
    REGISTRY[_ns + "lower-case"] = REGISTRY[_ns + "lcase"] = _BUILT_IN["lcase"]
    REGISTRY[_ns + "upper-case"] = REGISTRY[_ns + "ucase"] = _BUILT_IN["ucase"]


@register(*[ns + n for ns in (_AFN, _FN_JAVA, _AFN_JAVA) for n in ("substr", "substring")])
def _zero_based(v: Val, begin: Val, end: Val | None = None) -> Val:
    """Positions from 0, the end excluded."""
    s, b = t.text(v), t.number(begin).cast("int")
    e = F.length(s) if end is None else t.number(end).cast("int")
    return _keep(v, s.substr(b + 1, F.greatest(e - b, F.lit(0))))


REGISTRY[_FN + "substring"] = _substr
for _ns in (_AFN, _FN_JAVA, _AFN_JAVA):
    REGISTRY[_ns + "sha1sum"] = _BUILT_IN["sha1"]


@register(*[ns + "localname" for ns in (_AFN, _FN_JAVA, _AFN_JAVA)])
def _local_name(v: Val) -> Val:
    return Val("str", F.regexp_extract(t.lexical(v), r"([^#/]*)$", 1))


@register(*[ns + "namespace" for ns in (_AFN, _FN_JAVA, _AFN_JAVA)])
def _namespace(v: Val) -> Val:
    return Val("str", F.regexp_extract(t.lexical(v), r"^(.*[#/])", 1))
