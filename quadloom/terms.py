"""Values of query variables as typed columns.

A variable whose kind is known at compile time stays a native column (key, string, number, boolean, time); only where kinds
mix does it become a TERM struct: k (1 IRI, 2 blank node, 3 literal), lex, dt, lang. Null is both unbound and error. xsd:string
counts as a plain literal, so its dt is ''.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom.plans.algebra import XSD, Iri, Lit

TERM = "struct<k:int,lex:string,dt:string,lang:string>"

# The numeric types of XML Schema, by local name.
_INTEGERS = "integer nonPositiveInteger negativeInteger long int short byte nonNegativeInteger unsignedLong unsignedInt unsignedShort unsignedByte positiveInteger".split()
_NUMERIC = [*_INTEGERS, "decimal", "float", "double"]
NUMERIC = [p + n for p in (XSD, "xsd:") for n in _NUMERIC]
INTEGERS = [p + n for p in (XSD, "xsd:") for n in _INTEGERS]
TIMES = [p + n for p in (XSD, "xsd:") for n in ("dateTime", "date")]
BOOLEANS = [XSD + "boolean", "xsd:boolean"]
STRINGS = [XSD + "string", "xsd:string"]


@dataclass(frozen=True)
class Val:
    """kind: term, iri (string column), key (native column under an IRI prefix), str, num, bool, ts."""

    kind: str
    col: Column
    prefix: str = ""  # of a key; blank nodes have the prefix '_:'
    dt: str = ""  # of a number: integer, decimal, double


def struct(k, lex, dt="", lang="") -> Column:
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(c(k).cast("int").alias("k"), c(lex).alias("lex"), c(dt).alias("dt"), c(lang).alias("lang"))


def constant(node, encode=lambda x: x) -> Val:
    if isinstance(node, Iri):
        return Val("iri", F.lit(encode(node.value)))
    lex, dt = node.lex, node.dt
    name = dt[len(XSD) :] if dt.startswith(XSD) else ""
    if node.lang:
        return Val("term", struct(3, lex, "", node.lang))
    if dt in ("", XSD + "string"):
        return Val("str", F.lit(lex))
    try:
        if name in _INTEGERS and abs(int(lex)) < 2**63:
            return Val("num", F.lit(int(lex)).cast("bigint"), dt="integer")
        if name == "decimal":
            return Val("num", F.lit(lex).cast("decimal(38,18)").cast("double"), dt="decimal")
        if name in ("double", "float"):
            return Val("num", F.lit(float(lex)), dt="double")
    except ValueError:
        pass
    if name == "boolean" and lex in ("true", "false", "1", "0"):
        return Val("bool", F.lit(lex in ("true", "1")))
    if name in ("dateTime", "date"):
        return Val("ts", F.lit(lex).try_cast("timestamp_ntz")) if not lex.endswith("Z") and "+" not in lex else Val("term", struct(3, lex, encode(dt)))
    return Val("term", struct(3, lex, encode(dt)))


def key_text(v: Val) -> Column:
    return F.concat(F.lit(v.prefix), v.col.cast("string"))


def as_term(v: Val) -> Column:
    null = F.lit(None).cast(TERM)
    match v.kind:
        case "term":
            return v.col
        case "iri":
            c = F.when(v.col.startswith("_:"), struct(2, v.col)).otherwise(struct(1, v.col))
        case "key":
            c = struct(2 if v.prefix.startswith("_:") else 1, key_text(v))
        case "str":
            c = struct(3, v.col)
        case "num":
            c = struct(3, v.col.cast("string"), XSD + (v.dt or "double"))
        case "bool":
            c = struct(3, v.col.cast("string"), XSD + "boolean")
        case "ts":
            c = struct(3, lexical(v), XSD + "dateTime")
    return F.when(v.col.isNotNull(), c).otherwise(null)


def lexical(v: Val) -> Column:
    """STR(): the lexical form, whatever the kind."""
    match v.kind:
        case "term":
            return v.col["lex"]
        case "key":
            return key_text(v)
        case "ts":
            plain = F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss")
            micro = F.rtrim(F.date_format(v.col, ".SSSSSS"), F.lit("0"))
            return F.concat(plain, F.when(micro == ".", "").otherwise(micro))
        case "iri" | "str":
            return v.col
    return v.col.cast("string")


def text(v: Val) -> Column:
    """The string of a string literal (plain, xsd:string or with a language); null for all else."""
    if v.kind == "term":
        return F.when((v.col["k"] == 3) & (v.col["dt"] == ""), v.col["lex"])
    return v.col if v.kind == "str" else F.lit(None).cast("string")


def number(v: Val) -> Column:
    if v.kind == "num":
        return v.col
    if v.kind == "term":
        return F.when((v.col["k"] == 3) & v.col["dt"].isin(NUMERIC), v.col["lex"].try_cast("double"))
    return F.lit(None).cast("double")


def moment(v: Val) -> Column:
    """A time stamp; zones are brought to UTC, a missing one counts as UTC."""
    if v.kind == "ts":
        return v.col
    if v.kind == "term":
        return F.when((v.col["k"] == 3) & v.col["dt"].isin(TIMES), v.col["lex"].try_cast("timestamp").cast("timestamp_ntz"))
    return F.lit(None).cast("timestamp_ntz")


def truth(v: Val) -> Column:
    """A boolean value, not the effective one."""
    if v.kind == "bool":
        return v.col
    if v.kind == "term":
        return F.when(v.col["dt"].isin(BOOLEANS), v.col["lex"].try_cast("boolean"))
    return F.lit(None).cast("boolean")


def effective(v: Val) -> Column:
    match v.kind:
        case "bool":
            return v.col
        case "num":
            return (v.col != 0) & ~F.isnan(v.col.cast("double"))
        case "str":
            return F.length(v.col) > 0
        case "term":
            n = number(v)
            number_or_text = F.when(n.isNotNull(), (n != 0) & ~F.isnan(n)).when(v.col["dt"].isin(NUMERIC), F.lit(False)).otherwise(F.length(text(v)) > 0)
            return F.when(v.col["dt"].isin(BOOLEANS), F.coalesce(truth(v), F.lit(False))).otherwise(number_or_text)
    return F.lit(None).cast("boolean")


def is_resource(v: Val) -> bool:
    return v.kind in ("iri", "key")


def equal(a: Val, b: Val) -> Column:
    """'=' by value; literals of unknown types are equal if identical, else the comparison is an error (null)."""
    kinds = {a.kind, b.kind}
    if kinds == {"num"} or kinds == {"str"} or kinds == {"bool"} or kinds == {"ts"}:
        return a.col == b.col
    if kinds == {"key"} and a.prefix == b.prefix:
        return a.col == b.col
    if is_resource(a) and is_resource(b):
        return lexical(a) == lexical(b)
    if "term" not in kinds:
        return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
    x, y = as_term(a), as_term(b)
    na, nb, ta, tb, ba, bb = number(a), number(b), moment(a), moment(b), truth(a), truth(b)
    same = x == y
    known = ["", *NUMERIC, *TIMES, *BOOLEANS]
    literal = (
        F.when(same, F.lit(True))
        .when(na.isNotNull() & nb.isNotNull(), na == nb)
        .when(ta.isNotNull() & tb.isNotNull(), ta == tb)
        .when(ba.isNotNull() & bb.isNotNull(), ba == bb)
        .when((x["dt"] == "") & (y["dt"] == ""), (x["lex"] == y["lex"]) & (F.lower(x["lang"]) == F.lower(y["lang"])))
        .when(x["dt"].isin(known) & y["dt"].isin(known), F.lit(False))
    )
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("boolean")).when((x["k"] == 3) & (y["k"] == 3), literal).otherwise((x["k"] == y["k"]) & (x["lex"] == y["lex"]))


def same_term(a: Val, b: Val) -> Column:
    if a.kind == b.kind and a.kind != "term" and a.prefix == b.prefix and a.dt == b.dt:
        return a.col == b.col
    return as_term(a) == as_term(b)


def less(a: Val, b: Val, op: str) -> Column:
    do = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
    for kind in ("num", "str", "bool", "ts"):
        if {a.kind, b.kind} == {kind}:
            return do(a.col, b.col)
    if "term" not in (a.kind, b.kind):
        return F.lit(None).cast("boolean")
    x, y = as_term(a), as_term(b)
    same_type = (x["k"] == 3) & (y["k"] == 3) & (x["dt"] == y["dt"]) & (x["lang"] == y["lang"])
    return (
        F.when(number(a).isNotNull() & number(b).isNotNull(), do(number(a), number(b)))
        .when(moment(a).isNotNull() & moment(b).isNotNull(), do(moment(a), moment(b)))
        .when(truth(a).isNotNull() & truth(b).isNotNull(), do(truth(a), truth(b)))
        .when(same_type & ~x["dt"].isin([*NUMERIC, *TIMES, *BOOLEANS]), do(x["lex"], y["lex"]))
    )


def sort_keys(v: Val) -> list[Column]:
    """Unbound, blank nodes, IRIs, literals; numbers by value before other literals."""
    if v.kind == "term":
        n = number(v)
        rank = F.when(v.col["k"] == 2, 0).when(v.col["k"] == 1, 1).when(n.isNotNull(), 2).when(v.col["k"] == 3, 3)
        return [rank, n, v.col["lex"]]
    return [lexical(v)] if v.kind == "key" else [v.col]


def order_value(v: Val) -> Column:
    """One orderable column for MIN and MAX."""
    return F.struct(*[k.alias(f"k{i}") for i, k in enumerate(sort_keys(v))], as_term(v).alias("t")) if v.kind == "term" else v.col


def unify(a: Val, b: Val) -> tuple[Column, Column]:
    """Columns that are equal just when the values are the same term."""
    if a.kind == b.kind and a.kind not in ("term", "key") and a.dt == b.dt:
        return a.col, b.col
    if a.kind == b.kind == "key" and a.prefix == b.prefix:
        return a.col, b.col
    if is_resource(a) and is_resource(b):
        return lexical(a), lexical(b)
    return as_term(a), as_term(b)


def output(v: Val) -> Column:
    """The plain column of a result: the lexical form of terms, keys as IRIs, native values as they are."""
    return lexical(v) if v.kind in ("term", "key") else v.col
