"""Entity-attribute-value rows into wide tables, by combineByKey over per-entity slot registers.

A register holds, for each slot (attribute) of one entity, nothing, one value, or the mark that its rows disagree. Merging
registers is associative and commutative, so duplicates are resolved on the map side and an entity that holds any share of all
rows crosses the shuffle as one register of at most as many cells as there are slots.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.runtime import Spool, shuffle_partitions

#: Most attributes a wide table may have; the slot table is sent to every task.
MAX_SLOTS = 5000

_ZONE = r"(?:Z|[+-](?:0\d|1[0-3]):[0-5]\d|[+-]14:00)?"
_YEAR = r"-?(?:[1-9]\d{4,}|\d{4})"
_INTEGER = re.compile(r"[+-]?[0-9]+\Z", re.A)
_DECIMAL = re.compile(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)\Z", re.A)
_DATE = re.compile(rf"({_YEAR})-(\d\d)-(\d\d)({_ZONE})\Z", re.A)
_TIME = re.compile(rf"({_YEAR})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:\.(\d+))?({_ZONE})\Z", re.A)
_GYEAR = re.compile(rf"({_YEAR})({_ZONE})\Z", re.A)
_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
_EPOCH = 719468


class NoValue(ValueError):
    pass


def _day(year: int, month: int, day: int) -> int:
    """Days since 1970-01-01 in the proleptic Gregorian calendar, any year."""
    leap = month == 2 and year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    if not 1 <= month <= 12 or not 1 <= day <= _DAYS[month - 1] + leap:
        raise NoValue
    y = year - (month <= 2)
    era, yoe = divmod(y, 400)
    doy = (153 * ((month + 9) % 12) + 2) // 5 + day - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - _EPOCH


def _zone(z: str) -> int | None:
    """Minutes east of UTC; None without a zone."""
    if not z:
        return None
    return 0 if z == "Z" else (1 if z[0] == "+" else -1) * (int(z[1:3]) * 60 + int(z[4:6]))


def _match(pattern: re.Pattern, lex: str) -> re.Match:
    m = pattern.match(lex)
    if not m:
        raise NoValue
    return m


def _integer(lex: str) -> int:
    _match(_INTEGER, lex)
    if len(lex) > 4000:  # beyond the interpreter's limit for int(): by its significant digits
        digits = lex.lstrip("+-").lstrip("0")
        return Decimal(("-" if lex[0] == "-" else "") + (digits or "0"))
    return int(lex)


def _decimal(lex: str) -> Decimal:
    _match(_DECIMAL, lex)
    return Decimal(lex)


def _boolean(lex: str) -> bool:
    if lex not in ("true", "false", "1", "0"):
        raise NoValue
    return lex in ("true", "1")


def _date(lex: str) -> tuple:
    """(minutes of the day's first instant, has a zone)."""
    y, m, d, z = _match(_DATE, lex).groups()
    zone = _zone(z)
    return (_day(int(y), int(m), int(d)) * 1440 - (zone or 0), zone is not None, zone or 0)


def _datetime(lex: str) -> tuple:
    """(seconds, fraction's digits, has a zone)."""
    y, m, d, hh, mm, ss, frac, z = _match(_TIME, lex).groups()
    h, mi, s, frac = int(hh), int(mm), int(ss), (frac or "").rstrip("0")
    if mi > 59 or s > 59 or h > 24 or (h == 24 and (mi or s or frac)):
        raise NoValue
    zone = _zone(z)
    return (_day(int(y), int(m), int(d)) * 86400 + h * 3600 + mi * 60 + s - 60 * (zone or 0), frac, zone is not None)


def _gyear(lex: str) -> tuple:
    y, z = _match(_GYEAR, lex).groups()
    zone = _zone(z)
    return (_day(int(y), 1, 1) * 1440 - (zone or 0), zone is not None, int(y))


def _string(lex: str) -> str:
    return lex


def _to_decimal(digits: int, scale: int) -> Callable:
    def encode(v):
        v = Decimal(v)
        _, ds, exponent = v.as_tuple()
        beyond = -scale - exponent  # digits after the last that the column holds
        if beyond > 0 and any(ds[-beyond:]):
            return None
        return v if abs(v) < Decimal(10) ** (digits - scale) else None

    return encode


def _to_date(v: tuple) -> dt.date | None:
    day = (v[0] + v[2]) // 1440
    return dt.date.fromordinal(day + 719163) if -719162 <= day <= 2932896 else None


def _to_timestamp(v: tuple) -> dt.datetime | None:
    if not -62135596800 <= v[0] < 253402300800:
        return None
    return dt.datetime(1970, 1, 1) + dt.timedelta(seconds=v[0], microseconds=int((v[1] + "000000")[:6]))


def _same(v):
    return v


#: range_dt -> (lexical form to comparable value, which part of the value decides, column type, value to cell)
_CODECS: dict[str, tuple[Callable, Callable, T.DataType, Callable]] = {
    "xsd:integer": (_integer, _same, T.DecimalType(38, 0), _to_decimal(38, 0)),
    "xsd:decimal": (_decimal, _same, T.DecimalType(38, 10), _to_decimal(38, 10)),
    "xsd:boolean": (_boolean, _same, T.BooleanType(), _same),
    "xsd:date": (_date, lambda v: v[:2], T.DateType(), _to_date),
    "xsd:dateTime": (_datetime, _same, T.TimestampNTZType(), _to_timestamp),
    "xsd:gYear": (_gyear, lambda v: v[:2], T.LongType(), lambda v: v[2] if -(2**63) <= v[2] < 2**63 else None),
    "xsd:string": (_string, _same, T.StringType(), _same),
}

_WHITE = " \t\r\n"
_NONE, _CLASH = "none", "clash"  # marks; a value is held as a 1-tuple


def parse(lex: str | None, range_dt: str | None):
    """The comparable value of a lexical form as a 1-tuple, or the mark for no value. Unknown types are read as strings."""
    if lex is None:
        return _NONE
    try:
        return (_CODECS.get(range_dt, _CODECS["xsd:string"])[0](lex.strip(_WHITE)),)
    except (NoValue, ArithmeticError):
        return _NONE


class Slots:
    """The attributes of the wide table: sent to the tasks, so bounded by MAX_SLOTS."""

    def __init__(self, rows: list[tuple[str, str | None]]) -> None:
        if len(rows) > MAX_SLOTS:
            raise ValueError(f"more than {MAX_SLOTS} attributes")
        self.keys = [p for p, _ in rows]
        self.types = [t if t in _CODECS else "xsd:string" for _, t in rows]
        self.names = _names(self.keys)

    def merge_cells(self, slot: int, a, b):
        if a == _NONE or b == _CLASH:
            return b
        if b == _NONE or a == _CLASH:
            return a
        part = _CODECS[self.types[slot]][1]
        if part(a[0]) != part(b[0]):
            return _CLASH
        return min(a, b)  # one instant in several zones: the least stands, whatever order the rows come in

    def put(self, register: dict, cell: tuple[int, str | None]) -> dict:
        slot, lex = cell
        value = parse(lex, self.types[slot])
        register[slot] = self.merge_cells(slot, register[slot], value) if slot in register else value
        return register

    def start(self, cell: tuple[int, str | None]) -> dict:
        return self.put({}, cell)

    def merge(self, a: dict, b: dict) -> dict:
        for slot, value in b.items():
            a[slot] = self.merge_cells(slot, a[slot], value) if slot in a else value
        return a

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("s_lex", T.StringType())] + [T.StructField(n, _CODECS[t][2]) for n, t in zip(self.names, self.types)])

    def row(self, entity, register: dict) -> tuple:
        cells = [None] * len(self.keys)
        for slot, value in register.items():
            if value not in (_NONE, _CLASH):
                cells[slot] = _CODECS[self.types[slot]][3](value[0])
        return (entity, *cells)


def _names(keys: list[str]) -> list[str]:
    """Column names: what follows the last '/', '#' or ':', made unique without regard to case."""
    taken, names = {"s_lex"}, []
    for key in keys:
        base = re.split(r"[/#:]", key)[-1] or "value"
        name, k = base, 2
        while name.lower() in taken:
            name, k = f"{base}_{k}", k + 1
        taken.add(name.lower())
        names.append(name)
    return names


def registers(rdf: DataFrame, predicates: DataFrame):
    """(RDD of entity and register, slots). Reads s_lex, p_lex, o_lex; predicates that are not single-valued take no part."""
    declared = predicates.where("single_valued AND p_lex IS NOT NULL").groupBy("p_lex").agg(F.min("range_dt").alias("range_dt")).orderBy("p_lex").limit(MAX_SLOTS + 1).collect()
    slots = Slots([(r.p_lex, r.range_dt) for r in declared])
    spark = rdf.sparkSession
    number = F.broadcast(spark.createDataFrame([(p, i) for i, p in enumerate(slots.keys)], "_p string, _slot int"))  # at most MAX_SLOTS rows
    cells = rdf.select("s_lex", "p_lex", "o_lex").join(number, F.col("p_lex") == F.col("_p")).select("s_lex", "_slot", "o_lex")
    cells = Spool(spark).write(cells)  # narrow and columnar: a lost task re-reads these, not the statement table
    pairs = cells.rdd.map(lambda r: (r[0], (r[1], r[2])))
    return pairs.combineByKey(slots.start, slots.put, slots.merge, shuffle_partitions(spark)), slots


def to_wide(rdf: DataFrame, predicates: DataFrame) -> DataFrame:
    """One row per subject that has any single-valued statement, one typed column per single-valued predicate.

    A cell is null where the statements give no value, more than one value, or a value that the column's type can't hold
    whole (decimal(38,0), decimal(38,10), years 1 to 9999 for dates). One date or year written in several zones that begin at
    one instant is the one of the westernmost zone. Time stamps with a zone are in UTC, those without as written.
    Null subjects form one row. Repeated statements and other spellings of a value are one value. Empty input gives no rows.
    """
    combined, slots = registers(rdf, predicates)
    return rdf.sparkSession.createDataFrame(combined.map(lambda x: slots.row(*x)), slots.schema(), verifySchema=False)


def unclear_cells(rdf: DataFrame, predicates: DataFrame) -> DataFrame:
    """(s_lex, p_lex) with statements that don't give exactly one value, read off the registers."""
    combined, slots = registers(rdf, predicates)
    cases = combined.flatMap(lambda x: [(x[0], slots.keys[k]) for k, v in x[1].items() if v in (_NONE, _CLASH)])
    return rdf.sparkSession.createDataFrame(cases, "s_lex string, p_lex string", verifySchema=False)
