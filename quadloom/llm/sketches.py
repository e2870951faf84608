"""Distinct counts over huge identifier sets: registers of maximum leading-zero ranks, packed into one row a group.

The hash is md5, so that registers made by any engine, on any day, merge. The first ``BITS`` bits choose the register, the rank
is the number of leading zeros of the next 52 bits plus one. A group's registers are one sorted array of ``slot * 64 + rank``, of
at most 2 x REGISTERS entries (subjects and objects); a small group's array is as short as its identifiers are few. A register
table is a partial result: tables merge by register maximum, whatever rows they share. Estimates use the register histogram (the
improved raw estimator with its series for empty registers), which has no bias at the small end and needs no switch between
estimators. Standard error: 1.04 / sqrt(2^BITS).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.runtime import Spool

BITS = 12
REGISTERS = 1 << BITS
STANDARD_ERROR = 1.04 / math.sqrt(REGISTERS)
KEYS = ("day", "g_iri", "p_lex")
_SERIES = 22
#: A code is a slot, shifted, and a rank.
RANK_BITS = 6
RANKS = 1 << RANK_BITS


def _register(value: Column) -> tuple[Column, Column]:
    digest = F.md5(value)
    slot = F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")
    rest = F.ltrim(F.substring(digest, 4, 13), F.lit("0"))
    zeros = 4 * (13 - F.length(rest)) + F.translate(F.substring(rest, 1, 1), "123456789abcdef", "322111100000000").cast("int")  # of the first digit's four bits
    return slot, F.when(rest == "", 53).otherwise(zeros + 1).cast("tinyint")


def registers(rdf: DataFrame) -> DataFrame:
    """day, g_iri, p_lex, codes: one row per group. Slots below REGISTERS belong to subjects, those from REGISTERS on to objects.

    day is the date of added_at; a null day, graph or predicate is a group of its own. Null identifiers count nowhere; a group
    without any identifier has no row.
    """
    sides = F.array(F.struct(F.lit(0).alias("base"), F.col("s_lex").alias("id")), F.struct(F.lit(REGISTERS).alias("base"), F.col("o_lex").alias("id")))
    ids = rdf.select(F.to_date("added_at").alias("day"), "g_iri", "p_lex", F.explode(sides).alias("x")).select(*KEYS, "x.base", "x.id").where("id IS NOT NULL")
    slot, rank = _register(F.encode("id", "UTF-8"))
    return _pack(ids.select(*KEYS, ((F.col("base") + slot) * RANKS + rank).alias("code")), KEYS)


def _pack(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per group from rows of single codes. Codes are collected as a set on the map side already, whose size the registers
    bound, not the rows; of a slot's codes the greatest stays."""
    grouped = df.groupBy(*keys).agg(F.sort_array(F.collect_set("code")).alias("c"))
    codes = F.expr(f"filter(c, (x, i) -> coalesce(shiftright(get(c, i + 1), {RANK_BITS}) > shiftright(x, {RANK_BITS}), true))")
    return grouped.select(*keys, codes.alias("codes")).where(F.size("codes") > 0)


def _merge(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return _pack(df.select(*keys, F.explode("codes").alias("code")), keys)


def merge(*tables: DataFrame) -> DataFrame:
    """The registers of all rows behind the tables; rows counted in several tables count once."""
    out = tables[0].select(*KEYS, "codes")
    for t in tables[1:]:
        out = out.union(t.select(*KEYS, "codes"))
    return _merge(out, KEYS)


def _estimate(used: Column, power: Column) -> Column:
    """From the number of used registers and the sum of 2^-rank over these."""
    m = float(REGISTERS)
    empty = (m - used) / m
    series = empty
    for k in range(1, _SERIES + 1):
        series = series + F.pow(empty, F.lit(2.0**k)) * F.lit(2.0 ** (k - 1))
    raw = m * m / (2 * math.log(2)) / (power + m * series)
    return F.when(used == 0, 0).otherwise(F.round(raw)).cast("bigint")


def _finish(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    first_object = REGISTERS * RANKS
    sides = {"s": f"filter(codes, x -> x < {first_object})", "o": f"filter(codes, x -> x >= {first_object})"}
    parts = df.select(*keys, *[F.expr(e).alias(f"{k}_codes") for k, e in sides.items()])
    power = lambda k: F.expr(f"aggregate({k}_codes, 0D, (n, x) -> n + pow(2D, -(x & {RANKS - 1})))")
    est = parts.select(*keys, *[c for k in sides for c in (F.size(f"{k}_codes").alias(f"{k}_used"), power(k).alias(f"{k}_power"))])
    cells = [F.col(k) if k in keys else F.lit(None).cast("date" if k == "day" else "string").alias(k) for k in KEYS]
    counts = [_estimate(F.col(f"{x}_used"), F.col(f"{x}_power")).alias(n) for x, n in (("s", "n_subjects"), ("o", "n_objects"))]
    return est.select(F.lit("+".join(keys) or "all").alias("grouping"), *cells, *counts, F.lit(round(STANDARD_ERROR, 6)).alias("std_error"))


def estimates(regs: DataFrame) -> DataFrame:
    """grouping, day, g_iri, p_lex, n_subjects, n_objects, std_error for every combination of the keys, the whole included.

    Coarser groupings are made from the smallest finer one, each by register maximum. std_error is relative. The column
    ``grouping`` tells a null day of its own ('day...') from one that the grouping leaves out. No rows in, no rows out.
    """
    spool = Spool(regs.sparkSession)
    r = {KEYS: spool.write(regs)}
    for keys, parent in ((("day", "g_iri"), KEYS), (("day", "p_lex"), KEYS), (("g_iri", "p_lex"), KEYS), (("day",), ("day", "g_iri")), (("g_iri",), ("g_iri", "p_lex")), (("p_lex",), ("g_iri", "p_lex"))):
        r[keys] = spool.write(_merge(r[parent], keys)) if len(keys) == 2 else _merge(r[parent], keys)
    r[()] = _merge(r[("g_iri", "p_lex")], ())  # at most one array a map task goes to the last task
    out = None
    for keys, df in r.items():
        part = _finish(df, keys)
        out = part if out is None else out.union(part)
    return out
