"""The places of cells in lists of first and rest: runs of links that one task holds are contracted at once, what is cut between
tasks is joined by doubling. Work follows the cells, not the pairs of cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom import terms as t
from quadloom.runtime import Spool

#: Links that a task contracts at once.
BLOCK = 1_000_000


def key(term: Column) -> Column:
    """A resource as one string; null for other terms."""
    return F.when((term["k"] < 3) & (term["dt"] == "") & (term["lang"] == ""), F.concat(term["k"].cast("string"), term["lex"]))


def node(k: Column) -> Column:
    return t.struct(F.substring(k, 1, 1), F.substring(k, 2, 2**31 - 1))


def reached(rest: DataFrame, heads: DataFrame, spool: Spool) -> DataFrame:
    """(list, cell, i): the cells that each head (column list) reaches over links (s, o), counted from 0, in rounds: any graph will do."""
    rest = spool.write(rest)
    known = front = spool.write(heads.select("list", F.col("list").alias("cell"), F.lit(0).cast("bigint").alias("i")))
    while not front.isEmpty():
        step = front.join(rest, front["cell"] == rest["s"]).select("list", F.col("o").alias("cell"), (F.col("i") + 1).alias("i")).distinct()
        front = spool.write(step.join(known, ["list", "cell"], "left_anti"))  # ends on circular lists
        known = known.union(front)
    return known


def places(rest: DataFrame, spool: Spool) -> tuple[DataFrame, DataFrame | None] | None:
    """(cell, chain, pos, n): the list that a cell lies in, its place there, and the cells from it on; and the cells of circular lists
    (column cell), where there are any. ``rest``: keys s and o, o null at the end of a list.

    None where a cell has two links, two cells link to one, a link repeats, or a key is missing.
    """
    spooled = spool.write(rest.select("s", "o").mapInArrow(_Runs(BLOCK), "cell string, run string, off bigint, n bigint, end string"))
    # equal hashes of different cells would only send the graph the slower way
    if spooled.where("cell IS NULL").limit(1).count() or spooled.select(F.xxhash64("cell")).distinct().count() < spooled.count():
        return None
    cells, runs = spooled.select("cell", "run", "off", "n"), spooled.where("off = 0")
    ends = runs.where("end IS NOT NULL").select("end", "run", "n")
    if ends.isEmpty():
        return cells.select("cell", F.col("run").alias("chain"), F.col("off").alias("pos"), (F.col("n") - F.col("off")).alias("n")), None
    links = spool.write(ends.join(spooled.select(F.col("cell").alias("end"), "off"), "end", "left"))
    if not links.where("off > 0").isEmpty() or not links.groupBy("end").count().where("count > 1").isEmpty():
        return None
    tails = links.where("off IS NULL").select(F.col("end").alias("cell"), F.col("end").alias("run"), F.lit(0).cast("bigint").alias("off"), F.lit(1).cast("bigint").alias("n"))
    state, before = links.select(F.col("end").alias("run"), F.col("run").alias("up"), F.col("n").alias("base"), F.lit(True).alias("open")), None
    while True:
        above = state.select(F.col("run").alias("up"), F.col("up").alias("up2"), F.col("base").alias("base2"))
        step = state.join(above, "up", "left").select("run", F.coalesce("up2", "up").alias("up"), (F.col("base") + F.coalesce("base2", F.lit(0))).alias("base"), F.col("up2").isNotNull().alias("open"))
        state = spool.write(step)
        left = state.where("open").count()
        if left in (0, before):  # each round settles some run of every list that ends
            break
        before = left
    cells = cells.union(tails)
    circular = None
    if left:
        runs_ = state.where("open").select("run")
        circular = spool.write(cells.join(runs_, "run", "left_semi").select("cell"))
        cells = cells.join(runs_, "run", "left_anti")
    fix = state.where("NOT open").select("run", F.col("up").alias("chain"), "base")
    sizes = runs.select("run", "n").union(tails.select("run", "n"))
    total = fix.select("run", "chain").union(fix.select(F.col("chain").alias("run"), "chain").distinct()).join(sizes, "run").groupBy("chain").agg(F.sum("n").alias("total"))
    fix = spool.write(fix.union(total.select(F.col("chain").alias("run"), "chain", F.lit(0).cast("bigint"))).join(total, "chain").select("run", "chain", "base", "total"))
    pos = F.col("off") + F.coalesce("base", F.lit(0))
    out = cells.join(fix, "run", "left").select("cell", F.coalesce("chain", "run").alias("chain"), pos.alias("pos"), (F.coalesce("total", "n") - pos).alias("n"))
    return out, circular


class _Runs:
    """Links to the runs that they form: each cell with the first of its run, its place in it, and, at the first, where the run leads."""

    def __init__(self, block: int) -> None:
        self.block = block

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= self.block:
                yield from _contract(held)
                held, rows = [], 0
        if rows:
            yield from _contract(held)


def _contract(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    s, o = (pa.concat_arrays([b.column(k) for b in batches]) for k in (0, 1))
    m = len(s)
    ids = pa.concat_arrays([s, o]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    here = np.arange(m)
    next_ = np.where(ids[m:] < m, ids[m:], -1)
    inner = next_ >= 0
    if s.null_count or (ids[:m] != here).any() or len(np.unique(next_[inner])) < inner.sum():
        next_[:], inner[:] = -1, False  # not the shape of lists, which the caller finds
    prev = np.full(m, -1)
    prev[next_[inner]] = here[inner]
    first, off = np.where(prev >= 0, prev, here), (prev >= 0).astype(np.int64)
    for _ in range(m.bit_length() + 1):
        up = first[first]
        if (up == first).all():
            break
        off, first = off + off[first], up
    around = prev[first] >= 0
    first, off = np.where(around, here, first), np.where(around, 0, off)
    last = ~inner | around
    end = np.zeros(m, np.int64)
    end[first[last]] = here[last]
    n = np.bincount(first, minlength=m)[first]
    columns = [s, s.take(pa.array(first)), pa.array(off), pa.array(n), o.take(pa.array(end, mask=off > 0))]
    whole = pa.RecordBatch.from_arrays(columns, names=["cell", "run", "off", "n", "end"])
    for i in range(0, m, 50_000):
        yield whole.slice(i, 50_000)
