"""Closures over edges: semi-naive iteration with lineage cut in every round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.runtime import Spool, task_slots

#: Most edges that every task may hold; a closure over so few is searched from each node at once instead of in rounds.
HELD_EDGES = 50_000


def reach(seed: DataFrame, edges: DataFrame, max_rounds: int | None = None, spool: Spool | None = None) -> DataFrame:
    """(s, o): all pairs of seed (s, o) and those its o reaches over edges (s, o), each once. Cycles end, as old pairs drop out.

    Each round joins only the pairs that the last one added. ``max_rounds`` raises rather than cutting the result short.
    """
    spool = spool or Spool(seed.sparkSession)
    step = spool.write(edges.select(F.col("s").alias("_from"), F.col("o").alias("_to")).where("_from IS NOT NULL AND _to IS NOT NULL").distinct())
    known = front = spool.write(seed.select("s", "o").where("s IS NOT NULL AND o IS NOT NULL").distinct())
    rounds = 0
    while not front.isEmpty():
        rounds += 1
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError(f"the closure needs more than {max_rounds} rounds")
        new = front.join(step, front["o"] == step["_from"]).select("s", F.col("_to").alias("o")).distinct()
        front = spool.write(new.join(known, ["s", "o"], "left_anti"))
        known = known.union(front)
    return known


def closure(edges: DataFrame, spool: Spool | None = None, held_edges: int = HELD_EDGES) -> DataFrame:
    """(s, o): all pairs that edges (s, o) connect in one step or more, each once. Edges without an end are none.

    Schemas and other small graphs (at most ``held_edges`` edges, counted) are copied to the tasks, each of which searches from a
    share of the nodes; only pairs leave, so no task holds more than the edges. Larger ones go in rounds. A round joins the pairs that the last one found with all pairs known, which doubles the length of the paths covered: the
    pairs found last are those of more than half the length reached, so every longer shortest path splits at one of them.
    """
    spool = spool or Spool(edges.sparkSession)
    known = front = spool.write(edges.select("s", "o").where("s IS NOT NULL AND o IS NOT NULL").distinct())
    if known.count() <= held_edges:
        n = task_slots(edges.sparkSession)
        shares = known.select("s", "o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("share"), F.lit(n).alias("shares"))
        return shares.repartition(n, "share").mapInArrow(_search, known.schema)
    while True:
        tail = known.select(F.col("s").alias("_m"), F.col("o").alias("_o"))
        new = front.join(tail, front["o"] == tail["_m"]).select("s", F.col("_o").alias("o")).distinct()
        front = spool.write(new.join(known, ["s", "o"], "left_anti"))
        if front.isEmpty():
            return known
        known = known.union(front)


def _frozen(x):
    return tuple(map(_frozen, x.values())) if isinstance(x, dict) else x


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs from each node of the shares that the task got; every share carries all edges."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got)
    shares = table.column("share").unique().to_pylist()
    table = table.filter(pa.compute.equal(table.column("share"), shares[0]))
    ends = pa.concat_arrays([c for k in ("s", "o") for c in table.column(k).chunks])
    number: dict = {}
    ids = [number.setdefault(_frozen(x), len(number)) for x in ends.to_pylist()]
    first = np.full(len(number), -1)
    first[ids[::-1]] = np.arange(len(ids))[::-1]
    down: list[list[int]] = [[] for _ in number]
    for a, b in zip(ids[: table.num_rows], ids[table.num_rows :]):
        down[a].append(b)
    # a node's share follows from its name, as the order of the rows may differ from task to task
    order = sorted((x for x in number if down[number[x]]), key=repr)
    n = table.column("shares")[0].as_py()
    out: list[list[int]] = [[], []]
    for share in shares:
        for start in map(number.get, order[share::n]):
            seen, front = set(), down[start]
            while front:
                front = [x for x in dict.fromkeys(front) if x not in seen]
                seen.update(front)
                out[0] += [start] * len(front)
                out[1] += front
                front = [y for x in front for y in down[x]]
                if len(out[0]) > 100_000:
                    yield _pairs(ends, first, out)
                    out = [[], []]
    yield _pairs(ends, first, out)


def _pairs(ends: pa.Array, first: np.ndarray, out: list[list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ends.take(pa.array(first[np.array(x, np.int64)])) for x in out], names=["s", "o"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): connected components of undirected links; the component's name is its least node.

    Labels travel along links and, by pointer jumping, along labels, so rounds follow the logarithm of a component's length.
    """
    spool = Spool(edges.sparkSession)
    links = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    links = spool.write(links.union(links.select("y", "x")).distinct())
    labels = spool.write(links.groupBy(F.col("x").alias("node")).agg(F.min(F.least("x", "y")).alias("c")))
    while True:
        near = links.join(labels.select(F.col("node").alias("y"), "c"), "y").groupBy(F.col("x").alias("node")).agg(F.min("c").alias("near"))
        new = labels.join(near, "node").select("node", F.least("c", "near").alias("l"), "c")
        far = labels.select(F.col("node").alias("l"), F.col("c").alias("jump"))
        new = spool.write(new.join(far, "l", "left").select("node", F.least("l", F.coalesce("jump", "l")).alias("c"), (F.least("l", F.coalesce("jump", "l")) < F.col("c")).alias("moved")))
        spool.forget(labels)
        labels = new.drop("moved")
        if new.where("moved").isEmpty():
            return labels.select("node", F.col("c").alias("component"))
