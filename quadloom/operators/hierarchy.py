"""Parent-child links of unknown depth: paths, depths, roots, descendants and cycles, by bottom-up leaf peeling.

Each round takes away the links of all nodes that have no child left. When at most ``finish_links`` links remain (their number is
counted in every round, so the bound holds), one task goes on peeling them in linear time, by the same rule; otherwise the rounds
stay distributed. What neither way can peel holds every cycle and what lies above one: it is trimmed from the top likewise, and an
exact test for strong components tells the nodes on a cycle from those between two cycles (``_core_cycles`` in distributed rounds).

Paths are given out in reverse order of peeling: a node's parents are always peeled after it, so their paths are known.
Descendants go the other way: each round sends the lists of its leaves to their parents, and what is left is settled by closure.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.runtime import Spool, task_slots

UP = ("skos:broader", "urn:x:v/partOf", "rdfs:subClassOf")
DOWN = ("skos:narrower", "urn:x:v/hasPart")

#: Most links, and most characters of their names, that one task peels alone.
FINISH_LINKS = 50_000
FINISH_CHARS = 20_000_000
_PAIRS = "node string, descendant string, distance int"
_PATHS = "node string, parent string, path array<string>, state string"


def statement_links(rdf: DataFrame, up: tuple[str, ...] = UP, down: tuple[str, ...] = DOWN) -> DataFrame:
    """Distinct (child, parent) from statements made at either end. Statements without a subject or object are no links."""
    is_up = F.col("p_lex").isin(*up)
    links = rdf.where(F.col("p_lex").isin(*up, *down)).select(
        F.when(is_up, F.col("s_lex")).otherwise(F.col("o_lex")).alias("child"), F.when(is_up, F.col("o_lex")).otherwise(F.col("s_lex")).alias("parent")
    )
    return links.where("child IS NOT NULL AND parent IS NOT NULL").distinct()


@dataclass
class Peeled:
    links: DataFrame
    rounds: list[DataFrame] = field(default_factory=list)  # (child, parent) of each round's leaves
    tail: DataFrame | None = None  # links left when peeling stopped
    tail_count: int = 0
    small: bool = True


def peel(links: DataFrame, spool: Spool, finish_links: int = FINISH_LINKS) -> Peeled:
    links = spool.write(links)
    out, rest = Peeled(links), links
    n, chars = _size(links)
    while n > finish_links or chars > FINISH_CHARS:
        parents = rest.select(F.col("parent").alias("_p")).distinct()
        flagged = spool.write(rest.join(parents, rest["child"] == parents["_p"], "left").select("child", "parent", F.col("_p").isNull().alias("leaf")))
        rest = flagged.where("NOT leaf").drop("leaf")
        left, chars = _size(rest)
        if left == n:
            out.small = False
            break
        out.rounds.append(flagged.where("leaf").drop("leaf"))
        n = left
    out.tail, out.tail_count = rest, n
    return out


def _size(links: DataFrame) -> tuple[int, int]:
    r = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("child") + F.length("parent")).alias("c")).first()
    return r.n, r.c or 0


@dataclass
class Core:
    """A bounded graph after peeling in one task."""

    up: dict[str, list[str]]  # parents of each node
    peeled: list[str]  # nodes with parents, children before parents
    cyclic: set[str]


def _peel_core(children: list[str], parents: list[str]) -> Core:
    """Leaves go until none is left; of the rest, tops go until none is left; what stays is tested for strong components."""
    up: dict[str, list[str]] = {}
    down: dict[str, list[str]] = {}
    for c, p in zip(children, parents):
        up.setdefault(c, []).append(p)
        down.setdefault(p, []).append(c)
    order, left = _strip(up, down, set(up) | set(down))
    _, core = _strip(down, up, left)
    inner = {n: [p for p in up.get(n, ()) if p in core] for n in core}
    return Core(up, [n for n in order if n in up], _on_cycles(inner))


def _strip(towards: dict[str, list[str]], behind: dict[str, list[str]], nodes: set[str]) -> tuple[list[str], set[str]]:
    """Takes away nodes with no node of ``nodes`` behind them, again and again: those taken, in order, and those left."""
    waits = {n: sum(m in nodes for m in behind.get(n, ())) for n in nodes}
    taken = [n for n, k in waits.items() if not k]
    for n in taken:  # grows while it is read
        for m in towards.get(n, ()):
            if m in waits:
                waits[m] -= 1
                if not waits[m]:
                    taken.append(m)
    return taken, nodes.difference(taken)


def _on_cycles(up: dict[str, list[str]]) -> set[str]:
    """Nodes of strong components with a link inside; Tarjan's algorithm without recursion."""
    cyclic = {n for n, ps in up.items() if n in ps}
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    on: set[str] = set()
    stack: list[str] = []
    for start in up:
        if start in order:
            continue
        work = [(start, iter(up[start]))]
        order[start] = low[start] = len(order)
        stack.append(start)
        on.add(start)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in order:
                    order[nxt] = low[nxt] = len(order)
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(up.get(nxt, ()))))
                    break
                if nxt in on:
                    low[node] = min(low[node], order[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    group = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        group.append(x)
                        if x == node:
                            break
                    if len(group) > 1:
                        cyclic.update(group)
    return cyclic


def _whole(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    got = [b for b in batches if len(b)]
    return pd.concat(got, ignore_index=True) if got else pd.DataFrame({"child": [], "parent": [], "share": []})


def _finish_cycles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tail = _whole(batches)
    yield pd.DataFrame({"node_lex": sorted(_peel_core(list(tail["child"]), list(tail["parent"])).cyclic)}, dtype=object)


def _finish_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tail = _whole(batches)
    core = _peel_core(list(tail["child"]), list(tail["parent"]))
    up, cyclic = core.up, core.cyclic
    # what was not peeled comes first, from the top; then the peeled nodes in reverse order
    rest = set(up).difference(core.peeled, cyclic)
    above = {n: [p for p in up[n] if p in rest] for n in rest}
    below: dict[str, list[str]] = {}
    for n, ps in above.items():
        for p in ps:
            below.setdefault(p, []).append(n)
    order = _strip(below, above, rest)[0] + core.peeled[::-1]
    # each node's own way up is kept as its first step and its length; a root has length 0
    first: dict[str, tuple[int, str | None]] = {p: (0, None) for ps in up.values() for p in ps if p not in up}
    for n in order:
        ways = [(first[p][0] + 1, p) for p in up[n] if p in first]
        if ways:
            first[n] = min(ways)

    def path(n: str) -> list[str]:
        out = [n]
        while (p := first[out[-1]][1]) is not None:
            out.append(p)
        return out[::-1]

    rows: list[tuple] = []
    size = 0
    for n in (*sorted(cyclic), *order):
        sound = [p for p in up[n] if p in first] if n not in cyclic else []
        ways = [(n, p, [*path(p), n], "tree") for p in sound] or [(n, None, None, "cycle" if n in cyclic else "below_cycle")]
        for w in ways:
            rows.append(w)
            size += len(w[2] or ())
            if size > 200_000:
                yield _frame(rows)
                rows, size = [], 0
    yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["node", "parent", "path", "state"], dtype=object)


def _core_cycles(links: DataFrame, spool: Spool) -> DataFrame:
    """Nodes on cycles of a graph too large for one task: trim from the top, spread the greatest ancestor, take the components.

    color(v) is the greatest node among v and its ancestors. The component of a node r with color(r) = r is the set of nodes
    of color r that r reaches upward. Components found are removed; the rest goes round again.
    """
    found, rest = [], links
    while True:
        while True:  # links to nodes without parents end outside any cycle
            children = rest.select(F.col("child").alias("_c")).distinct()
            n = rest.count()
            was, rest = rest, spool.write(rest.join(children, rest["parent"] == children["_c"], "left_semi"))
            if was is not links:  # the caller's
                spool.forget(was)
            if rest.count() == n:
                break
        if n == 0:
            break
        color = spool.write(rest.select(F.col("child").alias("v")).distinct().select("v", F.col("v").alias("c")))
        while True:
            above = rest.join(color.select(F.col("v").alias("parent"), F.col("c").alias("pc")), "parent").groupBy(F.col("child").alias("v")).agg(F.max("pc").alias("pc"))
            new = spool.write(color.join(above, "v", "left").select("v", F.greatest("c", "pc").alias("c"), (F.col("pc") > F.col("c")).alias("moved")))
            spool.forget(color)
            color = new.drop("moved")
            if new.where("moved").isEmpty():
                break
        inside = rest.join(color.withColumnRenamed("v", "child"), "child").join(color.select(F.col("v").alias("parent"), F.col("c").alias("pc")), "parent").where("c = pc").select("child", "parent")
        inside = spool.write(inside)
        front = spool.write(color.where("v = c").select("v"))
        reached = front
        while True:
            step = inside.join(front.withColumnRenamed("v", "child"), "child").select(F.col("parent").alias("v")).distinct()
            front = spool.write(step.join(reached, "v", "left_anti"))
            if front.isEmpty():
                break
            reached = spool.write(reached.union(front))
        on_cycle = inside.join(reached.select(F.col("v").alias("child")), "child", "left_semi").join(reached.select(F.col("v").alias("parent")), "parent", "left_semi")
        found.append(spool.write(on_cycle.select(F.col("child").alias("node_lex")).distinct()))
        gone = reached.select(F.col("v").alias("child"))
        rest = spool.write(rest.join(gone, "child", "left_anti").join(gone.withColumnRenamed("child", "parent"), "parent", "left_anti"))
    if not found:
        return links.select(F.col("child").alias("node_lex")).limit(0)
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def cycle_nodes(links: DataFrame, finish_links: int = FINISH_LINKS) -> DataFrame:
    """Nodes that are their own ancestors, a direct parent of itself included. Links must be distinct pairs without nulls."""
    spool = Spool(links.sparkSession)
    peeled = peel(links, spool, finish_links)
    if peeled.small:
        return peeled.tail.coalesce(1).mapInPandas(_finish_cycles, "node_lex string")
    return _core_cycles(peeled.tail, spool)


def hierarchy(links: DataFrame, finish_links: int = FINISH_LINKS, peeled: Peeled | None = None) -> DataFrame:
    """node, parent, path (array, root first, the node last), root, depth (0 for a root), state: one row per link of each node.

    In a tree that is one row per node. A node with several parents has a row for each parent that has a way up, whose path goes
    on along the parent's own: the shortest way to a root, through the least name where several are as short. So a graph that is
    no tree has as many rows as links, however many ways lead through it. Ways that pass a cycle are none: a node on a cycle has
    one row without path, root and depth (state 'cycle'), also if it has an exit to a root, and so has a node whose ways all
    pass a cycle ('below_cycle'). Empty input gives no rows.
    """
    spool = Spool(links.sparkSession)
    peeled = peeled or peel(links, spool, finish_links)
    all_links, rounds = peeled.links, list(peeled.rounds)
    children = all_links.select(F.col("child").alias("node")).distinct()
    roots = all_links.select(F.col("parent").alias("node")).distinct().join(children, "node", "left_anti")
    root_rows = roots.select("node", F.lit(None).cast("string").alias("parent"), F.array("node").alias("path"), F.lit("tree").alias("state"))
    if peeled.small:
        tail_rows = peeled.tail.coalesce(1).mapInPandas(_finish_paths, _PATHS)
    else:
        on_cycle = spool.write(_core_cycles(peeled.tail, spool))
        core_rows = on_cycle.select(F.col("node_lex").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("array<string>").alias("path"), F.lit("cycle").alias("state"))
        tail_rows = _core_paths(peeled.tail, core_rows, root_rows, spool)
    known = spool.write(root_rows.union(tail_rows))
    parts = [known]
    for leaves in reversed(rounds):
        above = _own_path(known).select(F.col("node").alias("parent"), F.col("path").alias("up"))
        rows = leaves.join(above, "parent", "left").select(
            F.col("child").alias("node"),
            F.when(F.col("up").isNotNull(), F.col("parent")).alias("parent"),
            F.when(F.col("up").isNotNull(), F.concat("up", F.array("child"))).alias("path"),
            F.when(F.col("up").isNotNull(), F.lit("tree")).otherwise(F.lit("below_cycle")).alias("state"),
        )
        parts.append(spool.write(rows))
        known = known.union(parts[-1])
    whole = known.where("path IS NOT NULL")
    broken = known.where("path IS NULL").select("node", "state").distinct().join(whole.select("node"), "node", "left_anti")
    broken = broken.select("node", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("array<string>").alias("path"), "state")
    return whole.union(broken).select("node", "parent", "path", F.element_at("path", 1).alias("root"), (F.size("path") - 1).alias("depth"), "state").withColumn("depth", F.when(F.col("path").isNotNull(), F.col("depth")))


def _own_path(rows: DataFrame) -> DataFrame:
    """(node, path): of each node's rows the one of the shortest path, the least parent at a tie."""
    return rows.where("path IS NOT NULL").groupBy("node").agg(F.min_by("path", F.struct(F.size("path").alias("n"), "parent")).alias("path"))


def _core_paths(tail: DataFrame, cycle_rows: DataFrame, root_rows: DataFrame, spool: Spool) -> DataFrame:
    """Paths of a leafless core too large for one task, level by level from the top; what no level reaches lies under a cycle."""
    off = spool.write(tail.join(cycle_rows.select(F.col("node").alias("child")), "child", "left_anti"))
    up = lambda rows: rows.select(F.col("node").alias("parent"), F.col("path").alias("up"))
    below = lambda rows: off.join(up(rows), "parent").select(F.col("child").alias("node"), "parent", F.concat("up", F.array("child")).alias("path"), F.lit("tree").alias("state"))
    own = front = root_rows.select("node", "path")
    while True:
        front = spool.write(_own_path(below(front)).join(own.select("node"), "node", "left_anti"))
        if front.isEmpty():
            break
        own = own.union(front)
    out = cycle_rows.union(below(own))
    left = off.select(F.col("child").alias("node")).distinct().join(out.select("node"), "node", "left_anti")
    return out.union(left.select("node", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("array<string>").alias("path"), F.lit("below_cycle").alias("state")))


def all_descendants(links: DataFrame, finish_links: int = FINISH_LINKS, peeled: Peeled | None = None) -> DataFrame:
    """(node_lex, descendant_lex, distance): one row per node and descendant, nearest way; lists stay rows, as a root may head a third of all nodes.

    Each round of peeling sends the lists of its leaves, whole by then, to their parents. What peeling leaves, cycles and all
    above them, is settled by closure. A node on a cycle is its own descendant, at the length of its shortest cycle.
    """
    spool = Spool(links.sparkSession)
    peeled = peeled or peel(links, spool, finish_links)
    parts: list[DataFrame] = []
    waiting: DataFrame | None = None  # rows received by nodes that are not peeled yet
    for leaves in peeled.rounds:
        sent = leaves.select(F.col("parent").alias("node"), F.col("child").alias("descendant"), F.lit(1).alias("distance"))
        if waiting is not None:
            ready = leaves.select(F.col("child").alias("_c")).distinct()
            flagged = spool.write(waiting.join(ready, waiting["node"] == ready["_c"], "left").select("node", "descendant", "distance", F.col("_c").isNotNull().alias("whole")))
            parts.append(spool.write(_nearest(flagged.where("whole"))))
            on = parts[-1].join(leaves, parts[-1]["node"] == leaves["child"]).select(F.col("parent").alias("node"), "descendant", (F.col("distance") + 1).alias("distance"))
            sent = sent.union(on).union(flagged.where("NOT whole").drop("whole"))
        waiting = sent
    if peeled.small:
        n = max(1, min(task_slots(links.sparkSession), peeled.tail_count // 5000))
        copies = peeled.tail.select("child", "parent", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("share"), F.lit(n).alias("shares"))
        core = copies.repartition(n, "share").mapInPandas(_finish_pairs, _PAIRS)
    else:
        core = _core_pairs(peeled.tail, spool)
    if waiting is not None:
        core, waiting = spool.write(core), spool.write(_nearest(waiting))
        below = waiting.select(F.col("node").alias("_n"), F.col("descendant").alias("_d"), F.col("distance").alias("_k"))
        through = core.join(below, core["descendant"] == below["_n"]).select("node", F.col("_d").alias("descendant"), (F.col("distance") + F.col("_k")).alias("distance"))
        core = _nearest(core.union(waiting).union(through))
    for x in parts:
        core = core.union(x)
    return core.select(F.col("node").alias("node_lex"), F.col("descendant").alias("descendant_lex"), "distance")


def _nearest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("node", "descendant").agg(F.min("distance").alias("distance"))


def _finish_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of a bounded graph, level by level from each node of a share."""
    for share, tail in _whole(batches).groupby("share"):
        down: dict[str, list[str]] = {}
        for c, p in zip(tail["child"], tail["parent"]):
            down.setdefault(p, []).append(c)
        rows: list[tuple] = []
        for start in sorted(down)[share :: int(tail["shares"].iloc[0])]:
            seen: set[str] = set()
            front, distance = [start], 0
            while front:
                distance += 1
                new = {c for x in front for c in down.get(x, ())} - seen
                seen |= new
                front = list(new)
                rows += [(start, c, distance) for c in front]
                if len(rows) > 100_000:
                    yield pd.DataFrame(rows, columns=["node", "descendant", "distance"])
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["node", "descendant", "distance"])


def _core_pairs(links: DataFrame, spool: Spool) -> DataFrame:
    """Pairs of a graph too large for one task. Each round doubles the distance covered: a longer shortest way splits where the
    last distance ends, so only the pairs of exactly that distance are joined."""
    known = front = spool.write(links.select(F.col("parent").alias("node"), F.col("child").alias("descendant"), F.lit(1).alias("distance")))
    reached = 1
    while True:
        rest = known.select(F.col("node").alias("_n"), F.col("descendant").alias("_d"), F.col("distance").alias("_k"))
        far = front.where(F.col("distance") == reached)
        new = far.join(rest, far["descendant"] == rest["_n"]).select("node", F.col("_d").alias("descendant"), (F.col("distance") + F.col("_k")).alias("distance"))
        front = spool.write(_nearest(new).join(known, ["node", "descendant"], "left_anti"))
        if front.isEmpty():
            return known
        known, reached = known.union(front), reached * 2


def subtree_sizes(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("node_lex").agg(F.count(F.lit(1)).alias("n_descendants"))
