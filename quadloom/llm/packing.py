"""Items of varying length into containers of one capacity: hierarchical packing over context-size tiers.

Tier k is the context size capacity / 2^k; an item is routed to the smallest context that holds it. Only sizes decide a packing,
and there are at most ``capacity`` of them, so the plan is made from the histograms of the tiers: their rows, not the items,
reach the driver. From the longest tier on, a tier's items first fill the gaps of the longer tiers' containers, each the
tightest gap that holds it; the rest is packed by itself, into containers that hold as many windows of the tier's context as fit.
Items then find their place by their rank among those of equal size, counted in parallel. Containers are sorted by their cost
(the sum of the squares of their lengths, as attention has it) and dealt to step groups back and forth, so that the groups carry
equal costs.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadloom.runtime import task_slots

#: Ranks are counted per size and salt, so that a size which a third of all items have is spread; at least so many salts, and as
#: many as the cluster has reduce tasks.
SALTS = 64
BLOCK = 1024


@dataclass
class Run:
    """``copies`` items of one size from ``offset`` on, in each of ``containers`` containers; ranks from ``rank`` on."""

    size: int
    copies: int
    offset: int
    rank: int = 0


@dataclass
class Pattern:
    """``containers`` containers of the same content. ``tier``: whose items opened them."""

    fill: int
    containers: int
    runs: tuple[Run, ...]
    tier: int = 0

    def cost(self) -> int:
        return sum(r.copies * r.size * r.size for r in self.runs)


def tier_of(size: int, capacity: int) -> int:
    """0 for sizes above half of the capacity, 1 above a quarter, and so on; size 0 is of the last tier."""
    k = 0
    while size and size * 2 ** (k + 1) <= capacity:
        k += 1
    return k if size else capacity.bit_length()


def route(histogram: dict[int, int], capacity: int) -> dict[int, dict[int, int]]:
    """The histogram of each tier, from the longest context on. Size 0 needs no room and is in none."""
    tiers: dict[int, dict[int, int]] = {}
    for size, n in histogram.items():
        if size > capacity:
            raise ValueError("items above the capacity must be split first")
        if size > 0 and n > 0:
            tiers.setdefault(tier_of(size, capacity), {})[size] = n
    return dict(sorted(tiers.items()))


class Containers:
    """Open containers by their gap."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.gaps: list[int] = []  # ascending
        self.at: dict[int, list[Pattern]] = {}

    def put(self, p: Pattern) -> None:
        gap = self.capacity - p.fill
        if gap not in self.at:
            bisect.insort(self.gaps, gap)
            self.at[gap] = []
        self.at[gap].append(p)

    def take(self, size: int) -> Pattern | None:
        """Containers of the tightest gap that holds the size."""
        i = bisect.bisect_left(self.gaps, size)
        if i == len(self.gaps):
            return None
        gap = self.gaps[i]
        p = self.at[gap].pop()
        if not self.at[gap]:
            del self.at[gap], self.gaps[i]
        return p

    def fill(self, sizes: dict[int, int]) -> dict[int, int]:
        """Puts items into gaps, the longest first; what is left over."""
        rest = {}
        for size in sorted(sizes, reverse=True):
            left = sizes[size]
            while left and (p := self.take(size)):
                copies = (self.capacity - p.fill) // size
                whole = min(p.containers, left // copies)
                if not whole:
                    whole, copies = 1, left
                if p.containers > whole:
                    self.put(Pattern(p.fill, p.containers - whole, p.runs, p.tier))
                self.put(Pattern(p.fill + copies * size, whole, (*p.runs, Run(size, copies, p.fill)), p.tier))
                left -= whole * copies
            if left:
                rest[size] = left
        return rest

    def all(self) -> list[Pattern]:
        return [p for ps in self.at.values() for p in ps]


def pack_tier(sizes: dict[int, int], tier: int, capacity: int) -> list[Pattern]:
    """One tier by itself. The windows of a container lie side by side without the rest of each, so that the rests are one gap."""
    own = Containers(capacity)
    for size in sorted(sizes, reverse=True):
        left = own.fill({size: sizes[size]}).get(size, 0)
        copies = capacity // size
        if left >= copies:
            own.put(Pattern(copies * size, left // copies, (Run(size, copies, 0),), tier))
        if left % copies:
            own.put(Pattern(left % copies * size, 1, (Run(size, left % copies, 0),), tier))
    return own.all()


def plan(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns of equal containers. Sizes 1 to capacity; work and memory follow the number of sizes, not of items."""
    packed = Containers(capacity)
    for tier, sizes in route(histogram, capacity).items():
        for p in pack_tier(packed.fill(sizes), tier, capacity):
            packed.put(p)
    return sorted(packed.all(), key=lambda p: (-p.cost(), -p.fill, p.tier, [(r.size, r.copies) for r in p.runs]))


def _plan_rows(patterns: list[Pattern]) -> tuple[list[tuple], int]:
    """(size, rank from, rank until, first container, copies, offset, context tier of the container) and the number of containers."""
    rows, rank, container = [], {}, 0
    for p in patterns:
        for r in p.runs:
            start = rank.get(r.size, 0)
            n = r.copies * p.containers
            rank[r.size] = start + n
            rows.append((r.size, start, start + n, container, r.copies, r.offset, p.tier))
        container += p.containers
    return rows, container


def pack(items: DataFrame, key: str, size: str, capacity: int, group: int = 64) -> DataFrame:
    """key, piece_no, piece_start, n_tokens, tier, context, container, place, step_group: where each item, or piece of one, goes.

    tier is the one the item was routed to, context the tier whose items opened its container (null for items of size 0).

    Only an item above the capacity is split: into full pieces and one rest. A null size counts as 0. Items of size 0 take no
    space and go to existing containers at place 0 (to container 0 if there is no other). A container holds no more than the
    capacity and its pieces do not overlap. Keys may repeat or be null; rows that are alike in key and size are interchangeable.
    ``group``: containers per step group.
    """
    if capacity < 1 or group < 1:
        raise ValueError("capacity and group must be positive")
    spark = items.sparkSession
    salts = max(SALTS, task_slots(spark))
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("bigint"), F.lit(0))
    last = F.greatest(F.ceil(F.col("n") / F.lit(capacity)) - 1, F.lit(0))
    pieces = items.select(F.col(key).alias("key"), n.alias("n"), F.xxhash64(F.col(key), F.col(size)).alias("h")).withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    start = F.col("piece_no") * capacity
    pieces = pieces.select("key", "piece_no", start.alias("piece_start"), F.least(F.col("n") - start, F.lit(capacity)).cast("int").alias("size"), F.pmod(F.hash("h", "piece_no"), F.lit(salts)).alias("salt"))
    counts = pieces.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n"))
    by_size = {r.size: r.n for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most capacity + 1 rows
    patterns = plan(by_size, capacity)
    rows, containers = _plan_rows(patterns)
    steps = max(1, -(-containers // group))
    base = counts.select("size", "salt", (F.sum("n").over(Window.partitionBy("size").orderBy("salt")) - F.col("n")).alias("base"))
    within = F.row_number().over(Window.partitionBy("size", "salt").orderBy("key", "piece_no"))
    ranked = pieces.withColumn("r", within).join(base, ["size", "salt"]).withColumn("rank", F.col("base") + F.col("r") - 1)
    places = spark.createDataFrame(rows, "size int, lo bigint, hi bigint, first bigint, copies bigint, offset bigint, context int")
    places = places.withColumn("block", F.explode(F.expr(f"sequence(lo div {BLOCK}, (hi - 1) div {BLOCK})")))
    filled = ranked.where("size > 0").withColumn("block", F.expr(f"rank div {BLOCK}")).join(places, ["size", "block"]).where("rank >= lo AND rank < hi")
    filled = filled.select("key", "piece_no", "piece_start", "size", (F.col("first") + F.expr("(rank - lo) div copies")).alias("container"), (F.col("offset") + F.expr("(rank - lo) % copies") * F.col("size")).alias("place"), "context")
    empty = ranked.where("size = 0").select("key", "piece_no", "piece_start", "size", F.pmod("rank", F.lit(max(1, containers))).cast("bigint").alias("container"), F.lit(0).cast("bigint").alias("place"), F.lit(None).cast("int").alias("context"))
    turn = F.col("container") % steps
    group_no = F.when(F.expr(f"container div {steps}") % 2 == 0, turn).otherwise(F.lit(steps - 1) - turn)
    tier = F.when(F.col("size") == 0, capacity.bit_length()).otherwise(F.floor(F.log2(F.lit(float(capacity)) / F.col("size")))).cast("int")
    return filled.union(empty).select(F.col("key").alias(key), "piece_no", "piece_start", F.col("size").cast("bigint").alias("n_tokens"), tier.alias("tier"), "context", "container", "place", group_no.alias("step_group"))
