"""Per-key processing when a few keys hold most records: fragment and replicate by estimated load.

1. Loads: the rows per key that will move, by partial aggregation. Keys above ``1 / (SPLIT * tasks)`` of all rows are *heavy*;
   there are fewer than ``SPLIT * tasks`` of them, so only those reach the driver. All other keys are folded into
   ``SPREAD * tasks`` hash bins, of which only the summed loads reach the driver.
2. Packing: heavy keys are cut into shards in proportion to their load, then shards and hash bins are packed onto tasks,
   largest first onto the least loaded (LPT).
3. Routing: every row gets the label of its task. A row of a heavy key takes the shard that its value hashes to, so that
   equal values of a key meet in one shard. The matching side is copied to the tasks that hold shards of its key, no others.
   Both tables of the plan are joined in, so that a query's plan has one size at any number of tasks.
4. Each task works on its fragments; shard results merge by key.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.runtime import Spool, task_slots

SPLIT = 4
SPREAD = 8


@dataclass
class FragmentPlan:
    """Where the fragments of each key go. ``heavy``: key -> tasks of its shards; ``bins``: hash bin -> task. ``total`` and
    ``load`` count what moves, ``rows`` the rows of the input behind it."""

    tasks: int
    total: int = 0
    heavy: dict[object, list[int]] = field(default_factory=dict)
    bins: list[int] = field(default_factory=list)
    load: list[float] = field(default_factory=list)
    rows: int = 0


def pack(heavy: list[tuple[object, int]], bins: dict[int, int], tasks: int, n_bins: int) -> FragmentPlan:
    """LPT bin packing of shards and hash bins onto tasks; pure and deterministic."""
    total = sum(n for _, n in heavy) + sum(bins.values())
    share = max(1.0, total / (SPLIT * tasks))
    pieces: list[tuple[float, int, object]] = []
    for key, n in heavy:
        shards = min(tasks, max(1, -(-n // int(max(1, share)))))
        pieces += [(n / shards, 0, (key, k)) for k in range(shards)]
    pieces += [(float(bins.get(b, 0)), 1, b) for b in range(n_bins)]
    pieces.sort(key=lambda x: (-x[0], x[1], str(x[2])))
    heap = [(0.0, t) for t in range(tasks)]
    plan = FragmentPlan(tasks, total, {}, [0] * n_bins, [0.0] * tasks)
    for load, kind, what in pieces:
        was, t = heapq.heappop(heap)
        heapq.heappush(heap, (was + load, t))
        plan.load[t] = was + load
        if kind:
            plan.bins[what] = t
        else:
            plan.heavy.setdefault(what[0], []).append(t)
    return plan


def _bin(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n))


def plan_fragments(df: DataFrame, key: str, tasks: int | None = None) -> FragmentPlan:
    """Loads are exact row counts: one narrow scan of the key column with map-side partial aggregation, kept for both questions."""
    spark = df.sparkSession
    tasks = tasks or task_slots(spark)
    n_bins = SPREAD * tasks
    loads = df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n")).withColumn("b", _bin(F.col("k"), n_bins))
    loads = Spool(spark).write(loads)
    total = loads.agg(F.sum("n")).first()[0] or 0
    heavy = (F.col("n") > max(1, total // (SPLIT * tasks))).alias("h")
    top = loads.where(heavy).select("k", "n").collect()  # fewer than SPLIT * tasks rows, as their loads sum to at most total
    bins = loads.where(~heavy).groupBy("b").agg(F.sum("n").alias("n")).collect()  # at most SPREAD * tasks rows
    return pack([(r.k, r.n) for r in top], {r.b: r.n for r in bins}, tasks, n_bins)


def task_labels(spark: SparkSession, tasks: int) -> list[int]:
    """For each task an integer that hash partitioning into ``tasks`` partitions sends to a partition of its own."""
    n, found = tasks * 16, {}
    while len(found) < tasks:
        for r in spark.range(n).select(F.col("id").cast("int").alias("i"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(tasks)).alias("t")).collect():
            found.setdefault(r.t, r.i)
        n *= 4
    return [found[t] for t in range(tasks)]


def _placed(df: DataFrame, key: str, plan: FragmentPlan, labels: list[int]) -> DataFrame:
    """Adds _ts, the tasks of a heavy key's shards (null for a light key), and _light, the task of its bin."""
    spark = df.sparkSession
    schema = T.StructType([T.StructField("_hk", df.schema[key].dataType), T.StructField("_ts", T.ArrayType(T.IntegerType()))])
    heavy = spark.createDataFrame([(k, [labels[t] for t in ts]) for k, ts in plan.heavy.items()], schema)
    bins = spark.createDataFrame([(b, labels[t]) for b, t in enumerate(plan.bins)], "_b bigint, _light int")
    with_heavy = df.join(F.broadcast(heavy), df[key].eqNullSafe(heavy["_hk"]), "left")  # fewer than SPLIT * tasks rows
    return with_heavy.join(F.broadcast(bins), _bin(df[key], len(plan.bins)) == bins["_b"]).drop("_hk", "_b")  # SPREAD * tasks rows


def route(df: DataFrame, key: str, value: Column, plan: FragmentPlan, labels: list[int], out: str = "_task") -> DataFrame:
    """Adds the task label and moves each row there. Rows of one (key, value) share a task; a light key has one task."""
    shard = F.pmod(F.xxhash64(value), F.size("_ts")).cast("int")
    task = F.when(F.col("_ts").isNotNull(), F.get("_ts", shard)).otherwise(F.col("_light"))
    return _placed(df, key, plan, labels).withColumn(out, task).drop("_ts", "_light").repartition(plan.tasks, out)


def replicate(df: DataFrame, key: str, plan: FragmentPlan, labels: list[int], out: str = "_task") -> DataFrame:
    """The matching side: a row goes to each task that holds a fragment of its key."""
    tasks = F.coalesce(F.array_distinct("_ts"), F.array("_light"))
    return _placed(df, key, plan, labels).withColumn(out, F.explode(tasks)).drop("_ts", "_light").repartition(plan.tasks, out)


def profile_predicates(rdf: DataFrame, predicates: DataFrame, tasks: int | None = None) -> tuple[DataFrame, FragmentPlan]:
    """Rows, distinct subjects and distinct objects of each predicate, and rows against its declared kind of object.

    Repeated statements count as rows each time. Null subjects and null objects are no values; a null predicate is a key of its
    own, undeclared. Empty input gives no rows. Only the named columns are read, so extra columns do no harm.
    Result: p_lex, n_rows, n_subjects, n_objects, range_kind, n_off_range.
    """
    spark = rdf.sparkSession
    none = F.lit(None).cast("string")
    term = lambda side, k, lex, dt, lang: F.struct(F.lit(side).alias("side"), F.col(k).cast("int").alias("k"), F.col(lex).alias("lex"), dt.alias("dt"), lang.alias("lang"))
    sides = F.array(term(0, "s_k", "s_lex", none, none), term(1, "o_k", "o_lex", F.col("o_dt"), F.col("o_lang")))
    long = rdf.select("p_lex", F.explode(sides).alias("t")).select("p_lex", "t.*")
    # equal values combine before they move: a value that a third of all rows share is one row per map task
    values = long.groupBy("p_lex", "side", "k", "lex", "dt", "lang").agg(F.count(F.lit(1)).alias("n"))
    values = Spool(spark).write(values.select("p_lex", "side", "k", F.col("lex").isNotNull().alias("held"), F.xxhash64("k", "lex", "dt", "lang").alias("h"), "n"))
    plan = plan_fragments(values.select("p_lex"), "p_lex", tasks)  # what is planned is what moves
    labels = task_labels(spark, plan.tasks)
    plan.rows = values.where("side = 0").agg(F.sum("n")).first()[0] or 0
    fragments = route(values, "p_lex", F.struct("side", "h"), plan, labels)
    declared = predicates.select("p_lex", "range_kind").groupBy("p_lex").agg(F.min("range_kind").alias("range_kind"))
    matching = replicate(declared, "p_lex", plan, labels).withColumnRenamed("p_lex", "_p")
    joined = fragments.join(matching.hint("shuffle_hash"), (fragments["_task"] == matching["_task"]) & fragments["p_lex"].eqNullSafe(matching["_p"]), "left")
    off = (F.col("side") == 1) & F.col("held") & ((F.col("k") == 3) != (F.col("range_kind") == "literal"))
    shards = joined.groupBy(fragments["_task"], "p_lex").agg(
        F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("n_rows"),
        F.count(F.when((F.col("side") == 0) & F.col("held"), 1)).alias("n_subjects"),
        F.count(F.when((F.col("side") == 1) & F.col("held"), 1)).alias("n_objects"),
        F.min("range_kind").alias("range_kind"),
        F.sum(F.when(off, F.col("n")).otherwise(0)).alias("n_off_range"),
    )
    merged = shards.groupBy("p_lex").agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_subjects", "n_objects")], F.min("range_kind").alias("range_kind"), F.sum("n_off_range").alias("n_off_range"))
    return merged, plan


def heavy_predicates(rdf: DataFrame, predicates: DataFrame, share: float = 0.05) -> DataFrame:
    """Predicates with more than ``share`` of all rows, from the fragments' counts."""
    profile, plan = profile_predicates(rdf, predicates)
    return profile.where(F.col("n_rows") > share * plan.rows).select("p_lex")
