"""Dataset statistics over a quad table (s TERM, p, o TERM, g)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadloom.plans.algebra import RDF, RDFS


def graphs(quads: DataFrame) -> DataFrame:
    """Q1: g, n_triples, the largest first."""
    return quads.groupBy("g").agg(F.count(F.lit(1)).alias("n_triples")).orderBy(F.desc("n_triples"), "g")


def graph_summary(quads: DataFrame, type_p: str = RDF + "type") -> DataFrame:
    """Q2: per graph the distinct predicates, subjects, blank nodes and types."""
    blank = F.when(F.col("s.k") == 2, F.col("s.lex"))
    kind = F.when(F.col("p") == type_p, F.col("o.lex"))
    return quads.groupBy("g").agg(F.count_distinct("p").alias("n_predicates"), F.count_distinct("s").alias("n_subjects"), F.count_distinct(blank).alias("n_blank"), F.count_distinct(kind).alias("n_types"))


def types(quads: DataFrame, type_p: str = RDF + "type", resource: str = RDFS + "Resource") -> DataFrame:
    """Q3: type, n_instances; untyped subjects count under rdfs:Resource."""
    kind = quads.where(F.col("p") == type_p).select("s", F.col("o.lex").alias("type")).distinct()
    return quads.select("s").distinct().join(kind, "s", "left").groupBy(F.coalesce("type", F.lit(resource)).alias("type")).agg(F.count(F.lit(1)).alias("n_instances"))


def instances(quads: DataFrame, cls: str, type_p: str = RDF + "type", kind: int | None = None) -> DataFrame:
    """Q4: instances of a class (any, 1 named, 2 blank) with the number of their distinct properties."""
    of = quads.where((F.col("p") == type_p) & (F.col("o.lex") == cls)).select("s").distinct()
    of = of.where(F.col("s.k") == kind) if kind else of
    return quads.join(of, "s", "left_semi").groupBy(F.col("s.lex").alias("instance")).agg(F.count_distinct("p").alias("n_properties"))


def predicates(quads: DataFrame, type_p: str = RDF + "type") -> DataFrame:
    """Q5: per predicate the distinct triples, subjects, objects, and types of these (domains, ranges)."""
    triples = quads.select("s", "p", "o").distinct()
    kind = triples.where(F.col("p") == type_p).select(F.col("s").alias("n"), F.col("o.lex").alias("c"))
    base = triples.groupBy("p").agg(F.count(F.lit(1)).alias("n_triples"), F.count_distinct("s").alias("n_subjects"), F.count_distinct("o").alias("n_objects"))
    dom = triples.select("p", F.col("s").alias("n")).distinct().join(kind, "n").groupBy("p").agg(F.count_distinct("c").alias("n_domains"))
    rng = triples.where("o.k < 3").select("p", F.col("o").alias("n")).distinct().join(kind, "n").groupBy("p").agg(F.count_distinct("c").alias("n_ranges"))
    return base.join(dom, "p", "left").join(rng, "p", "left").fillna(0, ["n_domains", "n_ranges"])


def frequencies(quads: DataFrame, predicate: str, side: str = "o", type_p: str = RDF + "type", by_label: list[str] | None = None) -> DataFrame:
    """Q6: values of one side of a predicate by frequency, over distinct triples. side: 's', 'o', 'domain' or 'range' (the types of
    subjects and of objects). ``by_label``: label properties; then the values are in the order of their labels, column ``label``."""
    rows = quads.where(F.col("p") == predicate).select("s", "p", "o").distinct()
    if side in ("domain", "range"):
        kind = quads.where(F.col("p") == type_p).select(F.col("s").alias("n"), F.col("o").alias("value")).distinct()
        end = "s" if side == "domain" else "o"
        values = rows.join(kind, rows[end] == kind["n"]).select("value")
    else:
        values = rows.select(F.col(side).alias("value"))
    counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    if by_label is None:
        return counts.select("value.lex", "n").toDF("value", "n").orderBy(F.desc("n"), "value")
    return sorted_by_label(counts, "value", quads, by_label).select(F.col("value.lex").alias("value"), "label", "n")


def sorted_by_label(rows: DataFrame, column: str, quads: DataFrame, label_properties: list[str], language: str = "") -> DataFrame:
    """O10: rows in the order of the labels of a column of terms, in any case; adds ``label``. Ties keep the order of their names."""
    from quadloom.operators.graphlib import labels

    triples = quads.select("s", "p", "o").distinct()
    named = labels(triples, rows.select(F.col(column).alias("n")), language, label_properties)
    out = rows.join(named, rows[column] == named["n"], "left").drop("n") if "n" not in rows.columns else rows.join(named.withColumnRenamed("n", "_n"), rows[column] == F.col("_n"), "left").drop("_n")
    return out.orderBy(F.lower("label"), F.col("label"), F.col(f"{column}.lex"))


def concepts_of(quads: DataFrame, text: str, label_properties: list[str]) -> DataFrame:
    """Q7: resources that have a text as label."""
    return quads.where(F.col("p").isin(label_properties) & (F.col("o.k") == 3) & (F.lower("o.lex") == text.lower())).select(F.col("s.lex").alias("concept")).distinct()


def description(quads: DataFrame, subject: str, first: list[str] | None = None) -> DataFrame:
    """Q8: p and its distinct objects for a resource; the predicates of ``first`` lead."""
    order = {p: i for i, p in enumerate(first or [])}
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("p")), F.lit(len(order))) if order else F.lit(0)
    rows = quads.where(F.col("s.lex") == subject).groupBy("p").agg(F.sort_array(F.collect_set("o.lex")).alias("objects"))
    return rows.orderBy(rank, "p")


def list_triples(quads: DataFrame, predicate: str | None = None, graph: str | None = None, domain: str | None = None, range_: str | None = None, type_p: str = RDF + "type") -> DataFrame:
    """Q9: distinct triples by predicate, graph, and types of subject and object."""
    rows = quads
    if predicate:
        rows = rows.where(F.col("p") == predicate)
    if graph:
        rows = rows.where(F.col("g") == graph)
    kind = quads.where(F.col("p") == type_p)
    if domain:
        rows = rows.join(kind.where(F.col("o.lex") == domain).select("s").distinct(), "s", "left_semi")
    if range_:
        rows = rows.join(kind.where(F.col("o.lex") == range_).select(F.col("s").alias("o")).distinct(), "o", "left_semi")
    return rows.select("s", "p", "o").distinct()


def triples_with_object(quads: DataFrame, lex: str, literal: bool = False, by_label: list[str] | None = None) -> DataFrame:
    """Q10: triples with a resource or a literal of any tag as object, by subject or, with ``by_label``, by the subject's label."""
    rows = quads.where((F.col("o.lex") == lex) & ((F.col("o.k") == 3) if literal else (F.col("o.k") < 3))).select("s", "p", "o").distinct()
    return rows.orderBy("s.lex", "p") if by_label is None else sorted_by_label(rows, "s", quads, by_label)


def namespaces(quads: DataFrame) -> DataFrame:
    """Q11: namespaces of predicates in use, with their number of rows."""
    return quads.groupBy(F.regexp_extract("p", r"^(.*[/#:])", 1).alias("namespace")).agg(F.count(F.lit(1)).alias("n"))


def void(quads: DataFrame) -> DataFrame:
    """A dataset description: per graph the number of triples, distinct subjects, predicates and objects."""
    return quads.groupBy("g").agg(F.count(F.lit(1)).alias("triples"), F.count_distinct("s").alias("distinctSubjects"), F.count_distinct("p").alias("properties"), F.count_distinct("o").alias("distinctObjects"))


def branching(quads: DataFrame) -> DataFrame:
    """Mean objects per subject and subjects per object of each predicate, for estimates of joins."""
    p = quads.select("s", "p", "o").distinct().groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("ns"), F.count_distinct("o").alias("no"))
    return p.select("p", (F.col("n") / F.col("ns")).alias("objects_per_subject"), (F.col("n") / F.col("no")).alias("subjects_per_object"))


# solutions as sets
def proof_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def answer_count(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct solutions, counted up to a limit."""
    rows = df.distinct()
    return (rows.limit(limit) if limit is not None else rows).agg(F.count(F.lit(1)).alias("n"))


def answer_pairs(df: DataFrame, key: str, value: str, keys: int, values: int) -> DataFrame:
    """At most ``keys`` keys, the first in order, with at most ``values`` values each."""
    rows = df.select(key, value).distinct()
    few = rows.select(key).distinct().orderBy(key).limit(keys)
    ranked = rows.join(few, key, "left_semi").withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(value)))
    return ranked.where(F.col("_r") <= values).drop("_r")


def unique_solution(df: DataFrame) -> DataFrame:
    """The only distinct solution; none if there are several."""
    two = df.distinct().limit(2)  # so the window holds two rows at most
    return two.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))).where("_n = 1").drop("_n")


def head_and_tail(df: DataFrame, order: str, top: int, bottom: int) -> DataFrame:
    """The first and the last rows in an order, for long listings; all of a listing that is no longer than both. Rows that tie in
    the order are placed by their other columns; rows alike in all of them count one by one."""
    others = [c for c in df.columns if c != order]
    first = df.orderBy(order, *others).limit(top)
    rest = df.exceptAll(first)
    last = rest.orderBy(*[F.desc(c) for c in (order, *others)]).limit(bottom)
    return first.withColumn("part", F.lit("top")).union(last.withColumn("part", F.lit("bottom")))
