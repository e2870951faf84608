"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadloom.llm import language, lookalikes, packing, pii, sketches, tokenize
from quadloom.runtime import Spool, table

TOKENIZERS = os.environ.get("QUADLOOM_TOKENIZERS", "/opt/tokenizers")
CAPACITY = 4096


def byte_bpe_50k() -> tokenize.Tokenizer:
    return tokenize.Tokenizer(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def _records(spark: SparkSession, d: str) -> DataFrame:
    """key (src_table, rec_id), label, text of both tables of literals."""
    lit, cell = table(spark, d, "literals"), table(spark, d, "table_query_result")
    one = lambda name, rid, label: [F.struct(F.lit(name).alias("src_table"), F.col(rid).alias("rec_id")).alias("key"), F.col(label).alias("label"), F.col("lex").alias("text")]
    return lit.select(*one("literals", "literal_id", "lang")).union(cell.select(*one("table_query_result", "cell_id", "xml_lang")))


def _p1_segments(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d)
    return language.segments(records, "key", "text", "label", language.fit_table(table(spark, d, "language_samples"), records))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return language.unnamed_languages(_p1_segments(spark, d)).select("key.src_table", "key.rec_id", "lang")


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    each = _p1_segments(spark, d).select("key.*", F.posexplode("segs").alias("seg_no", "s"))
    return each.select("src_table", "rec_id", "seg_no", "s.*")


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """Each record's main language, the one of most characters, with the mean confidence of its segments; null where there is none."""
    return language.main_language(_p1_segments(spark, d)).select("key.src_table", "key.rec_id", "lang", "confidence")


def p3_distinct(spark: SparkSession, d: str) -> DataFrame:
    return sketches.estimates(sketches.registers(table(spark, d, "rdf")))


def p3_late_merge(spark: SparkSession, d: str) -> DataFrame:
    """Registers of rows that arrived within a day, merged with those of the late ones, equal the registers of all rows."""
    rdf = table(spark, d, "rdf")
    late = F.coalesce(F.col("arrived_at") > F.col("added_at") + F.expr("INTERVAL 1 DAY"), F.lit(False))
    merged = sketches.merge(sketches.registers(rdf.where(~late)), sketches.registers(rdf.where(late)))
    sizes = merged.select("day", F.size("codes").alias("n"), F.expr(f"aggregate(codes, 0L, (n, x) -> n + (x & {sketches.RANKS - 1}))").alias("ranks"))
    return sizes.groupBy("day").agg(F.sum("n").alias("n_registers"), F.sum("ranks").alias("sum_ranks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.same_look_pairs(table(spark, d, "literals"))


def p4_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.canonical_texts(table(spark, d, "literals"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.look_classes(table(spark, d, "literals"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_table(table(spark, d, "documents"), "doc_id", "text", byte_bpe_50k())


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokenize.encode_table(table(spark, d, "documents"), "doc_id", "text", byte_bpe_50k(), counting=True)
    return packing.pack(Spool(spark).write(sizes), "doc_id", "n_tokens", CAPACITY)


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What any packing must hold, counted over all of p8_pack: every document whole and once, no overlap, nothing beyond the
    capacity, pieces full but the last; and that the space unused is below two containers."""
    rows = Spool(spark).write(p8_pack(spark, d))
    docs = rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("piece_no").alias("nos"), F.max("piece_no").alias("last"), F.sum("n_tokens").alias("total"),
        F.count(F.when(F.col("piece_start") != F.col("piece_no") * CAPACITY, 1)).alias("off"),
    )
    split = (F.col("n") != F.col("nos")) | (F.col("n") != F.col("last") + 1) | (F.col("off") > 0) | (F.col("n") != F.greatest(F.lit(1), F.ceil(F.col("total") / CAPACITY)))
    per_doc = docs.agg(F.count(F.lit(1)).alias("n_documents"), F.count(F.when(split, 1)).alias("badly_split"))
    filled = rows.where("n_tokens > 0")
    before = Window.partitionBy("container").orderBy("place")  # a container holds at most its capacity in pieces of a token or more
    overlap = filled.select(F.col("place") < F.lag(F.col("place") + F.col("n_tokens")).over(before), F.col("place") + F.col("n_tokens") > CAPACITY).toDF("overlaps", "beyond")
    places = overlap.agg(F.count(F.when(F.col("overlaps"), 1)).alias("overlapping"), F.count(F.when(F.col("beyond"), 1)).alias("beyond_capacity"))
    space = filled.agg(F.count_distinct("container").alias("c"), F.sum("n_tokens").alias("t")).select((F.coalesce(F.col("c") * CAPACITY - F.col("t"), F.lit(0)) < 2 * CAPACITY).alias("tight"))
    empty = rows.where("n_tokens = 0").agg(F.count_distinct("doc_id").alias("n_empty"))
    both = lambda a, b: a.unionByName(b, allowMissingColumns=True)
    each = both(both(per_doc, places), both(space, empty))  # one row each
    return each.agg(*[F.max(c).alias(c) for c in each.columns])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = pii.find(table(spark, d, "documents"), "doc_id", "text")
    return found.select(F.col("key").alias("doc_id"), F.explode("spans").alias("s")).select("doc_id", "s.*").distinct()


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "documents"), "doc_id", "text")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_segments, p1_records, p3_distinct, p3_late_merge, p4_found, p4_canonical, p4_classes, p7_ids, p8_pack, p8_invariants, p9_found, p9_redacted)}


_REGISTERS = """
ids AS (
  SELECT CAST(added_at AS DATE) AS day, g_iri, p_lex, 0 AS base, s_lex AS id FROM rdf WHERE s_lex IS NOT NULL
  UNION ALL SELECT CAST(added_at AS DATE), g_iri, p_lex, 4096, o_lex FROM rdf WHERE o_lex IS NOT NULL),
hashed AS (SELECT DISTINCT day, g_iri, p_lex, base, md5(id) AS h FROM ids),
bits AS (SELECT day, g_iri, p_lex, base + CAST('0x' || substr(h, 1, 3) AS INTEGER) AS slot, CAST('0x' || substr(h, 4, 13) AS BIGINT) AS w FROM hashed),
regs AS (SELECT day, g_iri, p_lex, slot, max(CASE WHEN w = 0 THEN 53 ELSE 53 - length(bin(w)) END) AS rank FROM bits GROUP BY ALL)"""

_ESTIMATE = "CASE WHEN {u} = 0 THEN 0 ELSE CAST(round(4096.0 * 4096.0 / (2 * ln(2)) / (coalesce({p}, 0) + 4096 * ({z} + " + " + ".join(f"pow({{z}}, {2.0 ** k!r}) * {2.0 ** (k - 1)!r}" for k in range(1, 23)) + "))) AS BIGINT) END"


def _side(test: str) -> str:
    used = f"count(*) FILTER (slot {test} 4096)"
    return _ESTIMATE.format(u=used, p=f"sum(pow(2.0, -rank)) FILTER (slot {test} 4096)", z=f"((4096.0 - {used}) / 4096.0)")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _looks_sql() -> str:
    """The classes of equal look in SQL: the same fixed tables, classes by composed form instead of collation."""
    one, many, gone = lookalikes._ONE | lookalikes._LETTERS, lookalikes._MANY, lookalikes._GONE.replace("\0", "")
    mapped = "lex"
    for c, plain in many.items():
        mapped = f"replace({mapped}, {_quoted(c)}, {_quoted(plain)})"
    one = {a: b for a, b in one.items() if a != "\0"}
    mapped = f"nfc_normalize(translate({mapped}, {_quoted(''.join(one) + gone)}, {_quoted(''.join(one.values()))}))"
    odd = f"length(lex) - length(translate(lex, {_quoted(''.join(lookalikes._ONE).replace(chr(0), '') + ''.join(many) + gone)}, ''))"
    mixed = r"\p{Latin}[\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}]\p{Latin}|\p{Cyrillic}\p{Greek}|\p{Greek}\p{Cyrillic}"
    odd += f" + len(regexp_extract_all(lex, '{mixed}')) + len(regexp_extract_all(lex, '\\p{{Mn}}'))"
    plain = r"regexp_full_match(lex, '[\x09\x0A\x0D\x20-\x7E]*')"
    return (
        f"WITH texts AS (SELECT lex, count(*) AS n_rows FROM literals WHERE lex IS NOT NULL GROUP BY lex), looks AS (SELECT lex, n_rows, CASE WHEN {plain} THEN lex ELSE {mapped} END AS look, CASE WHEN {plain} THEN 0 ELSE {odd} END AS odd FROM texts), "
        "best AS (SELECT look, arg_min(lex, (odd, lex)) AS canonical, count(*) AS n_writings, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM looks GROUP BY look) "
    )


def oracle_sql() -> dict[str, str]:
    parts = []
    for keys in (("day", "g_iri", "p_lex"), ("day", "g_iri"), ("day", "p_lex"), ("g_iri", "p_lex"), ("day",), ("g_iri",), ("p_lex",), ()):
        cells = ", ".join(k if k in keys else f"CAST(NULL AS {'DATE' if k == 'day' else 'VARCHAR'}) AS {k}" for k in ("day", "g_iri", "p_lex"))
        inner = f"SELECT {''.join(k + ', ' for k in keys)}slot, max(rank) AS rank FROM regs GROUP BY ALL"
        parts.append(f"SELECT '{'+'.join(keys) or 'all'}' AS grouping, {cells}, {_side('<')} AS n_subjects, {_side('>=')} AS n_objects, CAST(0.01625 AS DOUBLE) AS std_error FROM ({inner})" + (f" GROUP BY {', '.join(keys)}" if keys else ""))
    looks = _looks_sql()
    return {
        "p4_found": looks + "SELECT a.literal_id AS literal_id_a, b.literal_id AS literal_id_b FROM literals a JOIN looks x ON a.lex = x.lex JOIN looks y ON x.look = y.look AND x.lex <> y.lex JOIN literals b ON b.lex = y.lex WHERE a.literal_id < b.literal_id",
        "p4_canonical": looks + "SELECT literal_id, l.lex, canonical FROM literals l LEFT JOIN looks x ON l.lex = x.lex LEFT JOIN best b ON x.look = b.look",
        "p4_classes": looks + "SELECT canonical, n_writings, n_rows FROM best WHERE n_writings > 1",
        "p8_invariants": "SELECT count(*) AS n_documents, CAST(0 AS BIGINT) AS badly_split, CAST(0 AS BIGINT) AS overlapping, CAST(0 AS BIGINT) AS beyond_capacity, true AS tight, count(*) FILTER (coalesce(text, '') = '') AS n_empty FROM documents",
        "p3_distinct": f"WITH {_REGISTERS.strip()} " + " UNION ALL ".join(parts),
        "p3_late_merge": f"WITH {_REGISTERS.strip()} SELECT day, count(*) AS n_registers, CAST(sum(rank) AS BIGINT) AS sum_ranks FROM regs GROUP BY day",
    }
