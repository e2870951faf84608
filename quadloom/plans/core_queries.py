"""Queries of the core's data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.operators import hierarchy, skew, wide
from quadloom.runtime import Spool, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_predicates(table(spark, d, "rdf"), table(spark, d, "predicates"))


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    return skew.profile_predicates(table(spark, d, "rdf"), table(spark, d, "predicates"))[0]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return wide.unclear_cells(table(spark, d, "rdf"), table(spark, d, "predicates"))


def p5_wide(spark: SparkSession, d: str) -> DataFrame:
    return wide.to_wide(table(spark, d, "rdf"), table(spark, d, "predicates"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.cycle_nodes(hierarchy.statement_links(table(spark, d, "rdf")))


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    links = hierarchy.statement_links(table(spark, d, "rdf"))
    peeled = hierarchy.peel(links, Spool(spark))
    paths = hierarchy.hierarchy(links, peeled=peeled)
    sizes = hierarchy.subtree_sizes(hierarchy.all_descendants(links, peeled=peeled)).withColumnRenamed("node_lex", "node")
    out = paths.join(sizes, "node", "left")
    return out.select(F.col("node").alias("node_lex"), F.col("parent").alias("parent_lex"), F.col("root").alias("root_lex"), F.col("depth").cast("bigint").alias("depth"), F.array_join("path", " > ").alias("path"), "state", F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    rows = hierarchy.all_descendants(hierarchy.statement_links(table(spark, d, "rdf")))
    return rows.withColumn("distance", F.col("distance").cast("bigint"))


_VALUE = """
cells AS (
  SELECT r.s_lex, r.p_lex, p.range_dt, trim(r.o_lex, E' \\t\\r\\n') AS v
  FROM rdf r JOIN predicates p ON r.p_lex = p.p_lex WHERE p.single_valued),
vals AS (
  SELECT s_lex, p_lex, range_dt, v, CASE
    WHEN range_dt = 'xsd:integer' AND regexp_full_match(v, '[+-]?[0-9]+') THEN CAST(CAST(v AS HUGEINT) AS VARCHAR)
    WHEN range_dt = 'xsd:decimal' AND regexp_full_match(v, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)') THEN CAST(CAST(v AS DECIMAL(38,10)) AS VARCHAR)
    WHEN range_dt = 'xsd:boolean' AND v IN ('true','1') THEN 'true'
    WHEN range_dt = 'xsd:boolean' AND v IN ('false','0') THEN 'false'
    WHEN range_dt = 'xsd:date' AND regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN CAST(TRY_CAST(v AS DATE) AS VARCHAR)
    WHEN range_dt = 'xsd:dateTime' AND regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})')
      THEN CAST(epoch_us(TRY_CAST(v AS TIMESTAMPTZ)) AS VARCHAR)
    WHEN range_dt = 'xsd:gYear' AND regexp_full_match(v, '[0-9]{4}') THEN CAST(CAST(v AS INTEGER) AS VARCHAR)
    WHEN range_dt = 'xsd:string' THEN v END AS c
  FROM cells)"""

_LINKS = """
links AS (
  SELECT DISTINCT child, parent FROM (
    SELECT s_lex AS child, o_lex AS parent FROM rdf WHERE p_lex IN ('skos:broader','urn:x:v/partOf','rdfs:subClassOf')
    UNION ALL SELECT o_lex, s_lex FROM rdf WHERE p_lex IN ('skos:narrower','urn:x:v/hasPart'))
  WHERE child IS NOT NULL AND parent IS NOT NULL)"""

_PATHS_SQL = """
WITH RECURSIVE """ + _LINKS.strip() + """,
nodes AS (SELECT child AS n FROM links UNION SELECT parent FROM links),
roots AS (SELECT n FROM nodes WHERE n NOT IN (SELECT child FROM links)),
up AS (SELECT child AS n, parent AS a FROM links UNION SELECT u.n, l.parent FROM up u JOIN links l ON u.a = l.child),
cyc AS (SELECT DISTINCT n FROM up WHERE n = a),
paths AS (SELECT n AS node, CAST(NULL AS VARCHAR) AS parent, [n] AS path FROM roots
  UNION ALL SELECT l.child, l.parent, list_append(p.path, l.child) FROM paths p JOIN links l ON l.parent = p.node
  WHERE l.child NOT IN (SELECT n FROM cyc)),
walks AS (SELECT parent AS n, child AS d, [child] AS way FROM links
  UNION ALL SELECT w.n, l.child, list_append(w.way, l.child) FROM walks w JOIN links l ON l.parent = w.d WHERE NOT list_contains(w.way, l.child)),
pairs AS (SELECT n, d, CAST(min(len(way)) AS BIGINT) AS distance FROM walks GROUP BY n, d),
sizes AS (SELECT n, count(*) AS k FROM pairs GROUP BY n)"""

_KINDS = ("xsd:integer", "xsd:decimal", "xsd:date", "xsd:boolean", "xsd:string")
_COLUMNS = [("pageCount", "xsd:integer"), ("height", "xsd:decimal"), ("issued", "xsd:date"), ("lastSeen", "xsd:dateTime"), ("onLoan", "xsd:boolean"), ("madeIn", "xsd:gYear"), ("shelfMark", "xsd:string"), ("price", "xsd:decimal"), ("copies", "xsd:integer"), ("checkedOn", "xsd:date")] + [(f"extra{i:02d}", _KINDS[i % 5]) for i in range(40)]
_SQL_CAST = {"xsd:integer": "CAST({} AS DECIMAL(38,0))", "xsd:decimal": "CAST({} AS DECIMAL(38,10))", "xsd:date": "CAST({} AS DATE)", "xsd:boolean": "CAST({} AS BOOLEAN)", "xsd:string": "{}", "xsd:gYear": "CAST({} AS BIGINT)", "xsd:dateTime": "make_timestamp(CAST({} AS BIGINT))"}


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_profile, p5_found, p5_wide, p6_found, p6_paths, p6_descendants)}


def oracle_sql() -> dict[str, str]:
    cell = lambda n: f"CASE WHEN count(DISTINCT c) FILTER (p_lex = 'urn:x:v/{n}') = 1 THEN min(c) FILTER (p_lex = 'urn:x:v/{n}') END"
    return {
        "p2_found": "SELECT p_lex FROM rdf GROUP BY p_lex HAVING count(*) > 0.05 * (SELECT count(*) FROM rdf)",
        "p2_profile": """SELECT r.p_lex, count(*) AS n_rows, count(DISTINCT s_k || '|' || s_lex) AS n_subjects,
            count(DISTINCT o_k || '|' || o_lex || '|' || coalesce('^' || o_dt, '') || '|' || coalesce('@' || o_lang, '')) AS n_objects, min(range_kind) AS range_kind,
            count(*) FILTER (o_lex IS NOT NULL AND (o_k = 3) <> (range_kind = 'literal')) AS n_off_range
            FROM rdf r LEFT JOIN predicates p ON r.p_lex = p.p_lex GROUP BY r.p_lex""",
        "p5_found": f"WITH {_VALUE.strip()} SELECT s_lex, p_lex FROM vals GROUP BY s_lex, p_lex HAVING count(DISTINCT c) <> 1",
        "p5_wide": f"WITH {_VALUE.strip()} SELECT s_lex, " + ", ".join(f"{_SQL_CAST[t].format(cell(n))} AS \"{n}\"" for n, t in _COLUMNS) + " FROM vals GROUP BY s_lex",
        "p6_found": f"WITH RECURSIVE {_LINKS.strip()}, up AS (SELECT child AS n, parent AS a FROM links UNION SELECT u.n, l.parent FROM up u JOIN links l ON u.a = l.child) SELECT DISTINCT n AS node_lex FROM up WHERE n = a",
        "p6_paths": _PATHS_SQL + """
            SELECT node AS node_lex, parent AS parent_lex, path[1] AS root_lex, CAST(len(path) - 1 AS BIGINT) AS depth, array_to_string(path, ' > ') AS path, 'tree' AS state, coalesce(k, 0) AS n_descendants
            FROM paths LEFT JOIN sizes ON n = node
            UNION ALL SELECT x.n, NULL, NULL, NULL, NULL, CASE WHEN x.n IN (SELECT n FROM cyc) THEN 'cycle' ELSE 'below_cycle' END, coalesce(k, 0) FROM nodes x LEFT JOIN sizes s ON x.n = s.n WHERE x.n NOT IN (SELECT node FROM paths)""",
        "p6_descendants": _PATHS_SQL + " SELECT n AS node_lex, d AS descendant_lex, distance FROM pairs",
    }
