"""Results and graphs to files, all in parallel: rows become text in the executors, and a format that is a document becomes a folder
of documents, each valid by itself; their names keep the order of the rows. ``json_results`` and ``xml_results`` stream one
document through the driver, for answers over a connection."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom import terms as t
from quadloom.plans.algebra import RDF
from quadloom.runtime import ship

WRITERS: dict[str, Callable] = {}


def writer(*names: str):
    def put(f):
        for n in names:
            WRITERS[n] = f
        return f

    return put


def write(df: DataFrame, path: str, fmt: str) -> None:
    """By format name or media type."""
    if fmt not in WRITERS:
        raise ValueError(f"no writer for {fmt!r}; there are {', '.join(sorted(WRITERS))}")
    WRITERS[fmt](df, path)


def _quote(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), c, F.lit('"'))


def ntriples_term(c: Column) -> Column:
    lit = F.concat(_quote(c["lex"]), F.when(c["lang"] != "", F.concat(F.lit("@"), c["lang"])).when(c["dt"] != "", F.concat(F.lit("^^<"), c["dt"], F.lit(">"))).otherwise(""))
    return F.when(c["k"] == 1, F.concat(F.lit("<"), c["lex"], F.lit(">"))).when(c["k"] == 2, F.when(c["lex"].startswith("_:"), c["lex"]).otherwise(F.concat(F.lit("_:"), c["lex"]))).otherwise(lit)


def ntriples_lines(triples: DataFrame) -> DataFrame:
    return triples.select(F.concat_ws(" ", ntriples_term(F.col("s")), F.concat(F.lit("<"), F.col("p"), F.lit(">")), ntriples_term(F.col("o")), F.lit(".")).alias("value"))


@writer("ntriples", "turtle", "application/n-triples", "text/turtle")
def write_ntriples(triples: DataFrame, path: str) -> None:
    """A folder of N-Triples files, which are Turtle too."""
    ntriples_lines(triples).write.text(path)


@writer("turtle-canonical")
def write_canonical(triples: DataFrame, path: str) -> None:
    """Distinct lines in order: equal graphs without blank nodes give equal files."""
    ntriples_lines(triples).distinct().orderBy("value").write.text(path)


@writer("csv", "text/csv")
def write_csv(df: DataFrame, path: str) -> None:
    df.select(*[_plain(df, c) for c in df.columns]).write.csv(path, header=True, escape='"')


@writer("tsv", "text/tab-separated-values")
def write_tsv(df: DataFrame, path: str) -> None:
    kinds = dict(df.dtypes)
    cols = [(ntriples_term(F.col(f"`{c}`")) if kinds[c].startswith("struct") else F.col(f"`{c}`").cast("string")).alias(f"?{c}") for c in df.columns]
    df.select(*cols).write.csv(path, header=True, sep="\t", quote="", escape="")


def _plain(df: DataFrame, c: str) -> Column:
    return (F.col(f"`{c}`.lex") if dict(df.dtypes)[c].startswith("struct") else F.col(f"`{c}`").cast("string")).alias(c)


def _terms(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)

    def cell(c: str) -> Column:
        x = F.col(f"`{c}`")
        if kinds[c].startswith("struct"):
            return x.alias(c)
        kind = "num" if kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal") else {"boolean": "bool", "timestamp_ntz": "ts", "timestamp": "ts"}.get(kinds[c], "str")
        dt = {"bigint": "integer", "int": "integer", "smallint": "integer", "tinyint": "integer", "double": "double", "float": "double"}.get(kinds[c], "decimal")
        return t.as_term(t.Val(kind, x.cast("timestamp_ntz") if kind == "ts" else x, dt=dt)).alias(c)

    return df.select(*[cell(c) for c in df.columns])


def _open(df: DataFrame, path: str, parts: Iterator[str]) -> None:
    """Writes text through the Hadoop file system, piece by piece."""
    jvm = df.sparkSession.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        buffer: list[str] = []
        size = 0
        for x in parts:
            buffer.append(x)
            size += len(x)
            if size > 1 << 20:
                out.write(bytearray("".join(buffer).encode()))
                buffer, size = [], 0
        out.write(bytearray("".join(buffer).encode()))
    finally:
        out.close()


def _documents(lines: DataFrame, path: str, head: str, foot: str, between: str = "") -> None:
    """A folder of documents, one a partition: the head, the lines (column value), the foot."""

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        rows = lambda xs: pa.RecordBatch.from_arrays([pa.array(xs, pa.string())], names=["value"])
        yield rows([head])
        for batch in batches:
            xs = batch.column(0).to_pylist()
            if xs and between:
                xs = [x if first and not i else between + x for i, x in enumerate(xs)]
            first = first and not xs
            yield rows(xs)
        yield rows([foot])

    ship(lines.sparkSession)
    lines.select("value").mapInArrow(wrap, "value string").write.text(path)


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _blank(c: Column) -> Column:
    return F.regexp_replace(c, "^_:", "")


@writer("json", "application/sparql-results+json")
def write_json(df: DataFrame, path: str) -> None:
    if df.columns == ["answer"]:
        return _open(df, path, json_results(df))
    kind = lambda x: F.when(x["k"] == 1, "uri").when(x["k"] == 2, "bnode").otherwise("literal")
    cells = []
    for c in df.columns:
        x = F.col(f"`{c}`")
        lang = F.when((x["k"] == 3) & (x["lang"] != ""), x["lang"])
        cell = F.struct(kind(x).alias("type"), F.when(x["k"] == 2, _blank(x["lex"])).otherwise(x["lex"]).alias("value"), lang.alias("xml:lang"), F.when(lang.isNull() & (x["k"] == 3) & (x["dt"] != ""), x["dt"]).alias("datatype"))
        cells.append(F.when(x.isNotNull(), cell).alias(c))
    lines = _terms(df).select(F.to_json(F.struct(*cells), {"ignoreNullFields": "true"}).alias("value"))
    _documents(lines, path, '{"head":' + json.dumps({"vars": df.columns}) + ',"results":{"bindings":[', "]}}", ",")


def json_results(df: DataFrame) -> Iterator[str]:
    """SPARQL results in JSON: unbound variables are left out, blank nodes numbered. A table of one boolean ``answer`` is an ASK."""
    if df.columns == ["answer"]:
        yield json.dumps({"head": {}, "boolean": bool(df.first()[0])})
        return
    yield '{"head":' + json.dumps({"vars": df.columns}) + ',"results":{"bindings":['
    numbers: dict[str, str] = {}
    for i, r in enumerate(_terms(df).toLocalIterator(prefetchPartitions=True)):
        row = {}
        for n, x in zip(df.columns, r):
            if x is not None:
                v = {"type": {1: "uri", 2: "bnode"}.get(x.k, "literal"), "value": numbers.setdefault(x.lex, f"b{len(numbers)}") if x.k == 2 else x.lex}
                if x.k == 3 and x.lang:
                    v["xml:lang"] = x.lang
                elif x.k == 3 and x.dt:
                    v["datatype"] = x.dt
                row[n] = v
        yield ("," if i else "") + json.dumps(row, ensure_ascii=False)
    yield "]}}"


def _xml_literal(x: Column) -> Column:
    tag = F.when(x["lang"] != "", F.concat(F.lit(' xml:lang="'), _xml(x["lang"]), F.lit('"'))).when(x["dt"] != "", F.concat(F.lit(' datatype="'), _xml(x["dt"]), F.lit('"'))).otherwise("")
    return F.concat(F.lit("<literal"), tag, F.lit(">"), _xml(x["lex"]), F.lit("</literal>"))


def _around(a: str, c: Column, b: str) -> Column:
    return F.concat(F.lit(a), c, F.lit(b))


@writer("xml", "application/sparql-results+xml")
def write_xml(df: DataFrame, path: str) -> None:
    if df.columns == ["answer"]:
        return _open(df, path, xml_results(df))
    cells = []
    for c in df.columns:
        x = F.col(f"`{c}`")
        body = F.when(x["k"] == 1, _around("<uri>", _xml(x["lex"]), "</uri>")).when(x["k"] == 2, _around("<bnode>", _xml(_blank(x["lex"])), "</bnode>")).otherwise(_xml_literal(x))
        cells.append(F.when(x.isNull(), "").otherwise(_around(f"<binding name={quoteattr(c)}>", body, "</binding>")))
    head = '<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#">\n<head>' + "".join(f"<variable name={quoteattr(c)}/>" for c in df.columns) + "</head>\n<results>"
    _documents(_terms(df).select(_around("<result>", F.concat(*cells), "</result>").alias("value")), path, head, "</results>\n</sparql>")


def xml_results(df: DataFrame, ordered: bool = False, distinct: bool = False) -> Iterator[str]:
    yield '<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#">\n'
    if df.columns == ["answer"]:
        yield f"<head/>\n<boolean>{str(bool(df.first()[0])).lower()}</boolean>\n</sparql>\n"
        return
    yield "<head>" + "".join(f"<variable name={quoteattr(c)}/>" for c in df.columns) + "</head>\n"
    yield f'<results ordered="{str(ordered).lower()}" distinct="{str(distinct).lower()}">\n'
    numbers: dict[str, str] = {}
    for r in _terms(df).toLocalIterator(prefetchPartitions=True):
        cells = []
        for n, x in zip(df.columns, r):
            if x is None:
                continue
            if x.k == 1:
                body = f"<uri>{escape(x.lex)}</uri>"
            elif x.k == 2:
                body = f"<bnode>{numbers.setdefault(x.lex, f'b{len(numbers)}')}</bnode>"
            else:
                tag = f" xml:lang={quoteattr(x.lang)}" if x.lang else f" datatype={quoteattr(x.dt)}" if x.dt else ""
                body = f"<literal{tag}>{escape(x.lex)}</literal>"
            cells.append(f"<binding name={quoteattr(n)}>{body}</binding>")
        yield f"<result>{''.join(cells)}</result>\n"
    yield "</results>\n</sparql>\n"


@writer("table-xml")
def write_table_xml(df: DataFrame, path: str) -> None:
    """The XML table of path-expression queries: <null/> for unbound."""
    cells = []
    for c in df.columns:
        x = F.col(f"`{c}`")
        cells.append(F.when(x.isNull(), "<null/>").when(x["k"] == 1, _around("<uri>", _xml(x["lex"]), "</uri>")).when(x["k"] == 2, _around("<bNode>", _xml(x["lex"]), "</bNode>")).otherwise(_xml_literal(x)))
    head = '<?xml version="1.0"?>\n<tableQueryResult>\n<header>' + "".join(f"<columnName>{escape(c)}</columnName>" for c in df.columns) + "</header>"
    _documents(_terms(df).select(_around("<tuple>", F.concat(*cells), "</tuple>").alias("value")), path, head, "</tableQueryResult>")


@writer("rdfxml", "application/rdf+xml")
def write_rdfxml(triples: DataFrame, path: str) -> None:
    o, node = F.col("o"), lambda c: F.regexp_replace(_blank(c), r"[^\p{L}\p{N}]", "_")
    space, name = F.regexp_extract("p", r"^(.*[#/:])?(.*)$", 1), F.regexp_extract("p", r"^(.*[#/:])?(.*)$", 2)
    about = F.when(F.col("s.k") == 2, _around('rdf:nodeID="', node(F.col("s.lex")), '"')).otherwise(_around('rdf:about="', _xml(F.col("s.lex")), '"'))
    tag = F.when(o["lang"] != "", _around(' xml:lang="', _xml(o["lang"]), '"')).when(o["dt"] != "", _around(' rdf:datatype="', _xml(o["dt"]), '"')).otherwise("")
    body = F.when(o["k"] == 1, _around(' rdf:resource="', _xml(o["lex"]), '"/>')).when(o["k"] == 2, _around(' rdf:nodeID="', node(o["lex"]), '"/>')).otherwise(F.concat(tag, F.lit(">"), _xml(o["lex"]), F.lit("</n:"), name, F.lit(">")))
    line = F.concat(F.lit("<rdf:Description "), about, F.lit("><n:"), name, F.lit(' xmlns:n="'), _xml(space), F.lit('"'), body, F.lit("</rdf:Description>"))
    _documents(triples.select(line.alias("value")), path, f'<?xml version="1.0"?>\n<rdf:RDF xmlns:rdf="{RDF}">', "</rdf:RDF>")


def rdf_json(triples: DataFrame) -> DataFrame:
    """subject, json: RDF/JSON by subject; an object per line rather than one document, so that it is written in parallel."""
    value = F.struct(
        F.when(F.col("o.k") == 1, "uri").when(F.col("o.k") == 2, "bnode").otherwise("literal").alias("type"), F.col("o.lex").alias("value"), F.when(F.col("o.lang") != "", F.col("o.lang")).alias("lang"), F.when(F.col("o.dt") != "", F.col("o.dt")).alias("datatype")
    )
    by_p = triples.groupBy(F.col("s.lex").alias("subject"), "p").agg(F.sort_array(F.collect_list(value)).alias("v"))
    by_s = by_p.groupBy("subject").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("p", "v")))).alias("m"))
    return by_s.select("subject", F.to_json("m").alias("json"))


@writer("rdfjson", "application/rdf+json")
def write_rdf_json(triples: DataFrame, path: str) -> None:
    rdf_json(triples).select(F.concat(F.lit("{"), F.to_json(F.struct(F.col("subject").alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("subject").alias("x")))) - 6), F.lit(":"), F.col("json"), F.lit("}")).alias("value")).write.text(path)


@writer("dot")
def write_dot(triples: DataFrame, path: str) -> None:
    """GraphViz text with shortened labels, a bag (rdf:Bag) as a box of its members; a folder of graphs, one a partition."""
    from quadloom.operators.graphlib import truncate

    short = lambda c: _quote(truncate(c, 40))
    bag = F.col("o.lex").isin("rdf:Bag", RDF + "Bag")
    edge = F.concat(F.lit("  "), short(F.col("s.lex")), F.lit(" -> "), short(F.col("o.lex")), F.lit(" [label="), short(F.regexp_extract("p", r"([^/#:]*)$", 1)), F.lit("];"))
    _documents(triples.select(F.when(bag, F.concat(F.lit("  "), short(F.col("s.lex")), F.lit(" [shape=box];"))).otherwise(edge).alias("value")), path, "digraph G {", "}")
