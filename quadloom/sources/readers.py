"""Files to quad tables and result sets to tables. N-Triples and N-Quads are split by lines; documents are parsed one per task."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import posixpath
import re
import tarfile
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import terms as t
from quadloom.runtime import ship
from quadloom.sources.graphs import QUADS, QuadGraph
from quadloom.sources.turtle import parse_rdfxml, parse_turtle

FORMATS = {".nt": "ntriples", ".ntriples": "ntriples", ".nq": "nquads", ".ttl": "turtle", ".n3": "turtle", ".rdf": "rdfxml", ".rdfs": "rdfxml", ".owl": "rdfxml", ".xml": "rdfxml"}
# Endings and whole names of archive members that hold no data.
NO_DATA_ENDINGS = (".pdf", ".txt", ".md", ".doc")
NO_DATA_NAMES = ("readme", "todo")


def holds_data(member: str) -> bool:
    name = posixpath.basename(member).lower()
    stem, ending = posixpath.splitext(name)
    return ending not in NO_DATA_ENDINGS and stem not in NO_DATA_NAMES

_TERM = r'(?:<[^>]*>|_:\S+?|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)'
LINE = rf"^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+({_TERM})\s*(?:(<[^>]*>|_:\S+)\s*)?\.\s*(?:#.*)?$"


def sniff(name: str, head: str = "") -> str:
    """By XML namespaces in the head of the text, else by the name's ending, else Turtle."""
    if "http://www.w3.org/1999/02/22-rdf-syntax-ns#" in head and re.search(r"<\?xml|<\w*:?RDF|xmlns", head):
        return "rdfxml"
    base = re.sub(r"\.(gz|bz2)$", "", name.lower())
    return FORMATS.get(posixpath.splitext(base)[1], "turtle")


def _points(texts: pd.Series) -> pd.Series:
    return texts.str.replace(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})", lambda m: chr(int(m.group(1) or m.group(2), 16)), regex=True)


def unescape(c: Column) -> Column:
    r"""String escapes of N-Triples: backslash sequences by replacement, code points by a function only where there are any."""
    mark = "\u0001"
    plain = c
    plain = F.replace(plain, F.lit("\\\\"), F.lit(mark))
    for a, b in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\\b", "\b"), ("\\f", "\f"), ('\\"', '"'), ("\\'", "'")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    points = F.pandas_udf(_points, "string")
    plain = F.when(plain.rlike(r"\\[uU]"), points(plain)).otherwise(plain)
    return F.when(c.contains("\\"), F.replace(plain, F.lit(mark), F.lit("\\"))).otherwise(c)


def term(field: Column) -> Column:
    """A field of a line as TERM."""
    lex = unescape(F.regexp_extract(field, r'^"((?:[^"\\]|\\.)*)"', 1))
    lang = F.regexp_extract(field, r'"@([A-Za-z0-9-]+)$', 1)
    dt = F.regexp_extract(field, r'"\^\^<([^>]*)>$', 1)
    dt = F.when(dt.isin(t.STRINGS), "").otherwise(dt)
    iri = unescape(F.regexp_extract(field, r"^<([^>]*)>", 1))
    return F.when(field.startswith("<"), t.struct(1, iri)).when(field.startswith("_:"), t.struct(2, field)).otherwise(t.struct(3, lex, dt, lang))


def lines_to_quads(lines: DataFrame, graph: str | None) -> DataFrame:
    """Lines (column value) of N-Triples or N-Quads. A line that is neither a statement, a comment nor blank is an error."""
    ship(lines.sparkSession)
    rows = lines.where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    good = F.when(F.col("value").rlike(LINE), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no statement: "), F.substring("value", 1, 200))))
    parts = rows.select(*[F.regexp_extract(good, LINE, k).alias(f"f{k}") for k in range(1, 5)])
    g = F.when(F.col("f4") == "", F.lit(graph)).otherwise(F.regexp_extract("f4", r"^<?([^>]*)>?$", 1))
    return parts.select(term(F.col("f1")).alias("s"), unescape(F.col("f2")).alias("p"), term(F.col("f3")).alias("o"), g.alias("g"), F.lit(None).cast("bigint").alias("g_line"))


def _members(path: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    """The documents of a file: itself, unpacked, or the members of an archive."""
    low = path.lower()
    if low.endswith((".tar", ".tgz", ".tar.gz", ".tar.bz2")):
        with tarfile.open(fileobj=io.BytesIO(data)) as tar:
            for m in tar:
                if m.isfile() and holds_data(m.name):
                    yield from _members(f"{path}/{m.name}", tar.extractfile(m).read())
    elif low.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for name in z.namelist():
                if not name.endswith("/") and holds_data(name):
                    yield from _members(f"{path}/{name}", z.read(name))
    elif low.endswith(".gz"):
        yield path[:-3], gzip.decompress(data)
    elif low.endswith(".bz2"):
        yield path[:-4], bz2.decompress(data)
    else:
        yield path, data


def parse_document(path: str, data: bytes, fmt: str | None, base: str = "") -> list[tuple]:
    """(s, p, o) of one document; blank nodes are named after it."""
    import hashlib

    text = data.decode("utf-8", "replace")
    fmt = fmt or sniff(path, text[:4000])
    blank = hashlib.sha1(path.encode()).hexdigest()[:8] + "_"
    if fmt == "rdfxml":
        return parse_rdfxml(data, base, blank)
    return parse_turtle(text, base, blank)  # N-Triples is a part of Turtle


def load(spark: SparkSession, path: str, fmt: str | None = None, graph: str | None = "user", base: str = "") -> QuadGraph:
    """Loads files (a path or glob). N-Triples and N-Quads split by lines, plain or gzipped; Turtle, RDF/XML and archives by file."""
    ship(spark)
    kind = fmt or sniff(path)
    if kind in ("ntriples", "nquads") and not re.search(r"\.(zip|tar|tgz|tar\.gz)$", path.lower()):
        return QuadGraph(lines_to_quads(spark.read.text(path), graph))
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell = lambda x: dict(zip(("k", "lex", "dt", "lang"), x))
        for batch in batches:
            for p, data in zip(batch["path"], batch["content"]):
                for name, body in _members(p, bytes(data)):
                    rows = parse_document(name, body, fmt, base)
                    for lo in range(0, len(rows), 50_000):
                        part = rows[lo : lo + 50_000]
                        yield pd.DataFrame({"s": [cell(r[0]) for r in part], "p": [r[1] for r in part], "o": [cell(r[2]) for r in part], "g": graph, "g_line": pd.Series([None] * len(part), dtype="Int64")})

    return QuadGraph(files.mapInPandas(run, QUADS))


class Library:
    """Named graphs to load, each with what it imports: name -> (path, format, names of imports)."""

    def __init__(self, entries: dict[str, tuple[str, str | None, list[str]]]) -> None:
        self.entries = entries

    def names(self) -> list[str]:
        return sorted(self.entries)

    def load(self, spark: SparkSession, name: str) -> QuadGraph:
        seen, work, out = set(), [name], None
        while work:
            n = work.pop()
            if n in seen:
                continue
            seen.add(n)
            path, fmt, imports = self.entries[n]
            quads = load(spark, path, fmt, graph=n).quads
            out = quads if out is None else out.union(quads)
            work += imports
        return QuadGraph(out)


# result sets
def read_results(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """SELECT results of a file or a folder of files, all with the same variables; JSON and XML documents one per task. TERM structs
    but for CSV, which has strings."""
    kind = fmt or {"csv": "csv", "tsv": "tsv", "srj": "json", "json": "json", "srx": "xml", "xml": "xml"}[path.rsplit(".", 1)[-1].lower()]
    if kind == "csv":
        return spark.read.csv(path, header=True, multiLine=True, escape='"')
    if kind == "tsv":
        df = spark.read.csv(path, header=True, sep="\t", quote="")
        return df.select(*[F.when(F.length(F.col(f"`{c}`")) > 0, _tsv(F.col(f"`{c}`"))).alias(c.lstrip("?")) for c in df.columns])
    files = ship(spark).read.format("binaryFile").load(path)
    names = _variables(files, kind)
    parse = {"json": _json_results, "xml": _xml_results, "table-xml": table_results}[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                own, rows = parse(bytes(data).decode("utf-8"))
                at = {n: i for i, n in enumerate(own)}
                for lo in range(0, len(rows), 20_000):
                    part = rows[lo : lo + 20_000]
                    cell = lambda x: None if x is None else dict(zip(("k", "lex", "dt", "lang"), x))
                    yield pd.DataFrame({n: [cell(r[at[n]]) if n in at else None for r in part] for n in names}, dtype=object)

    return files.select("content").mapInPandas(run, ", ".join(f"`{n}` {t.TERM}" for n in names))


def _variables(files: DataFrame, kind: str) -> list[str]:
    """From the head of one document; only its beginning reaches the driver."""
    for size in (1 << 16, 1 << 26):
        head = bytes(files.select(F.substring("content", 1, size).alias("c")).first().c).decode("utf-8", "ignore")
        if kind == "json" and (m := re.search(r'"vars"\s*:\s*(\[[^\]]*\])', head)):
            return json.loads(m.group(1))
        if kind == "table-xml" and (got := re.findall(r"<columnName>([^<]*)</columnName>", head)):
            return got
        if kind == "xml" and (got := re.findall(r"<(?:\w+:)?variable\s+name=[\"']([^\"']*)", head)):
            return got
    raise ValueError("no head of results")


def _tsv(c: Column) -> Column:
    number = F.when(c.rlike(r"^[+-]?\d+$"), t.struct(3, c, t.XSD + "integer")).when(c.rlike(r"^[+-]?\d*\.\d+$"), t.struct(3, c, t.XSD + "decimal")).when(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)[eE][+-]?\d+$"), t.struct(3, c, t.XSD + "double"))
    return F.when(c.rlike(r'^(<|_:|")'), term(c)).otherwise(number)


def _json_results(text: str) -> tuple[list[str], list[tuple]]:
    doc = json.loads(text)
    names = doc["head"].get("vars", [])

    def cell(x):
        if x is None:
            return None
        k = {"uri": 1, "bnode": 2}.get(x["type"], 3)
        lex = x["value"] if k != 2 or x["value"].startswith("_:") else f"_:{x['value']}"
        return (k, lex, "" if x.get("datatype", "") in t.STRINGS else x.get("datatype", ""), x.get("xml:lang", ""))

    return names, [tuple(cell(b.get(n)) for n in names) for b in doc["results"]["bindings"]]


def table_results(text: str) -> tuple[list[str], list[tuple]]:
    """The XML table of path-expression queries: names and rows of terms."""
    root = ET.fromstring(text)
    rows = []
    for r in root.iter("tuple"):
        cells = []
        for x in r:
            k = {"uri": 1, "bNode": 2, "literal": 3}.get(x.tag)
            body = x.text or ""
            dt = x.get("datatype", "")
            cells.append(None if k is None else (k, f"_:{body}" if k == 2 and not body.startswith("_:") else body, "" if dt in t.STRINGS else dt, x.get("{http://www.w3.org/XML/1998/namespace}lang", "")))
        rows.append(tuple(cells))
    return [e.text or "" for e in root.iter("columnName")], rows


def _xml_results(text: str) -> tuple[list[str], list[tuple]]:
    root = ET.fromstring(text)
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    names = [e.get("name") for e in root.iter() if local(e) == "variable"]
    rows = []
    for r in root.iter():
        if local(r) == "result":
            got = {}
            for b in r:
                x = b[0]
                k = {"uri": 1, "bnode": 2, "literal": 3}[local(x)]
                body = x.text or ""
                dt = x.get("datatype", "")
                got[b.get("name")] = (k, f"_:{body}" if k == 2 and not body.startswith("_:") else body, "" if dt in t.STRINGS else dt, x.get("{http://www.w3.org/XML/1998/namespace}lang", ""))
            rows.append(tuple(got.get(n) for n in names))
    return names, rows
