"""Repositories behind the HTTP interface of path-expression servers, as a source and a target.

A reply is one document of bounded size, as the server made it; it is parsed on the driver. ``fetch`` sends a request: (path,
fields, method) to bytes; by default over HTTP with the session's cookie.
"""

from __future__ import annotations

import http.cookiejar
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadloom import terms as t
from quadloom.sources.graphs import QUADS, QuadGraph
from quadloom.sources.readers import table_results
from quadloom.sources.turtle import parse_rdfxml

Fetch = Callable[[str, dict[str, str], str], bytes]


def over_http(url: str, timeout: float = 600) -> Fetch:
    opener = urllib.request.build_opener(urllib.request.HTTPCookieProcessor(http.cookiejar.CookieJar()))

    def fetch(path: str, fields: dict[str, str], method: str) -> bytes:
        form = urllib.parse.urlencode(fields)
        where = f"{url.rstrip('/')}/servlets/{path}"
        request = urllib.request.Request(where, form.encode(), method="POST") if method == "POST" else urllib.request.Request(f"{where}?{form}" if form else where)
        with opener.open(request, timeout=timeout) as reply:
            return reply.read()

    return fetch


class Repository:
    """One repository of a server. Failures of the server are raised as they come."""

    def __init__(self, spark: SparkSession, url: str, repository: str, fetch: Fetch | None = None) -> None:
        self.spark, self.repository = spark, repository
        self.fetch = fetch or over_http(url)

    def _ask(self, path: str, method: str = "GET", **fields: str) -> bytes:
        return self.fetch(path, {"repository": self.repository, **fields}, method)

    def login(self, user: str, password: str) -> None:
        self.fetch("login", {"user": user, "password": password}, "POST")

    def logout(self) -> None:
        self.fetch("logout", {}, "GET")

    def repositories(self) -> list[dict[str, str]]:
        """id, title, readable, writeable of each repository of the server."""
        root = ET.fromstring(self.fetch("listRepositories", {}, "GET"))
        return [{"id": r.get("id"), "title": r.findtext("title", ""), "readable": r.get("readable"), "writeable": r.get("writeable")} for r in root.iter("repository")]

    def table_query(self, query: str, language: str = "SeRQL") -> DataFrame:
        """A TERM column per variable."""
        names, rows = table_results(self._ask("evaluateTableQuery", query=query, queryLanguage=language, resultFormat="xml").decode())
        return self.spark.createDataFrame(rows, ", ".join(f"`{n}` {t.TERM}" for n in names))

    def graph_query(self, query: str, language: str = "SeRQL") -> QuadGraph:
        return self._graph(self._ask("evaluateGraphQuery", query=query, queryLanguage=language, resultFormat="xml"))

    def extract(self, schema: bool = True, data: bool = True, explicit_only: bool = False) -> QuadGraph:
        flag = lambda x: "on" if x else "off"
        return self._graph(self._ask("extractRDF", schema=flag(schema), data=flag(data), explicitOnly=flag(explicit_only), serialization="rdfxml"))

    def _graph(self, reply: bytes) -> QuadGraph:
        rows = [(s, p, o, self.repository, None) for s, p, o in parse_rdfxml(reply, "", f"{self.repository}_")]
        return QuadGraph(self.spark.createDataFrame(rows, QUADS))

    def upload(self, text: str, data_format: str = "rdfxml", base: str = "") -> None:
        self._ask("uploadData", "POST", data=text, dataFormat=data_format, baseURI=base, resultFormat="xml")

    def remove(self, subject: str | None = None, predicate: str | None = None, object_: str | None = None) -> None:
        """Statements that fit the given terms, each in N-Triples notation."""
        given = {"subject": subject, "predicate": predicate, "object": object_}
        self._ask("removeStatements", "POST", resultFormat="xml", **{k: v for k, v in given.items() if v is not None})

    def clear(self) -> None:
        self._ask("clearRepository", "POST", resultFormat="xml")
