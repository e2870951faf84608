"""Turtle and RDF/XML documents to triples, in plain Python: a document is one unit of parsing, so files are the unit of work."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

from quadloom.plans.algebra import RDF, Iri, Lit, Triple, Var
from quadloom.plans.sparql import Parser, SyntaxProblem

Row = tuple[tuple, str, tuple]


class _Turtle(Parser):
    def __init__(self, text: str, base: str, blank: str) -> None:
        super().__init__(text, base)
        # @prefix and @base become the forms without '@', which end without a dot too
        for k, (kind, v) in enumerate(self.toks):
            if kind == "lang" and v in ("@prefix", "@base") and (k == 0 or self.toks[k - 1][0] != "string"):
                self.toks[k] = ("word", v[1:])
        self.prefixes = {}
        self.blank = blank

    def rows(self) -> Iterator[Row]:
        while self.peek()[0] != "end":
            self.prologue()
            while self.op("."):
                pass
            if self.peek()[0] == "end":
                return
            if self.at_word("base", "prefix"):
                continue
            for t in self.statement():
                yield self._term(t.s), self._iri(t.p), self._term(t.o)

    def statement(self) -> list[Triple]:
        out: list[Triple] = []
        compound = self.peek()[1] in ("[", "(")
        s = self.graph_node(out)
        if isinstance(s, Lit):
            raise SyntaxProblem("a literal can't be a subject")
        if not (compound and out and self.peek()[1] == "."):
            self.property_list(s, out)
        self.need(".")
        return out

    def _iri(self, p) -> str:
        if not isinstance(p, Iri):
            raise SyntaxProblem("a predicate must be an IRI")
        return p.value

    def _term(self, x) -> tuple:
        if isinstance(x, Iri):
            return (1, x.value, "", "")
        if isinstance(x, Var):
            if not x.name.startswith("~"):
                raise SyntaxProblem("a variable in data")
            return (2, f"_:{self.blank}{x.name[1:]}", "", "")
        return (3, x.lex, "" if x.dt == "http://www.w3.org/2001/XMLSchema#string" else x.dt, x.lang)


def parse_turtle(text: str, base: str = "", blank: str = "b") -> list[Row]:
    return list(_Turtle(text, base, blank).rows())


_XML = "{http://www.w3.org/XML/1998/namespace}"


def parse_rdfxml(text: str | bytes, base: str = "", blank: str = "b") -> list[Row]:
    out: list[Row] = []
    names = iter(range(10**9))
    r = lambda n: f"{{{RDF}}}{n}"

    def fresh() -> tuple:
        return (2, f"_:{blank}x{next(names)}", "", "")

    def uri(tag: str) -> str:
        return tag[1:].replace("}", "") if tag.startswith("{") else tag

    def iri(x: str, at: str) -> tuple:
        return (1, urljoin(at, x) if at else x, "", "")

    def node(e, at: str, lang: str) -> tuple:
        at, lang = e.get(_XML + "base", at), e.get(_XML + "lang", lang)
        if e.get(r("about")) is not None:
            s = iri(e.get(r("about")), at)
        elif e.get(r("ID")) is not None:
            s = iri("#" + e.get(r("ID")), at)
        elif e.get(r("nodeID")) is not None:
            s = (2, f"_:{blank}{e.get(r('nodeID'))}", "", "")
        else:
            s = fresh()
        if e.tag != r("Description"):
            out.append((s, RDF + "type", (1, uri(e.tag), "", "")))
        for k, v in e.attrib.items():
            if k == r("type"):
                out.append((s, RDF + "type", iri(v, at)))
            elif not k.startswith((f"{{{RDF}}}", _XML)):
                out.append((s, uri(k), (3, v, "", lang)))
        counter = 0
        for p in e:
            if p.tag == r("li"):
                counter += 1
                prop(s, f"{RDF}_{counter}", p, at, lang)
            else:
                prop(s, uri(p.tag), p, at, lang)
        return s

    def prop(s: tuple, p: str, e, at: str, lang: str) -> None:
        at, lang = e.get(_XML + "base", at), e.get(_XML + "lang", lang)
        kind = e.get(r("parseType"))
        children = list(e)
        if kind == "Collection":
            cells = [fresh() for _ in children]
            nil = (1, RDF + "nil", "", "")
            o = cells[0] if cells else nil
            for k, c in enumerate(children):
                out.append((cells[k], RDF + "first", node(c, at, lang)))
                out.append((cells[k], RDF + "rest", cells[k + 1] if k + 1 < len(cells) else nil))
        elif kind == "Resource":
            o = fresh()
            for c in children:
                prop(o, uri(c.tag), c, at, lang)
        elif kind == "Literal":
            o = (3, (e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in children), RDF + "XMLLiteral", "")
        elif e.get(r("resource")) is not None:
            o = iri(e.get(r("resource")), at)
        elif e.get(r("nodeID")) is not None:
            o = (2, f"_:{blank}{e.get(r('nodeID'))}", "", "")
        elif children:
            o = node(children[0], at, lang)
        else:
            extra = [(k, v) for k, v in e.attrib.items() if not k.startswith((f"{{{RDF}}}", _XML))]
            if extra:
                o = fresh()
                out.extend((o, uri(k), (3, v, "", lang)) for k, v in extra)
            else:
                dt = e.get(r("datatype"), "")
                o = (3, e.text or "", "" if dt == "http://www.w3.org/2001/XMLSchema#string" else dt, "" if dt else lang)
        out.append((s, p, o))
        if e.get(r("ID")) is not None:
            st = iri("#" + e.get(r("ID")), at)
            out.append((st, RDF + "type", (1, RDF + "Statement", "", "")))
            out.append((st, RDF + "subject", s))
            out.append((st, RDF + "predicate", (1, p, "", "")))
            out.append((st, RDF + "object", o))

    root = ET.fromstring(text)
    if root.tag == r("RDF"):
        at, lang = root.get(_XML + "base", base), root.get(_XML + "lang", "")
        for e in root:
            node(e, at, lang)
    else:
        node(root, base, "")
    return out
