"""A reader of RDF/XML."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from itertools import count
from urllib.parse import urljoin

from ..vocab import FIRST, NIL, RDF, REST, TYPE
from .jsonld import Triple

_R = f"{{{RDF}}}"
_XML = "{http://www.w3.org/XML/1998/namespace}"
_SYNTAX = {_R + n for n in ("about", "ID", "nodeID", "resource", "parseType", "datatype")}


class _Reader:
    def __init__(self, base: str | None):
        self.base, self.fresh, self.out = base, (f"_b{k}" for k in count()), []

    def resolve(self, iri: str) -> str:
        return urljoin(self.base, iri) if self.base else iri

    def subject(self, e: ET.Element) -> tuple[str, str]:
        if _R + "about" in e.attrib:
            return self.resolve(e.attrib[_R + "about"]), "u"
        if _R + "ID" in e.attrib:
            return self.resolve("#" + e.attrib[_R + "ID"]), "u"
        if _R + "nodeID" in e.attrib:
            return f"_n{e.attrib[_R + 'nodeID']}", "b"
        return next(self.fresh), "b"

    def node(self, e: ET.Element, lang: str | None) -> tuple[str, str]:
        lang = e.attrib.get(_XML + "lang", lang)
        s = self.subject(e)
        if e.tag != _R + "Description":
            self.out.append((*s, TYPE, _iri(e.tag), "u", None, None))
        self.attributes(s, e, lang)
        for k, child in enumerate(e):
            self.property(s, child, lang, k)
        return s

    def attributes(self, s: tuple[str, str], e: ET.Element, lang: str | None) -> None:
        for name, value in e.attrib.items():
            if name == TYPE_NAME:
                self.out.append((*s, TYPE, self.resolve(value), "u", None, None))
            elif name not in _SYNTAX and not name.startswith(_XML) and name.startswith("{"):
                self.out.append((*s, _iri(name), value, "l", None, lang.lower() if lang else None))

    def property(self, s: tuple[str, str], e: ET.Element, lang: str | None, k: int) -> None:
        lang = e.attrib.get(_XML + "lang", lang)
        p = RDF + f"_{k + 1}" if e.tag == _R + "li" else _iri(e.tag)
        kind = e.attrib.get(_R + "parseType")
        plain = {n for n in e.attrib if n not in _SYNTAX and not n.startswith(_XML)}
        if kind == "Collection":
            head: tuple[str, str] = (NIL, "u")
            for o in reversed([self.node(c, lang) for c in e]):
                cell = next(self.fresh)
                self.out += [(cell, "b", FIRST, *o, None, None), (cell, "b", REST, *head, None, None)]
                head = (cell, "b")
            self.out.append((*s, p, *head, None, None))
        elif kind == "Resource":
            o = (next(self.fresh), "b")
            self.out.append((*s, p, *o, None, None))
            for n, c in enumerate(e):
                self.property(o, c, lang, n)
        elif kind is not None:
            text = (e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in e)
            self.out.append((*s, p, text, "l", RDF + "XMLLiteral", None))
        elif len(e):
            for c in e:
                self.out.append((*s, p, *self.node(c, lang), None, None))
        elif _R + "resource" in e.attrib or _R + "nodeID" in e.attrib or plain:
            if _R + "resource" in e.attrib:
                o = (self.resolve(e.attrib[_R + "resource"]), "u")
            else:
                o = (f"_n{e.attrib[_R + 'nodeID']}", "b") if _R + "nodeID" in e.attrib else (next(self.fresh), "b")
            self.out.append((*s, p, *o, None, None))
            self.attributes(o, e, lang)
        else:
            datatype = e.attrib.get(_R + "datatype")
            self.out.append((*s, p, e.text or "", "l", datatype, None if datatype or not lang else lang.lower()))


TYPE_NAME = _R + "type"


def _iri(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


def parse(text: str | bytes, base: str | None = None) -> list[Triple]:
    """Triples of an RDF/XML document."""
    root = ET.fromstring(text)
    reader = _Reader(root.attrib.get(_XML + "base", base))
    for e in root if root.tag == _R + "RDF" else [root]:
        reader.node(e, root.attrib.get(_XML + "lang"))
    return list(dict.fromkeys(reader.out))
