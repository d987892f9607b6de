"""A reader of Turtle."""

from __future__ import annotations

import re
from itertools import count
from urllib.parse import urljoin

from ..vocab import FIRST, NIL, REST, TYPE, XSD
from .jsonld import Triple

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><[^<>"{}|^`\\\x00-\x20]*(?:\\[uU][0-9A-Fa-f]+[^<>"{}|^`\\\x00-\x20]*)*>)
    |(?P<long>\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
    |(?P<string>"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<directive>@prefix\b|@base\b|(?i:PREFIX\b|BASE\b)(?=\s))
    |(?P<lang>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<blank>_:[\w](?:[\w.\-·]*[\w\-·])?)
    |(?P<mark>\^\^|[.;,\[\]()])
    |(?P<name>(?:[^\W\d_](?:[\w.\-]*[\w\-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w:.\-·]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:\-·]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
    |(?P<word>a\b|true\b|false\b)""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def _unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _PLAIN.get(m[1], m[1]), text)


class _Reader:
    def __init__(self, text: str, base: str | None):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise ValueError(f"Turtle can't be read at {text[at:at + 40]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.base, self.prefixes = 0, base, {}
        self.fresh, self.named = (f"_b{k}" for k in count()), {}
        self.out: list[Triple] = []

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, text: str | None = None) -> tuple[str, str]:
        kind, value = self.peek()
        if kind == "end" or text is not None and value != text:
            raise ValueError(f"Turtle: {value or 'end'!r} where {text or 'more'!r} should be")
        self.at += 1
        return kind, value

    def resolve(self, token: str) -> str:
        iri = _unescape(token[1:-1])
        return urljoin(self.base, iri) if self.base else iri

    def document(self) -> list[Triple]:
        while self.peek()[0] != "end":
            kind, value = self.peek()
            if kind == "directive":
                self.take()
                if value.lower().lstrip("@") == "prefix":
                    prefix = self.take()[1][:-1]
                    self.prefixes[prefix] = self.resolve(self.take()[1])
                else:
                    self.base = self.resolve(self.take()[1])
                if value[0] == "@":
                    self.take(".")
                continue
            listed = value == "["
            s = self.term()
            if not (listed and self.peek()[1] == "."):
                self.properties(s)
            self.take(".")
        return list(dict.fromkeys(self.out))

    def properties(self, s: tuple) -> None:
        while True:
            p = TYPE if self.peek() == ("word", "a") and self.take() else self.term()[0]
            while True:
                self.out.append((s[0], s[1], p, *self.term()))
                if self.peek()[1] != ",":
                    break
                self.take()
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] in (".", "]") or self.peek()[0] == "end":
                return
            if self.tokens[self.at - 1][1] != ";":
                raise ValueError("Turtle: a predicate list goes on without a semicolon")

    def term(self) -> tuple:
        kind, value = self.take()
        if kind == "iri":
            return self.resolve(value), "u", None, None
        if kind == "name":
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise ValueError(f"Turtle: unknown prefix {prefix!r}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local), "u", None, None
        if kind == "blank":
            return self.named.setdefault(value, f"_n{value[2:]}"), "b", None, None
        if kind in ("string", "long"):
            text = _unescape(value[3:-3] if kind == "long" else value[1:-1])
            if self.peek()[0] == "lang":
                return text, "l", None, self.take()[1][1:].lower()
            if self.peek()[1] == "^^":
                self.take()
                return text, "l", self.term()[0], None
            return text, "l", None, None
        if kind == "number":
            return value, "l", XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"), None
        if kind == "word" and value != "a":
            return value, "l", XSD + "boolean", None
        if value == "[":
            node = (next(self.fresh), "b", None, None)
            if self.peek()[1] != "]":
                self.properties(node)
            self.take("]")
            return node
        if value == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.term())
            self.take(")")
            head: tuple = (NIL, "u", None, None)
            for o in reversed(items):
                cell = next(self.fresh)
                self.out += [(cell, "b", FIRST, *o), (cell, "b", REST, *head)]
                head = (cell, "b", None, None)
            return head
        raise ValueError(f"Turtle: {value!r} isn't a term")


def parse(text: str, base: str | None = None) -> list[Triple]:
    """Triples of a Turtle document."""
    return _Reader(text, base).document()
