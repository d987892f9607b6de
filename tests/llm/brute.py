"""Brute-force versions of the corpus operators, over lists of (id, text) rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from quillgraph.llm.queries import vocabulary


def substring(rows, length=200):
    texts = [(t or "").encode() for _, t in rows]
    starts = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for (k, _), b in zip(rows, texts, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if starts[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((k, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def pieces_of(path):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


def greedy(word, vocabulary):
    first = {p for p in vocabulary if p[0] == "▁" and "▁" not in p[1:]}
    rest = {p for p in vocabulary if "▁" not in p}
    w, i, n = "▁" + word, 0, 0
    while i < len(w):
        for j in range(len(w), i, -1):
            if w[i:j] in (rest if i else first):
                i, n = j, n + 1
                break
        else:
            return -1
    return n


def tokens(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids + [1]


def cut(rows, length=4096):
    out = []
    for k, t in rows:
        ids = tokens(t)
        for p in range(0, len(ids), length):
            own = ids[p : p + length]
            out.append((k, p // length, p, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    return out


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])


def jaccard(a, b, size=5):
    x, y = set(shingles(a, size)), set(shingles(b, size))
    return len(x & y) / len(x | y) if x and y else 0.0


def near(rows, similarity=0.8, size=5):
    """Components of (id, text) rows by fingerprints within two bits or similar shingle sets."""
    texts = dict(rows)
    prints = {k: simhash(t, size) for k, t in rows}
    return components(list(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2 or jaccard(texts[a], texts[b], size) >= similarity)


def simhash(text, size=3):
    parts = shingles(text, size)
    if not parts:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, near):
    """Smallest node reachable, for links near(a, b)."""
    up = {k: k for k in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {k: find(k) for k in nodes}


def line_dedup(rows, window=3):
    seen, out = set(), {}
    for k, t in sorted(rows):
        lines = (t or "").split("\n")
        gone = set()
        for i in range(len(lines) - window + 1):
            w = tuple(lines[i : i + window])
            if not "".join(w).strip(" \t\r\x0b\f"):
                continue
            if w in seen:
                gone |= set(range(i, i + window))
            seen.add(w)
        out[k] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def top_k(vectors, asks, k=5):
    ok = {i: [int(np.floor(256 * x)) for x in v] for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in ok:
        if asks(q):
            best = sorted((-sum(a * b for a, b in zip(ok[q], ok[i], strict=True)), i) for i in ok if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def by(rows, *names):
    out = defaultdict(list)
    for r in rows:
        out[r[names[0]]].append(tuple(r[n] for n in names[1:]))
    return dict(out)


def mix(rows, keys, order, want, block_tokens):
    """Uses of (id, source, tokens) rows: whole passes over the wanted tokens, then blocks in their order, then documents in theirs."""
    out = Counter()
    for source in {s for _, s, _ in rows}:
        own = [(i, n) for i, s, n in rows if s == source]
        total = sum(n for _, n in own)
        full, rest = divmod(want[source], total) if total else (1, 0)
        count = max(1, -(-total // block_tokens))
        blocks = defaultdict(list)
        for i, n in own:
            blocks[keys[i] % count].append((keys[i], i, n))
        used, again = 0, set()
        for b in sorted(blocks, key=lambda b: order(source, b, full) % 2**64):
            for _, i, n in sorted(blocks[b]):
                if used < rest:
                    again.add(i)
                used += n
        for i, _ in own:
            out[i] += full + (i in again)
    return out


def main_text(page, dropped=("nav", "footer", "aside", "form", "script", "style", "header"), classes=("ad", "sidebar", "comments", "cookie-notice")):
    """The text of a page's article, by the standard library's parser; only paragraphs and items may be left open."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        inside, out, blocks, now = [], 0, [], ""

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.now += " "
            if tag in ("br", "meta", "img", "link", "input", "hr"):
                return
            gone = tag in dropped or any(n == "class" and v in classes for n, v in attrs)
            self.inside = [*self.inside, (tag, gone)]
            self.block(tag)

        def handle_endtag(self, tag):
            if any(t == tag for t, _ in self.inside):  # paragraphs and items may be left open
                while self.inside[-1][0] != tag:
                    self.inside = self.inside[:-1]
                self.inside = self.inside[:-1]
            self.block(tag)

        def block(self, tag):
            if tag not in ("a", "b", "i", "em", "strong", "span"):
                self.blocks, self.now = [*self.blocks, self.now], ""

        def handle_data(self, data):
            if any(t == "article" for t, _ in self.inside) and not any(g for _, g in self.inside):
                self.now += data

    reader = Reader()
    reader.feed(page or "")
    reader.block("p")
    return "\n".join(t for b in reader.blocks if (t := " ".join(b.split())))
