"""Word-piece counts by a linear longest-match automaton.

The vocabulary is a trie with failure links. For each node the link's target and the number of pieces that greedy
longest-match has settled on the way are computed once, so a word is read once, character by character, and its pieces
are counted and never built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose counts a worker keeps, and the length up to which they are kept; characters read at once.
CACHE, LONGEST_KEPT, CHUNK = 150_000, 64, 1 << 20
MARK = "▁"


class Automaton:
    """Greedy longest-match over pieces; those that begin with the mark of a word's start stand only there."""

    def __init__(self, vocabulary: list[str]):
        self.goto: list[dict[str, int]] = [{}, {}]  # 0: before the word, 1: between its pieces
        whole = [False, False]
        for piece in vocabulary:
            if not piece or MARK in piece[1:]:
                continue
            at = 0 if piece[0] == MARK else 1
            for c in piece:
                if c not in self.goto[at]:
                    self.goto[at][c] = len(self.goto)
                    self.goto.append({})
                    whole.append(False)
                at = self.goto[at][c]
            whole[at] = True
        n = len(self.goto)
        self.fail, self.popped = [-1] * n, [0] * n
        queue = deque([0, 1])
        while queue:
            v = queue.popleft()
            for c, u in self.goto[v].items():
                if whole[u]:
                    self.fail[u], self.popped[u] = 1, 1
                else:
                    z, pops = self.fail[v], self.popped[v]
                    while z >= 0 and c not in self.goto[z]:
                        pops += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[u], self.popped[u] = self.goto[z][c], pops
                queue.append(u)

    def count(self, word: str) -> int:
        """Pieces of the word; -1 if greedy longest-match can't cover it."""
        goto, fail, popped, at, n = self.goto, self.fail, self.popped, 0, 0
        for c in MARK + word:
            while (to := goto[at].get(c)) is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return -1
            at = to
        while at != 1:
            n += popped[at]
            at = fail[at]
            if at < 0:
                return -1
        return n


@lru_cache(maxsize=2)
def load(path: str) -> Automaton:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return Automaton([sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))])


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut at white space only."""
    if len(text) <= size:
        yield text
        return
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end


class Counter:
    """Counts texts; the counts of words seen before are kept, up to a bound."""

    def __init__(self, automaton: Automaton, cache: int = CACHE):
        self.automaton, self.cache, self.known = automaton, cache, {}

    def text(self, text: str | None) -> tuple[int, int, int]:
        n_words = n_tokens = n_unknown = 0
        for part in chunks(text or ""):
            words = part.split()
            n = list(map(self.known.get, words))
            if None in n:
                if len(self.known) > self.cache:
                    self.known.clear()
                count = self.automaton.count
                new = {w: count(w) for w in set(words) if w not in self.known}
                self.known.update(new)
                n = list(map(self.known.__getitem__, words))
                for w in new:
                    if len(w) > LONGEST_KEPT:
                        del self.known[w]
            unknown = n.count(-1)
            n_words, n_tokens, n_unknown = n_words + len(n), n_tokens + sum(n) + 2 * unknown, n_unknown + unknown
        return n_words, n_tokens, n_unknown


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    """A worker's counter, kept from task to task."""
    return Counter(load(path))


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How many word pieces each whole text has.

    Words stand between white space; each is matched with the mark of a word's start before it. A word that greedy
    longest-match can't cover counts as one unknown token.

    Returns ``doc_id, n_words, n_tokens, n_unknown``, one row for each input row. Null and empty texts have zeros. Texts and
    words of any length are read whole, texts in parts that end between words. A longest match has no ties. Rows repeated
    or with a null id stay. Other columns are not read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [counter(vocabulary_path).text(x.as_py()) for x in b.column("body")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array([g[k] for g in got], pa.int64()) for k in range(3)]], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    body = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("body"))
    return body.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
