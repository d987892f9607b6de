"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary of pieces has one probability a language. A word's probability is the sum over all its
segmentations into pieces, by the forward algorithm; a text's is the product over its words. Probabilities are learned
by expectation-maximisation on a bounded sample of labelled documents.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import text_or_empty

#: The bound of the training sample: about so many documents a language.
SAMPLE_DOCS = 400
ROUNDS, PRIOR = 3, 0.01
#: Words whose scores a worker keeps, and the length up to which they outlast a full cache.
CACHE, KEPT_LENGTH = 300_000, 6
LONG_WORD, CHUNK = 32, 1 << 20
_WORD = re.compile(r"[^\W\d_]+")


def load_vocabulary(path: str) -> list[str]:
    """Lower-case pieces of a SentencePiece model, in its order, without control and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return list(dict.fromkeys(p for p in pieces if all(c.isalpha() or c == "▁" for c in p)))


def words(text: str) -> Iterator[list[str]]:
    """Runs of letters in lower case, in lists that never hold more than a chunk of the text."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            while end < len(text) and text[end].isalpha():
                end += 1
        yield _WORD.findall(text[at:end].lower())
        at = end


class Pieces:
    """Pieces by text; id 0 stands for a character that is no piece."""

    def __init__(self, vocabulary: list[str]):
        self.ids = {p: k + 1 for k, p in enumerate(vocabulary)}
        self.longest = max(map(len, vocabulary), default=1)
        # beginnings of pieces that are none themselves: a search ends where no piece begins so
        self.tree = {p[:n]: -1 for p in vocabulary for n in range(1, len(p))} | self.ids

    def edges(self, word: str) -> list[int]:
        """All pieces in the word with the mark of a word's start, as id << 12 | start << 6 | end; at most 62 letters."""
        w, get, out = "▁" + word, self.tree.get, []
        n = len(w)
        for i in range(n):
            at = i << 6
            k = get(w[i], 0)
            out.append((k if k > 0 else 0) << 12 | at | i + 1)
            for j in range(i + 2, n + 1):
                k = get(w[i:j])
                if k is None:
                    break
                if k > 0:
                    out.append(k << 12 | at | j)
        return out


def _lattice(pieces: Pieces, batch: list[str]) -> tuple[np.ndarray, int]:
    """Columns word, start, end, piece ordered by end, and the longest word's length with its mark."""
    each = [pieces.edges(w) for w in batch]
    flat = np.fromiter(chain.from_iterable(each), np.int64, sum(map(len, each)))
    word = np.repeat(np.arange(len(batch)), [len(e) for e in each])
    e = np.stack([word, flat >> 6 & 63, flat & 63, flat >> 12], axis=1)
    return e[np.argsort(e[:, 2], kind="stable")], max(map(len, batch)) + 1


def _forward(e: np.ndarray, longest: int, n: int, p: np.ndarray) -> np.ndarray:
    alpha = np.zeros((longest + 1, n, p.shape[1]))
    alpha[0] = 1
    cut = np.searchsorted(e[:, 2], np.arange(longest + 2))
    for j in range(1, longest + 1):
        x = e[cut[j] : cut[j + 1]]
        part = alpha[x[:, 1], x[:, 0]] * p[x[:, 3]]
        for c in range(p.shape[1]):
            alpha[j, :, c] = np.bincount(x[:, 0], part[:, c], n)
    return alpha


def _log_long(pieces: Pieces, word: str, p: np.ndarray) -> np.ndarray:
    """As log_words, for one word of any length: values are scaled as they go."""
    w, get = "▁" + word, pieces.ids.get
    past, scale = [np.ones(p.shape[1])], np.zeros(p.shape[1])
    for j in range(1, len(w) + 1):
        now = past[-1] * p[get(w[j - 1], 0)]
        for k in range(2, min(j, pieces.longest) + 1):
            if (i := get(w[j - k : j])) is not None:
                now = now + past[-k] * p[i]
        past = [*past[-pieces.longest :], now]
        if j % 16 == 0:
            top = np.maximum(now, 1e-280)
            past, scale = [x / top for x in past], scale + np.log(top)
    return np.log(np.maximum(past[-1], 1e-300)) + scale


def log_words(pieces: Pieces, batch: list[str], p: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language, all segmentations summed."""
    out = np.zeros((len(batch), p.shape[1]))
    short = [k for k, w in enumerate(batch) if len(w) <= LONG_WORD]
    for at in range(0, len(short), 4096):
        part = short[at : at + 4096]
        own = [batch[k] for k in part]
        e, longest = _lattice(pieces, own)
        alpha = _forward(e, longest, len(own), p)
        out[part] = np.log(np.maximum(alpha[[len(w) + 1 for w in own], range(len(own))], 1e-300))
    for k, w in enumerate(batch):
        if len(w) > LONG_WORD:
            out[k] = _log_long(pieces, w, p)
    return out


def _expected_long(pieces: Pieces, word: str, p: np.ndarray) -> Counter:
    """How often each piece is expected in a word of any length, over all its segmentations; sums are logarithms."""
    w, get, logp = "▁" + word, pieces.ids.get, np.log(np.maximum(p[:, 0], 1e-300))
    n = len(w)
    at = [(j - k, j, i) for j in range(1, n + 1) for k in range(1, min(j, pieces.longest) + 1) if (i := get(w[j - k : j], 0 if k == 1 else None)) is not None]
    alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    alpha[0] = beta[n] = 0.0
    for start, end, i in at:
        alpha[end] = np.logaddexp(alpha[end], alpha[start] + logp[i])
    for start, end, i in reversed(at):
        beta[start] = np.logaddexp(beta[start], beta[end] + logp[i])
    out: Counter = Counter()
    for start, end, i in at:
        out[i] += float(np.exp(alpha[start] + logp[i] + beta[end] - alpha[n]))
    return out


def fit(pieces: Pieces, count: dict[str, int], rounds: int = ROUNDS, prior: float = PRIOR) -> np.ndarray:
    """Piece probabilities by expectation-maximisation over words and how often each occurs."""
    size = len(pieces.ids) + 1
    p = np.full((size, 1), 1.0 / size)
    vocabulary = sorted(w for w in count if len(w) <= LONG_WORD)
    longer = sorted(w for w in count if len(w) > LONG_WORD)
    batches = [vocabulary[a : a + 4096] for a in range(0, len(vocabulary), 4096)]
    for _ in range(rounds):
        expected = np.full(size, prior)
        for batch in batches:
            e, longest = _lattice(pieces, batch)
            n = len(batch)
            alpha = _forward(e, longest, n, p)[:, :, 0]
            length = np.array([len(w) + 1 for w in batch])
            total = alpha[length, range(n)]
            beta = np.zeros_like(alpha)
            beta[length, range(n)] = 1
            cut = np.searchsorted(e[:, 2], np.arange(longest + 2))
            for j in range(longest, 0, -1):
                x = e[cut[j] : cut[j + 1]]
                np.add.at(beta, (x[:, 1], x[:, 0]), beta[j, x[:, 0]] * p[x[:, 3], 0])
            times = np.array([count[w] for w in batch], float) / np.maximum(total, 1e-300)
            part = alpha[e[:, 1], e[:, 0]] * p[e[:, 3], 0] * beta[e[:, 2], e[:, 0]] * times[e[:, 0]]
            expected += np.bincount(e[:, 3], part, size)
        for w in longer:
            for i, x in _expected_long(pieces, w, p).items():
                expected[i] += count[w] * x
        p = (expected / expected.sum()).reshape(-1, 1)
    return p[:, 0]


def sample(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows ``doc_id, body, lang`` of about ``sample_docs`` documents of each language.

    Documents are counted by language, and each is taken if a hash of its id and text falls under the language's share; all
    are, if there are no more than asked for. Equal rows fall together and are learned from once. The shares, a row for each
    language, are sent to all tasks, as later the model is.
    """
    shares = labelled.groupBy("lang").agg((F.lit(float(sample_docs)) / F.count(F.lit(1))).alias("share"))
    place = F.pmod(F.xxhash64("doc_id", "body"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return labelled.join(F.broadcast(shares), "lang").where(place < F.col("share")).select("doc_id", "body", "lang").dropDuplicates(["doc_id", "body", "lang"])


def word_counts(rows: DataFrame) -> DataFrame:
    """``lang, word, n``: the words of ``body, lang`` and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count = Counter((lang, w) for lang, text in zip(b.column("lang").to_pylist(), b.column("body"), strict=True) for ws in words(text.as_py()) for w in ws)
            langs, found = zip(*count, strict=True) if count else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.string()), pa.array(count.values(), pa.int64())], names=["lang", "word", "n"])

    return rows.select("lang", "body").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, vocabulary: list[str], sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their piece probabilities from rows ``doc_id, body, lang``.

    Learned from the whole texts of about ``sample_docs`` documents of each language. What comes back is as large as the
    vocabulary times the number of languages. A language whose sample has no word is learned as all pieces alike.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf.dropna(subset=["word"])
        p = fit(Pieces(vocabulary), dict(zip(known["word"], known["n"].astype(int).tolist(), strict=True)))
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "p": [p.tolist()]})

    taken = sample(labelled, sample_docs)
    none = taken.select("lang", F.lit(None).cast("string").alias("word"), F.lit(0).cast("long").alias("n")).distinct()
    rows = word_counts(taken).unionByName(none).groupBy("lang").applyInPandas(run, "lang string, p array<double>").collect()
    rows = sorted(rows, key=lambda r: r["lang"])
    return [r["lang"] for r in rows], np.array([r["p"] for r in rows]).T if rows else np.zeros((len(vocabulary) + 1, 0))


class Scorer:
    """Scores texts; the scores of words seen before are kept, up to a bound."""

    def __init__(self, vocabulary: list[str], langs: list[str], p: np.ndarray, cache: int = CACHE):
        self.pieces, self.langs, self.p, self.cache = Pieces(vocabulary), langs, p, cache
        self._clear()

    def _clear(self) -> None:
        """Forget all words, or all but short ones, which come again, if these leave enough room."""
        known = getattr(self, "known", {})
        short = [w for w in known if len(w) <= KEPT_LENGTH]
        short = short if len(short) <= self.cache // 2 else []
        scores = np.zeros((self.cache, len(self.langs)), np.float64)
        if short:
            scores[: len(short)] = self.scores[[known[w] for w in short]]
        self.scores, self.known = scores, {w: k for k, w in enumerate(short)}

    def _group(self, group: list[list[str]]) -> list[np.ndarray]:
        """Log probabilities of lists of words; those that are new are scored together."""
        found = set().union(*group)
        new = list(found - self.known.keys())
        if len(self.known) + len(new) > self.cache:
            self._clear()
            new = list(found - self.known.keys())
            if len(self.known) + len(new) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros((len(new), len(self.langs)))])
        if new:
            first = len(self.known)
            self.scores[first : first + len(new)] = log_words(self.pieces, new, self.p)
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
        return [self.scores[np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))].sum(axis=0) for ws in group]

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """Log probabilities of whole texts in each language."""
        out: list[np.ndarray] = []
        group, size = [], 0
        for text in texts:
            if len(text) > CHUNK:
                out += self._group(group)
                out.append(sum((self._group([ws])[0] for ws in words(text)), np.zeros(len(self.langs))))
                group, size = [], 0
                continue
            group.append(_WORD.findall(text.lower()))
            size += len(text)
            if size > CHUNK:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        told = [k for k, t in enumerate(texts) if t is not None and self.langs and any(map(str.isalpha, t))]
        out = [("und", 0.0)] * len(texts)
        for k, ll in zip(told, self.texts([texts[k] for k in told]), strict=True):
            odds = np.exp(ll - ll.max())
            best = int(np.argmax(odds))
            out[k] = self.langs[best], float(odds[best] / odds.sum())
        return out


_KEPT: dict[str, Scorer] = {}


def _scorer(name: str, *model) -> Scorer:
    """A worker's scorer, kept from task to task of one model."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Scorer(*model)
    return _KEPT[name]


def held_out_rule(id_col: str = "doc_id") -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def learnable(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that may be learned from: labelled, with id and text, and not held out."""
    return docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out_rule(id_col))


def lang_id(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, keep: bool = False) -> DataFrame:
    """The language of every whole text, among those of the labelled rows that aren't held out.

    Returns ``doc_id, held_out, lang_pred, score``, or with ``keep`` all columns of ``docs`` and ``__lang, __score``. The score is
    the language's share of the texts' probability over all languages, equal priors. A null text or one without a
    letter is ``und`` with score 0, as is every text if no labelled row may be learned from. Ties go to the language that
    sorts first. Rows with a null id are not learned from. Repeated rows are scored each, and learned from once. Very long
    texts are scored whole, in parts that end between words. Of other columns none is read.
    An empty table gives an empty result.
    """
    vocabulary = load_vocabulary(vocabulary_path)
    usable = learnable(docs, id_col, text_col, lang_col)
    langs, p = train(usable.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("body"), F.col(lang_col).alias("lang")), vocabulary, sample_docs)
    model = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, vocabulary, langs, p))  # vocabulary times languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(*model.value)
        for b in batches:
            got = [g for low in range(0, len(b), 500) for g in scorer.predict(b.column("__body").slice(low, 500).to_pylist())]
            rest = [k for k, name in enumerate(b.schema.names) if name != "__body" or keep]
            cols = [b.column(k) for k in rest] + [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            names = [b.schema.names[k] for k in rest] + ["__lang", "__score"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    if keep:
        plain = [f"__c{k}" for k in range(len(docs.columns))]  # the columns' own names may hold dots
        shape = docs.withColumn("__body", F.col(text_col).cast("string")).toDF(*plain, "__body")
        schema = StructType([*shape.schema.fields, StructField("__lang", StringType()), StructField("__score", DoubleType())])
        return shape.mapInArrow(run, schema).drop("__body").toDF(*docs.columns, "__lang", "__score")
    body = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out_rule(id_col).alias("held_out"), F.col(text_col).cast("string").alias("__body"))
    out = body.mapInArrow(run, "doc_id long, held_out boolean, __lang string, __score double")
    return out.select("doc_id", "held_out", F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
