"""Packing documents into sequences of a fixed length by best-two-fit.

Token counts of pieces are dealt evenly into shards of bounded size; each is packed on its own, and what shards leave in bins
that aren't nearly full is packed again together. A bin is filled greedily
with the longest piece that fits; then its smallest piece is replaced by the two unpacked pieces that fill the gap, with
the smallest piece's room, best.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType
from pyspark import TaskContext

from .common import materialize, text_or_empty

LENGTH, SHARD, END_ID = 4096, 20_000, 1
#: Words whose ids a worker keeps, the length up to which they outlast a full cache and are kept at all; characters looked up at once.
CACHE, KEPT_LENGTH, LONGEST_KEPT, GROUP = 250_000, 6, 64, 1 << 20


_BREAK = re.compile(r"[ \t\n\r]")
_PLAIN = re.compile("[a-zß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """Latin-1 letters as the vocabulary writes their UTF-8 bytes: printable bytes as they are, others from code 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in printable)
    letter = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(128, 256)}


_PLAIN_BYTES = _byte_letters()
#: A full stop or comma before a break and not after a letter or digit.
_RUN = re.compile("[.,](?<![a-z0-9ß-öø-ÿ][.,]) ")


@lru_cache(maxsize=1)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism; idle threads would only spin
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def parts(text: str) -> Iterator[str]:
    """A text in parts of about ``GROUP`` characters that end before a break."""
    at = 0
    while at < len(text):
        m = _BREAK.search(text, at + GROUP)
        yield text[at : m.start() if m else len(text)]
        at = m.start() if m else len(text)


def split(text: str) -> list[str]:
    """Parts of a text whose ids are those of the text when joined; empty strings included.

    Parts stand between spaces, tabs and line breaks. In Latin-1 texts, where lower case and composition don't depend on
    what is around, capitals are lowered as the vocabulary does it, so that a word has one form, and a full stop or comma after a
    letter or digit and before a break is a part of its own, unless the text has such a sign after another sign anywhere.
    """
    text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.split(" ")
    text = text.lower()
    if not _RUN.search(text):
        text = text.replace(". ", " . ").replace(", ", " , ")
    return text.split(" ")


class Encoder(dict):
    """Ids of whole texts as little-endian unsigned 32-bit numbers.

    The vocabulary's pre-tokenizer never joins characters across a space, tab or line break, so what stands between them is
    encoded on its own when it is first met, and kept up to a bound.
    """

    def __init__(self, path: str, cache: int = CACHE):
        self.tokenizer, self.cache = load(path), cache
        self.tokenize = self.tokenizer.model.tokenize

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.cache:  # short words come again; long ones seldom do
            short = {w: i for w, i in self.items() if len(w) <= KEPT_LENGTH}
            self.clear()
            if len(short) < self.cache // 2:
                self.update(short)
        if _PLAIN.fullmatch(word):  # lower-case Latin-1 letters are one run to the pre-tokenizer: the model is asked at once
            ids = array("I", [t.id for t in self.tokenize(word.translate(_PLAIN_BYTES))]).tobytes()
        else:
            ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if len(word) <= LONGEST_KEPT:
            self[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        return b"".join([b"".join(map(self.__getitem__, split(part))) for part in parts(text)])


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """A worker's encoder, kept from task to task."""
    return Encoder(path)


def pieces(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, deal``: every document's ids with the end id, cut only where too long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        part = TaskContext.get().partitionId() << 40
        for b in batches:
            out: list[tuple] = []
            encode = encoder(vocabulary_path).text
            for doc, body in zip(b.column("doc_id").to_pylist(), b.column("body"), strict=True):
                ids = encode(body.as_py()) + END_ID.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    own = ids[at : at + 4 * length]
                    out.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own), part + n))
                    n += 1
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "deal"])

    body = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("body"))
    return body.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, deal long")


def best_two_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; every length is from 1 to ``room``."""
    order = np.argsort(lengths, kind="stable")
    count = np.bincount(lengths, minlength=room + 1)
    at = np.concatenate([[0], np.cumsum(count)])[:-1].tolist()  # next place in order of each length
    left, free = count.tolist(), sum(1 << int(x) for x in np.flatnonzero(count))
    upto = [(2 << x) - 1 for x in range(room + 1)]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def most(x: int) -> int:
        """The longest free length of at most x, or 0."""
        return (free & upto[x]).bit_length() - 1 if x > 0 and free & upto[x] else 0

    def take(x: int) -> None:
        nonlocal free
        left[x] -= 1
        if not left[x]:
            free ^= 1 << x

    def give(x: int) -> None:
        nonlocal free
        left[x] += 1
        free |= 1 << x

    k = 0
    while free:
        own, gap = [], room
        while x := most(gap):
            take(x)
            own.append(x)
            gap -= x
        if gap and free:
            small = own[-1]  # lengths fall as a bin is filled
            wide, best, pair = gap + small, small, None
            a = most(wide - 1)
            while a and 2 * a > best:
                take(a)
                b = most(min(a, wide - a))
                give(a)
                if b and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == wide:
                        break
                a = most(a - 1)
            if pair:
                own.pop()
                give(small)
                for x in pair:
                    take(x)
                own += pair
        offset = 0
        for x in own:
            i = order[at[x]]
            at[x] += 1
            bins[i], offsets[i] = k, offset
            offset += x
        k += 1
    return bins, offsets


#: A sequence filled to less than this share is packed again with those of other shards.
NEARLY = 0.95
_PIECE = ("doc_id", "piece", "start", "length", "ids_crc32")


def _packed(cut: DataFrame, n: int, length: int, shard: int, turn: int) -> DataFrame:
    """``n`` pieces in shards, each packed on its own: with ``sequence_id, offset`` and whether the sequence is ``left_open``."""
    shards = max(1, -(-n // shard))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy()
        bins, offsets = best_two_fit(lengths, length)
        fill = np.bincount(bins, lengths)
        ids = bins + (int(pdf["shard"].iloc[0]) << 32) + (turn << 62)
        return pdf.drop(columns=["shard"]).assign(sequence_id=ids, offset=offsets, left_open=fill[bins] < NEARLY * length)

    dealt = cut.select(*_PIECE, "deal", F.pmod(F.xxhash64("deal", F.lit(turn)), F.lit(shards)).cast(IntegerType()).alias("shard"))
    return dealt.groupBy("shard").applyInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, deal long, sequence_id long, offset long, left_open boolean")


def pack(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """Sequences of at most ``length`` tokens that hold every document.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one row a piece. A null or empty text is the end
    id alone. Documents of at most ``length`` ids are never cut; longer ones are cut into full pieces and a rest. Rows
    repeated with one id, or with a null id, are packed each. Texts of any length are encoded whole. Pieces of equal length are packed in any order. Other
    columns are not read. An empty table gives an empty result.
    """
    cut = materialize(pieces(docs, vocabulary_path, id_col, text_col, length), "pieces")
    first = materialize(_packed(cut, cut.count(), length, shard, 0), "packed")
    # what the shards have left in sequences that aren't nearly full is packed together
    left = first.where("left_open").select(*_PIECE, "deal")
    again = _packed(left, left.count(), length, shard, 1)
    return first.where("not left_open").unionByName(again).drop("deal", "left_open")
