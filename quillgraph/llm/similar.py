"""Links between fingerprints of texts whose shingle sets have a given Jaccard similarity.

At a similarity of 0.8 SimHash fingerprints of 64 bits are about ten bits apart, too far for a pigeonhole index that
stays selective. Such pairs are found by bands of minimum hashes instead: texts that agree in all ``ROWS`` minima of one
of ``BANDS`` bands share a bucket. A pair of similarity 0.8 misses all buckets with a chance of about 1e-4. Every pair that
is looked at is decided by its whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty
from .components import connected_components
from .simhash import fold, shingle_hashes

BANDS, ROWS = 40, 7
#: Members of a bucket, and bytes of their shingle sets, on each side of one block of the comparison that settles what the
#: stars leave open.
BLOCK, BLOCK_BYTES = 1024, 1 << 22
#: Rounds of comparing a bucket's members with one of them.
STARS = 3

_SCALE, _SHIFT = np.random.default_rng(7).integers(0, 2**64, (2, BANDS * ROWS), dtype=np.uint64)
_SCALE |= np.uint64(1)
_SKETCH = "doc_id long, fp long, digest binary, keys array<long>"


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of ``BANDS * ROWS`` hash functions over shingle hashes, 32 bits of it."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(low, (hashes[at : at + 1024, None] * _SCALE + _SHIFT).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The different shingle hashes of a text, in order."""
    parts = list(shingle_hashes(text, shingle))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, "<u8")


def sketches(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, digest, keys``: fingerprint, digest of the shingle set, and bucket keys.

    The last two are null for a text without words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, digests, keys = [], [], []
            for x in b.column("body"):
                parts = list(shingle_hashes(x.as_py(), shingle))
                fps.append(fold(parts))
                if not parts:
                    digests.append(None), keys.append(None)
                    continue
                own = np.unique(np.concatenate(parts))
                sig = minima(own)
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                bands = [xxhash.xxh64_intdigest(sig[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
                keys.append(np.array(bands, np.uint64).view(np.int64).tolist())
            fp = pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), fp, pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "fp", "digest", "keys"])

    body = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("body"))
    return body.mapInArrow(run, _SKETCH)


def alike(both: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of sizes ``x`` and ``y`` with ``both`` members in common have the similarity."""
    return both >= similarity * (x + y - both) - 1e-9


def forest(sets: list[np.ndarray], roots: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of a member in ``left`` and one in ``right`` that join the components ``roots`` of members, as all similar pairs would.

    Each member of ``left`` meets all of ``right`` that isn't joined to it yet, by whole sets. A pair is given only if it joins
    two components, so there are fewer pairs than members.
    """
    out, roots = [], roots.copy()
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    if not len(left) or not len(right) or not size.sum():
        return out
    known, number = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    own = [number[b - n : b] for n, b in zip(size.tolist(), ends.tolist(), strict=True)]
    mine = np.zeros(len(known), bool)
    for a in left.tolist():
        other = right[(roots[right] != roots[a]) & (size[right] >= similarity * size[a] - 1e-9) & (similarity * size[right] <= size[a] + 1e-9)]
        if not len(other) or not size[a]:
            continue
        mine[own[a]] = True
        hits = mine[np.concatenate([own[k] for k in other.tolist()])]
        both = np.add.reduceat(hits.astype(np.int64), np.cumsum(size[other]) - size[other])
        mine[own[a]] = False
        for b in other[alike(both, size[other], size[a], similarity)].tolist():
            if roots[a] != roots[b]:
                roots[roots == roots[b]] = roots[a]
                out.append((a, b))
    return out


def _blocks(open_: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: links of fingerprints that join the components of each bucket of ``open_`` (``key, digest, fp, root``), found in blocks.

    Members outside the bucket's largest component meet all members. A block holds at most about ``BLOCK`` members of either
    side, and gives fewer links than members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            out = []
            for block in t.column("block"):
                block = block.as_py()
                side = np.array([m["left"] for m in block], bool)
                _, roots = np.unique(np.array([m["root"] for m in block], np.int64), return_inverse=True)
                met = forest([np.frombuffer(m["hashes"], "<u8") for m in block], roots, np.flatnonzero(side), np.flatnonzero(~side), similarity)
                out += [(block[x]["fp"], block[y]["fp"]) for x, y in met]
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    sized = open_.join(sets.select("digest", F.octet_length("hashes").alias("bytes")), "digest")
    each = sized.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    most = F.struct("n", "root", "bytes")
    facts = each.groupBy("key").agg(F.max(most).alias("most"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    parts = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1))
    facts = facts.select("key", F.col("most.root").alias("main"), parts(F.col("n"), F.col("bytes")).alias("wide"), parts(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes")).alias("high"))
    member = open_.join(facts, "key").join(sets, "digest")
    what = [F.struct(F.lit(side).alias("left"), "fp", "root", "hashes").alias("m") for side in (True, False)]
    left = member.where("root <> main").select("key", F.pmod(F.xxhash64("digest", F.lit(1)), "high").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("wide") - 1)).alias("j"), what[0])
    right = member.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("high") - 1)).alias("i"), F.pmod(F.xxhash64("digest", F.lit(2)), "wide").alias("j"), what[1])
    blocks = left.unionByName(right).groupBy("key", "i", "j").agg(F.collect_list("m").alias("block"))
    return blocks.select("block").mapInArrow(run, "a long, b long").where("a <> b").distinct()


def _sets(asked: DataFrame, docs: DataFrame, prints: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """``digest, hashes``: the whole shingle sets of the different digests ``asked``."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([shingle_set(x.as_py(), shingle).tobytes() for x in b.column("body")], pa.binary())], names=["digest", "hashes"])

    chosen = prints.join(asked, "digest", "left_semi").groupBy("digest").agg(F.min("doc_id").alias("__chosen"))
    body = docs.select(F.col(id_col).cast("long").alias("__chosen"), text_or_empty(text_col).cast("binary").alias("body"))
    held = body.join(chosen, "__chosen").select("digest", "body").mapInArrow(sets, "digest binary, hashes binary").dropDuplicates(["digest"])
    return materialize(held, "sets")


def _checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: of pairs ``x, fp_x, y, fp_y`` of digests and fingerprints, the fingerprints of those whose whole shingle sets have the similarity."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for k, pair in enumerate(zip(t.column("one"), t.column("two"), strict=True)):
                x, y = (np.frombuffer(p.as_py(), "<u8") for p in pair)
                if alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), similarity):
                    keep.append(k)
            yield t.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    met = pairs.join(sets.select(F.col("digest").alias("x"), F.col("hashes").alias("one")), "x").join(sets.select(F.col("digest").alias("y"), F.col("hashes").alias("two")), "y")
    return met.select(F.col("fp_x").alias("a"), F.col("fp_y").alias("b"), "one", "two").mapInArrow(compare, "a long, b long").where("a <> b")


def similar_links(docs: DataFrame, prints: DataFrame, near: DataFrame, shingle: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``a, b``: the links ``near`` between fingerprints and those of texts with the similarity; ``prints`` are sketches.

    In each round a text is compared with one other: of the texts its buckets have for a centre, the one first in the order
    of a hash. That joins most groups of copies, and a bucket whose members are of one component needs no more. In the
    others what is outside the largest component is compared with all in blocks, so no link between components is lost however
    large a bucket is. Ids must tell rows apart or rows of one id hold one text.
    """
    keyed = prints.where("digest IS NOT NULL").select("digest", "fp", "keys").dropDuplicates(["digest"]).select("digest", "fp", F.explode("keys").alias("key"))
    shared = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "shared-keys")
    members = materialize(keyed.join(shared, "key", "left_semi"), "buckets")
    same = prints.where("digest IS NOT NULL").select("digest", F.col("fp").alias("a")).distinct()  # one set, other repeats
    same = same.join(same.groupBy("digest").agg(F.min("a").alias("b")), "digest").where("a <> b").select("a", "b")
    links = materialize(near.select("a", "b").unionByName(same), "near-same")

    def opened(members: DataFrame) -> DataFrame:
        """``members`` of buckets with more than one component, with their ``root``."""
        found = connected_components(links)
        all_ = members.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select("key", "digest", "fp", F.coalesce("root", "fp").alias("root"))
        mixed = all_.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
        return materialize(all_.join(mixed, "key", "left_semi"), "open-buckets")

    open_ = opened(members)
    if open_.isEmpty():
        return links
    sets = _sets(open_.select("digest").distinct(), docs, prints, shingle, id_col, text_col)
    for turn in range(STARS):
        order = F.xxhash64("digest", F.lit(turn))
        centre = open_.groupBy("key").agg(F.min(F.struct(order.alias("h"), "digest", "fp", "root")).alias("c"))
        first = open_.join(centre, "key").where("root <> c.root").groupBy("digest").agg(F.min(F.struct("c", "fp")).alias("m"))
        met = first.select(F.col("digest").alias("x"), F.col("m.fp").alias("fp_x"), F.col("m.c.digest").alias("y"), F.col("m.c.fp").alias("fp_y"))
        links = links.unionByName(materialize(_checked(met, sets, similarity), "similar"))
        open_ = opened(open_.drop("root"))
        if open_.isEmpty():
            return links
    return links.unionByName(_blocks(open_, sets, similarity))
