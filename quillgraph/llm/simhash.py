"""SimHash near-duplicate detection with a generalised pigeonhole index.

Each text gets a 64-bit fingerprint from its word shingles. Bits are grouped into partitions, correlated bits together;
a partition i has a threshold T_i >= -1 with sum(T_i + 1) = tau + 1, so two fingerprints within tau bits are within T_i in
some partition. Thresholds are chosen by dynamic programming on estimated candidate counts. The index holds each
fingerprint under its exact partition values; probes enumerate values within T_i bits; candidates are verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, text_or_empty
from .components import connected_components

BITS, SEED, SHINGLE, DISTANCE = 64, 42, 3, 2
#: A partition value shared by more fingerprints than this is partitioned again by the other bits, down to so few of these.
BUCKET, FEW_BITS = 64, 12
#: Relative cost of one probe, with one verified candidate as the unit.
PROBE_COST = 2.0


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of UTF-8 bytes, repeats included, in arrays of at most 65,536; none without words."""
    words = text.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(1, len(words) - shingle + 1)
    last = min(shingle, len(words)) - 1
    hashed = xxhash.xxh64_intdigest
    for at in range(0, n, 65536):
        upto = min(n, at + 65536)
        yield np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[at:upto].tolist(), ends[at + last : upto + last].tolist(), strict=True)], "<u8")


def fold(hashes: Iterable[np.ndarray]) -> int:
    """The SimHash of shingle hashes: the bits set in over half of them."""
    count, n = np.zeros(BITS, np.int64), 0
    for h in hashes:
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(sum(1 << b for b in np.flatnonzero(2 * count > n).tolist()))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of UTF-8 bytes: ASCII lower case, words at ASCII white space, shingles hashed by XXH64."""
    return fold(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), shingle) for x in b.column("body")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    body = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("body"))
    return body.mapInArrow(run, "doc_id long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints in ``fp`` and the 64 x 64 matrix of how often two bits are set together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = b.column("fp").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(x, axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        flat = np.append(both.astype(np.int64).ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 4097 rows
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r["cell"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def arrange(n: int, both: np.ndarray, parts: int, among: Iterable[int] = range(BITS)) -> list[list[int]]:
    """Bits in ``parts`` partitions of about equal size, each grown from the bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    dev = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(dev, dev)
    np.fill_diagonal(corr, 0)
    free, out = set(among), []
    bits = len(free)
    for k in range(parts):
        size = (bits * (k + 1)) // parts - (bits * k) // parts
        group = [max(free, key=lambda b: (corr[b, list(free)].sum(), -b))]
        free.discard(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def allocate(n: int, both: np.ndarray, parts: list[list[int]], distance: int) -> tuple[float, list[int]]:
    """The least estimated cost and the thresholds that have it: dynamic programming over partitions."""
    p = np.diag(both) / max(n, 1)
    apart = 2 * p * (1 - p)
    costs = []
    for bits in parts:
        near = np.zeros(distance + 1)  # of two fingerprints: chance of exactly t differing bits here
        near[0] = 1
        for b in bits:
            near[1:] = near[1:] * (1 - apart[b]) + near[:-1] * apart[b]
            near[0] *= 1 - apart[b]
        probes = np.cumsum([comb(len(bits), t) for t in range(distance + 1)])
        costs.append([0.0, *(PROBE_COST * n * probes + 0.5 * float(n) * n * np.cumsum(near))])
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(np.inf, [])] * (distance + 1)
    for cost in costs:
        best = [min((best[u - t][0] + cost[t], [*best[u - t][1], t - 1]) for t in range(u + 1)) for u in range(distance + 2)]
    return best[distance + 1]


def plan(n: int, both: np.ndarray, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Partitions and thresholds of the least estimated cost among 1 to ``distance`` + 2 partitions."""
    options = []
    for m in range(1, distance + 3):
        parts = arrange(n, both, m)
        options.append((*allocate(n, both, parts, distance), parts))
    _, thresholds, parts = min(options, key=lambda x: x[0])
    return [(bits, t) for bits, t in zip(parts, thresholds, strict=True) if t >= 0]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _flips(bits: list[int], most: int) -> list[int]:
    """XOR masks of at most ``most`` of the given bits."""
    out, last = [0], [(0, -1)]
    for _ in range(most):
        last = [(m | 1 << b, k) for m, at in last for k, b in enumerate(bits) if k > at]
        out += [m for m, _ in last]
    return out


def _within(pairs: DataFrame, distance: int) -> DataFrame:
    """Of candidates ``fp, other`` the links ``a < b``."""
    near = pairs.where((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance))
    return near.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def _values(rows: DataFrame, entries: list[list[tuple[int, int, int]]]) -> DataFrame:
    """``path, key, fp, flipped``: rows ``path, key, fp`` under each of their path's (new path, mask, flip)."""
    table = rows.sparkSession.createDataFrame([(k, *e) for k, es in enumerate(entries) for e in es], "path int, to int, mask long, flip long")
    value = F.col("fp").bitwiseXOR(F.col("flip")).bitwiseAND(F.col("mask"))
    each = rows.join(F.broadcast(table), "path")  # as many entries as the partitions have, whatever the data
    return each.select(F.col("to").alias("path"), F.xxhash64("key", "to", value).alias("key"), "fp", (F.col("flip") != 0).alias("flipped"))


def _inside(crowd: DataFrame, rest: list[list[int]], distance: int, bucket: int, pick: Callable[[list[int]], list[list[int]]]) -> list[DataFrame]:
    """Links inside crowded values: rows ``path, key, fp``, where fingerprints of one key agree in all bits but ``rest[path]``.

    The bits left are partitioned again, with ``distance`` + 1 partitions and thresholds of zero; values that are crowded still
    go on with what is left then. Few bits are one partition with the whole threshold, whose values are single fingerprints.
    """
    out = []
    while not crowd.isEmpty():
        index, probe, after = [], [], []
        for bits in rest:
            if len(bits) <= FEW_BITS:
                own = [(len(after), bits, distance)]
                after.append([])
            else:
                own = [(len(after) + k, part, 0) for k, part in enumerate(pick(bits))]
                after += [[b for b in bits if b not in part] for _, part, _ in own]
            index.append([(to, _mask(part), 0) for to, part, _ in own])
            probe.append([(to, _mask(part), _signed(f)) for to, part, t in own for f in _flips(part, t)])
        held, asked = _values(crowd, index), _values(crowd, probe)
        count = held.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n"))
        last = [k for k, bits in enumerate(after) if not bits]
        large = count.where(~F.col("path").isin(last)).where((F.col("n") > bucket) & (F.col("n") > 1)).select("path", "key")
        small = count.where(F.col("path").isin(last) | ((F.col("n") > 1) & (F.col("n") <= bucket))).select("path", "key")
        pairs = held.join(small, ["path", "key"], "left_semi").select("path", "key", "fp").join(asked.select("path", "key", F.col("fp").alias("other"), "flipped"), ["path", "key"])
        out.append(_within(pairs.where(F.col("flipped") | (F.col("fp") < F.col("other"))), distance))
        crowd, rest = materialize(held.join(large, ["path", "key"], "left_semi").select("path", "key", "fp").distinct(), "crowded"), after
    return out


def links(fps: DataFrame, chosen: list[tuple[list[int], int]], distance: int = DISTANCE, bucket: int = BUCKET, pick: Callable[[list[int]], list[list[int]]] | None = None) -> DataFrame:
    """``a, b``: all pairs of distinct fingerprints ``fp`` within ``distance`` bits.

    A partition value of at most ``bucket`` fingerprints is joined to its probes and verified pair by pair. Fingerprints in
    or probing a larger one are partitioned anew by their other bits, as ``pick`` deals these (unset, evenly), so that a
    value that very many share is never paired with itself.
    """
    pick = pick or (lambda bits: [bits[k :: distance + 1] for k in range(distance + 1)])
    masks = [_mask(bits) for bits, _ in chosen]
    index = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("path"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])).alias("x")).select("fp", "x.*")
    near = [F.struct(F.lit(k).alias("path"), F.col("fp").bitwiseXOR(F.lit(_signed(f))).bitwiseAND(F.lit(masks[k])).alias("key")) for k, (bits, t) in enumerate(chosen) for f in _flips(bits, t)]
    probe = fps.select(F.col("fp").alias("other"), F.explode(F.array(*near)).alias("x")).select("other", "x.*")
    held = index.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n"))
    large = held.where((F.col("n") > bucket) & (F.col("n") > 1)).select("path", "key")
    small = held.where((F.col("n") > 1) | F.lit(any(t for _, t in chosen))).where((F.col("n") <= bucket) | (F.col("n") == 1)).select("path", "key")
    pairs = [_within(index.join(small, ["path", "key"], "left_semi").join(probe, ["path", "key"]), distance)]
    crowd = materialize(probe.join(large, ["path", "key"], "left_semi").select("path", "key", F.col("other").alias("fp")).distinct(), "crowded")
    pairs += _inside(crowd, [[b for b in range(BITS) if b not in bits] for bits, _ in chosen], distance, bucket, pick)
    return reduce(DataFrame.unionByName, pairs).distinct()


def near_links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``links`` with partitions and thresholds planned from the fingerprints' own statistics."""
    n, both = bit_statistics(fps)
    return links(fps, plan(n, both, distance), distance, pick=lambda bits: arrange(n, both, distance + 1, bits))


def _grouped(prints: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` from the links between fingerprints."""
    found = connected_components(edges)
    grouped = classes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "top", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("top").alias("component_id"))
    by_print = grouped.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of whole texts and the groups they form when those within two differing bits link.

    Returns ``doc_id, fingerprint, component_id``, one row for each input row. The component id is the smallest doc_id
    reachable over links, the document's own included. A text of fewer words than a shingle is hashed whole; a text
    without words (null, empty, white space) has fingerprint zero, which links like any other. Rows repeated with one id
    stay as rows. A row with a null id belongs to the component of its fingerprint; that is null if no row of the
    component has an id. Other columns are not read. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("top")), "fingerprint-classes")
    return _grouped(prints, classes, near_links(classes.select("fp")))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """As ``simhash_dedup``, where texts also link whose sets of word shingles have the Jaccard similarity.

    Texts without words link to each other only through their fingerprint. Rows of one id are expected to hold one text.
    """
    from .similar import similar_links, sketches

    held = materialize(sketches(docs, shingle, id_col, text_col), "sketches")
    prints = materialize(held.select("doc_id", "fp"), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("top")), "fingerprint-classes")
    near = materialize(near_links(classes.select("fp")), "near")
    edges = materialize(similar_links(docs, held, near, shingle, similarity, id_col, text_col), "near-all")
    discard(held)
    return _grouped(prints, classes, edges)
