"""Removal of repeated byte strings with merged Burrows-Wheeler transforms.

1. Every 200-byte window is owned by one anchor: its smallest 32-byte hash, leftmost on ties. Equal windows have equal
   anchors, so windows are compared only with those of the same anchor hash. The windows of one anchor occurrence form a
   segment of text. Equal segments of one anchor are one class with a count, before anything is moved.
2. Classes of an anchor with one class only are settled by their count. The others are dealt into buckets by anchor.
3. In a bucket the text is read in symbols of 40 bytes. Each shard of segments has its own Burrows-Wheeler transform: its
   suffixes sorted once, and the symbol before each. The transforms are merged by refining an interleave, which says whose
   suffix stands where: the shards' symbols, read in its order, are dealt stably into buckets, which gives the interleave by
   one symbol more. No suffix is sorted again. Where a symbol or the interval of the tail changes, an interval begins, so the
   common prefixes come with the interleave. After five rounds, or when nothing moves, the intervals are the repeated windows.
4. An anchor with more classes than a bucket may hold is split by ranges of its windows: all windows of a range share a
   core of bytes, and ranges whose core is alone go. The others are merged as segments of their own, by core; where a core
   has too many ranges still, they are cut into shorter ones, down to single windows, which are counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, text_or_empty

LENGTH, GRAM, SYMBOL = 200, 32, 40
#: Bytes hashed at once; segments a bucket aims at, most classes of one anchor in it, and segments a shard.
BLOCK, BUCKET, MOST, SHARD = 1 << 21, 4096, 8192, 1024
#: Windows to a range, by level, of anchors with more classes.
LEVELS = (24, 4, 1)
_ODD = 0xD6E8FEB86659FD93


def rolling(x: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of all strings of ``length`` bytes: polynomial hashes joined by doubling, then mixed."""
    with np.errstate(over="ignore"):
        one = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(_ODD)
        base, out, done, part, size, power = 0x9E3779B97F4A7C15, None, 0, one, 1, 0x9E3779B97F4A7C15
        while True:
            if length & size:
                if out is None:
                    out = part
                else:  # what is done stands before this part
                    n = len(part) - done
                    out = out[:n] * np.uint64(power) + part[done : done + n]
                done += size
            if size * 2 > length:
                break
            part = part[: len(part) - size] * np.uint64(power) + part[size:]
            size, power = size * 2, power * power & 0xFFFFFFFFFFFFFFFF
        out = out ^ (out >> np.uint64(32))
        out *= np.uint64(_ODD)
        return out ^ (out >> np.uint64(29))


def segments(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, anchor, first and last window start of each run of windows with one anchor; texts lie at starts to ends."""
    none = np.zeros(0, np.int64)
    big = ends - starts >= length
    if not big.any():
        return none.astype(np.uint64), none, none, none
    h = rolling(x, gram)
    low = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    width, size = length - gram + 1, 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if width > size:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    at = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    change = np.zeros(len(at) + 1, np.int32)
    np.add.at(change, starts[big], 1)
    np.add.at(change, ends[big] - length + 1, -1)
    first = np.flatnonzero(np.cumsum(change[:-1]) > 0)  # windows inside one text
    at = at[first]
    new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(first, prepend=-2) != 1))
    last = np.append(new[1:] - 1, len(at) - 1)
    return h[at[new]], at[new], first[new], first[last]


def _anchors(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of text number, start in the text, span, offset of the anchor, anchor hash and class hash."""
    if not texts:
        return
    raw = b"".join(texts)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(size)
    starts = ends - size
    h, at, first, last = segments(np.frombuffer(raw, np.uint8), starts, ends, length)
    doc = np.searchsorted(ends, at, side="right")
    span = last - first + length
    digest = xxhash.xxh3_64_intdigest
    c = np.fromiter((digest(raw[i : i + n], seed=o) for i, n, o in zip(first.tolist(), span.tolist(), (at - first).tolist(), strict=True)), np.uint64, len(at))
    yield doc, first - starts[doc], span, at - first, h.view(np.int64), c.view(np.int64)


def _blocks(col: pa.Array, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """_anchors over a column, in blocks of bounded bytes; longer texts in parts that overlap by a window less one byte."""
    held, numbers, shifts, n = [], [], [], 0
    for k, x in enumerate(col):
        text = x.as_py()
        for at in range(0, max(1, len(text) - length + 1), BLOCK):
            part = text[at : at + BLOCK + length - 1] if len(text) > BLOCK else text
            held.append(part)
            numbers.append(k)
            shifts.append(at)
            n += len(part)
            if n >= BLOCK:
                yield from _numbered(held, numbers, shifts, length)
                held, numbers, shifts, n = [], [], [], 0
    yield from _numbered(held, numbers, shifts, length)


def _numbered(held: list[bytes], numbers: list[int], shifts: list[int], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    for doc, first, span, offset, h, c in _anchors(held, length):
        yield np.array(numbers)[doc], first + np.array(shifts)[doc], span, offset, h, c


def transform(symbols: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Suffixes of a shard in their order. ``after`` is where each goes on, -1 at an end, which is less than any symbol; ties by place.

    Ranks by one symbol become ranks by two, four and so on.
    """
    rank, hop = symbols.astype(np.int64), after
    while True:
        key = rank * (rank.max(initial=0) + 2) + np.where(hop >= 0, rank[hop] + 1, 0)
        order = np.argsort(key, kind="stable")
        if not (hop >= 0).any():
            return order
        key = key[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(np.append(0, key[1:] != key[:-1]))
        hop = np.where(hop >= 0, hop[hop], -1)


def merge(shards: list[np.ndarray], ends: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the shards' suffixes by their first ``depth`` symbols, and the interval of equal ones each is in.

    A shard is its transform: the symbol before each suffix in order, 0 for none; its first rows are the ``ends`` of its texts.
    """
    interleave = np.repeat(np.arange(len(shards)), [len(x) for x in shards])
    front = np.repeat(np.arange(len(shards)), ends)
    interval, kinds = np.zeros(len(interleave), np.int64), 1
    for _ in range(depth):
        column = np.empty(len(interleave), np.int64)
        for s, before in enumerate(shards):
            column[interleave == s] = before
        place = np.flatnonzero(column)
        place = place[np.argsort(column[place], kind="stable")]
        column, last = column[place], interval[place]
        begins = np.append(True, (column[1:] != column[:-1]) | (last[1:] != last[:-1])) if len(place) else np.zeros(0, bool)
        now = np.concatenate([front, interleave[place]])
        interval = np.concatenate([np.zeros(len(front), np.int64), np.cumsum(begins)])
        still = kinds == (kinds := int(begins.sum()) + bool(len(front))) and np.array_equal(now, interleave)
        interleave = now
        if still:
            break
    return interleave, interval


def _chains(symbol_of: np.ndarray, inside: np.ndarray, left: np.ndarray, symbol: int) -> tuple[np.ndarray, np.ndarray]:
    """How many known symbols follow one another from each place on, and up to it; ``left`` counts the strides after it in its segment."""
    on, upto = np.zeros(len(inside), np.int64), np.zeros(len(inside), np.int64)
    done = inside // symbol
    for k in range(int(max(left.max(), done.max())) + 1):
        p = np.flatnonzero(left == k)
        on[p] = np.where(symbol_of[p] > 0, (on[p + symbol] if k else 0) + 1, 0)
        p = np.flatnonzero(done == k)
        upto[p] = np.where(symbol_of[p] > 0, (upto[p - symbol] if k else 0) + 1, 0)
    return on, upto


def repeated_windows(raw: bytes, at: np.ndarray, span: np.ndarray, weight: np.ndarray, length: int = LENGTH, symbol: int = SYMBOL, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window) of all windows that occur twice or more, counting a segment ``weight`` times.

    Segments lie at ``at`` in ``raw``; ``length`` is a multiple of ``symbol``. Only chains of ``length`` bytes of symbols that
    occur twice or more go into the transforms.
    """
    none = np.zeros(0, np.int64)
    depth, n = length // symbol, span - symbol + 1
    if not len(at):
        return none, none
    owner = np.repeat(np.arange(len(at)), n)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    _, number = np.unique(rolling(np.frombuffer(raw, np.uint8), symbol)[at[owner] + inside], return_inverse=True)
    number = np.where(np.bincount(number, weight[owner])[number] > 1, number + 1, 0)
    on, upto = _chains(number, inside, (n[owner] - 1 - inside) // symbol, symbol)
    live = np.flatnonzero((number > 0) & (on + upto > depth))
    if not len(live):
        return none, none
    new = np.full(len(owner), -1)
    new[live] = np.arange(len(live))
    after, before = np.full(len(live), -1), np.zeros(len(live), np.int64)
    more = np.flatnonzero(on[live] > 1)
    after[more] = new[live[more] + symbol]
    less = np.flatnonzero(upto[live] > 1)
    before[less] = number[live[less] - symbol]
    number = number[live]
    cuts = np.searchsorted(owner[live], np.arange(0, len(at) + shard, shard))
    shards, ends, orders = [], [], []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        order = a + transform(number[a:b], np.where(after[a:b] >= 0, after[a:b] - a, -1))
        last = a + np.flatnonzero(after[a:b] < 0)
        shards.append(np.concatenate([number[last], before[order]]))
        ends.append(len(last))
        orders.append(np.concatenate([np.full(len(last), -1), order]))
    interleave, interval = merge(shards, ends, depth)
    suffix = np.empty(len(interleave), np.int64)
    for s, order in enumerate(orders):
        suffix[interleave == s] = order
    whole = suffix >= 0
    suffix, interval = live[suffix[whole]], interval[whole]
    window = on[suffix] >= depth
    suffix, interval = suffix[window], interval[window]
    often = np.bincount(interval, weight[owner[suffix]]) > 1 if len(suffix) else np.zeros(0, bool)
    suffix = suffix[often[interval]] if len(suffix) else suffix
    return owner[suffix], inside[suffix]


def _ranges(owner: np.ndarray, inside: np.ndarray, length: int) -> dict[int, list[int]]:
    """Per segment the merged byte ranges that its repeated windows cover, as from, to, from, to ..."""
    order = np.lexsort((inside, owner))
    owner, inside = owner[order], inside[order]
    if not len(owner):
        return {}
    new = np.append(True, (np.diff(owner) != 0) | (np.diff(inside) > length))
    starts = np.flatnonzero(new)
    last = np.append(starts[1:] - 1, len(owner) - 1)
    out: dict[int, list[int]] = {}
    for k, a, b in zip(owner[starts].tolist(), inside[starts].tolist(), inside[last].tolist(), strict=True):
        out.setdefault(k, []).extend((a, b + length))
    return out


def _split(rows: DataFrame, width: int, length: int) -> DataFrame:
    """Rows ``h, c, n, offset, seg, low, high`` cut into ranges of ``width`` windows, with the ``core`` and how many ranges it has, less those whose core is alone.

    ``low`` and ``high`` bound the bytes that a window has before the anchor; ranges begin at multiples of ``width``, so
    equal windows are in equal ranges, and the bytes that all windows of a range share are in each of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            took, ranges = [], []
            for r, (offset, seg, low, high) in enumerate(zip(*[b.column(k).to_pylist() for k in ("offset", "seg", "low", "high")], strict=True)):
                for x in range(low - low % width, high + 1, width):
                    core = seg[offset - x : offset - (x + width - 1) + length]
                    took.append(r)
                    ranges.append((max(low, x), min(high, x + width - 1), xxhash.xxh3_64_intdigest(core, seed=x)))
            base = b.select(["h", "c", "n", "offset", "seg"]).take(pa.array(took, pa.int64()))
            cols = list(zip(*ranges, strict=True)) or [[]] * 3
            more = [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(np.array(cols[2], np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*base.columns, *more], names=["h", "c", "n", "offset", "seg", "low", "high", "core"])

    cut = materialize(rows.mapInArrow(run, "h long, c long, n long, offset int, seg binary, low int, high int, core long"), "ranges")
    shared = cut.groupBy("h", "core").agg(F.sum("n").alias("times"), F.count(F.lit(1)).alias("ranges")).where("times > 1").select("h", "core", "ranges")
    return cut.join(shared, ["h", "core"])


def _crowded(rows: DataFrame, length: int, most: int) -> tuple[DataFrame, DataFrame]:
    """For classes of anchors that have too many for a bucket: ranges to merge (``h, core, c, n, seg, shift``), and ``h, c, covered`` of single windows."""
    rows = rows.select("h", "c", "n", "offset", "seg", (F.col("offset") - (F.length("seg") - length)).alias("low"), F.col("offset").alias("high"))
    ready = None
    for width in LEVELS[:-1]:
        cut = materialize(_split(rows, width, length), "cut-ranges")
        shift = F.col("offset") - F.col("high")
        own = F.expr(f"substring(seg, offset - high + 1, high - low + {length})")
        part = cut.where(F.col("ranges") <= most).select("h", "core", "c", "n", own.alias("seg"), shift.alias("shift"))
        ready = part if ready is None else ready.unionByName(part)
        rows = cut.where(F.col("ranges") > most).drop("core", "ranges")
    at = F.sort_array(F.collect_list(F.col("offset") - F.col("low")))
    single = _split(rows, LEVELS[-1], length).groupBy("h", "c").agg(F.flatten(F.transform(at, lambda i: F.array(i, i + length))).alias("covered"))
    return ready, single


def _pack(docs: DataFrame) -> DataFrame:
    """``doc_id, t, body``: compressed texts, as they are moved to where they are needed, with a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            text = [x.as_py() for x in b.column("body")]
            t = np.array([xxhash.xxh3_64_intdigest(x) for x in text], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(t), pa.array([z.compress(x) for x in text], pa.binary())], names=["doc_id", "t", "body"])

    return docs.mapInArrow(run, "doc_id long, t long, body binary")


def find_anchors(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``h, c, doc_id, t, start, span, offset``: one row for each run of windows with one anchor in ``doc_id, body``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, body = b.column("doc_id"), b.column("body")
            t = np.array([xxhash.xxh3_64_intdigest(x.as_py()) for x in body], np.uint64).view(np.int64)
            for k, start, span, offset, h, c in _blocks(body, length):
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), ids.take(pa.array(k)), pa.array(t[k]), pa.array(start.astype(np.int64)), pa.array(span.astype(np.int32)), pa.array(offset.astype(np.int32))], names=["h", "c", "doc_id", "t", "start", "span", "offset"])

    return docs.mapInArrow(run, "h long, c long, doc_id long, t long, start long, span int, offset int")


def _fetch(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """``h, c, n, offset, seg``: the bytes of one occurrence of each wanted class."""
    by_doc = wanted.groupBy("doc_id", "t").agg(F.collect_list(F.struct("h", "c", "n", "offset", "start", "span")).alias("own"))  # at most a document's own
    met = _pack(docs).join(by_doc.withColumnsRenamed({"doc_id": "want_id", "t": "want_t"}), F.col("doc_id").eqNullSafe(F.col("want_id")) & (F.col("t") == F.col("want_t"))).select("body", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            for body, own in zip(b.column("body"), b.column("own"), strict=True):
                text, own = z.decompress(body.as_py()), own.as_py()
                cols = [pa.array([o[k] for o in own], pa.int32() if k == "offset" else pa.int64()) for k in ("h", "c", "n", "offset")]
                seg = pa.array([text[o["start"] : o["start"] + o["span"]] for o in own], pa.binary())
                yield pa.RecordBatch.from_arrays([*cols, seg], names=["h", "c", "n", "offset", "seg"])

    return met.mapInArrow(run, "h long, c long, n long, offset int, seg binary")


def _merge_bucket(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["h", "c", "shift"])  # a row repeated with one id is fetched as often
        seg = pdf["seg"].tolist()
        span = np.fromiter(map(len, seg), np.int64, len(seg))
        owner, inside = repeated_windows(b"".join(seg), np.cumsum(span) - span, span, pdf["n"].to_numpy(np.int64), length)
        found = _ranges(owner, inside, length)
        h, c, shift = pdf["h"].to_numpy(), pdf["c"].to_numpy(), pdf["shift"].tolist()
        return pd.DataFrame({"h": h[list(found)], "c": c[list(found)], "covered": [[x + shift[k] for x in r] for k, r in found.items()]})

    return run


def covered_ranges(docs: DataFrame, length: int = LENGTH, bucket: int = BUCKET, most: int = MOST) -> DataFrame:
    """``doc_id, t, ranges``: byte ranges of texts in ``doc_id, body`` that strings of ``length`` bytes found elsewhere cover."""
    every = materialize(find_anchors(docs, length), "anchors")
    by_anchor = every.groupBy("h").agg(F.count(F.lit(1)).alias("times"), F.min("c").alias("c"), F.max("c").alias("other"), F.min("span").alias("span"))
    by_anchor = materialize(by_anchor.where("times > 1"), "repeated-anchors")
    anchors = materialize(every.join(by_anchor.select("h", (F.col("c") != F.col("other")).alias("open")).hint("merge"), "h"), "repeats")
    discard(every)
    # one class alone: all its windows are repeated, as it occurs twice or more
    settled = by_anchor.where("c = other").select("h", "c", F.array(F.lit(0), F.col("span")).alias("covered"))
    classes = anchors.where("open").groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "t", "start", "span", "offset")).alias("at"))
    classes = materialize(classes.select("h", "c", "n", "at.*"), "classes")
    of_anchor = classes.groupBy("h").agg(F.count(F.lit(1)).alias("classes"))
    fetched = materialize(_fetch(classes, docs).join(of_anchor, "h"), "segments")
    discard(classes)
    buckets = max(1, -(-fetched.count() // bucket))
    ready, single = _crowded(fetched.where(F.col("classes") > most).dropDuplicates(["h", "c"]), length, most)
    whole = fetched.where(F.col("classes") <= most).select("h", F.lit(0).cast("long").alias("core"), "c", "n", "seg", F.lit(0).alias("shift"))
    dealt = whole.unionByName(ready).withColumn("bucket", F.pmod(F.xxhash64("h", "core"), F.lit(buckets))).drop("core")
    merged = dealt.groupBy("bucket").applyInPandas(_merge_bucket(length), "h long, c long, covered array<int>")
    covered = materialize(settled.unionByName(merged).unionByName(single), "covered")
    discard(fetched)
    found = anchors.select("h", "c", "doc_id", "t", "start").join(covered.hint("merge"), ["h", "c"])
    return found.groupBy("doc_id", "t").agg(F.collect_list(F.struct("start", "covered")).alias("ranges"))  # at most a document's own


def remove(text: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The text without the ranges, the bytes removed and the number of maximal runs."""
    out, at, removed, spans, end = [], 0, 0, 0, -1
    for a, b in sorted(ranges):
        if a > end:
            spans += 1
            out.append(text[at:a])
            removed += b - a
        elif b > end:
            removed += b - end
        at = end = max(end, b)
    out.append(text[at:])
    return b"".join(out), removed, spans


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts anywhere else.

    Texts are UTF-8 bytes; strings never cross texts; overlaps count; strings are judged on the input. ``length`` is a
    multiple of 40 above 32.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``, one row for each input row; ``kept`` holds the bytes
    that remain. A null text is empty; shorter texts than ``length`` lose nothing. Of equal texts all lose all, first ones too.
    Rows repeated with one id, or with a null id, are texts of their own and repeat each other. Texts of any length are
    read whole, in overlapping blocks. Other columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("body"))
    found = covered_ranges(rows, length).withColumnsRenamed({"doc_id": "found_id", "t": "found_t"})
    joined = _pack(rows).join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("t") == F.col("found_t")), "left").select("doc_id", "body", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for body, ranges in zip(b.column("body"), b.column("ranges"), strict=True):
                text = z.decompress(body.as_py())
                own = [(x["start"] + c[k], x["start"] + c[k + 1]) for x in ranges.as_py() or [] for c in [x["covered"]] for k in range(0, len(c), 2)]
                kept, removed, spans = remove(text, own)
                out.append((len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
