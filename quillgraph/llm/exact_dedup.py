"""Exact deduplication against immutable snapshots, screened by static binary-fuse filters.

Rows are in one of two sets: the snapshot (kept from earlier batches) and the incoming batch. Each set is grouped by
whole text, so equal rows of one batch meet without any filter, and a text that a third of the rows share is
pre-aggregated before the shuffle. The snapshot's digests are dealt into buckets of about ``bucket_keys`` keys, with one
3-wise binary-fuse filter each (about 1.13 bytes a key, false positives 1/256). Incoming digests are probed against
their bucket's filter; only positives are joined to the exact groups, where whole texts are compared. Texts are moved in
compressed form; where two forms of one digest aren't the same bytes, the texts themselves are compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import compressed, discard, materialize, text_or_empty

BUCKET_KEYS = 200_000


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """The splitmix64 finaliser, vectorised."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class FuseFilter:
    """A 3-wise binary-fuse filter of 8-bit fingerprints over distinct 64-bit keys."""

    def __init__(self, seed: int, segment: int, segments: int, table: np.ndarray):
        self.seed, self.segment, self.segments, self.table = seed, segment, segments, table

    @staticmethod
    def places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(keys, seed)
        start = ((h >> np.uint64(40)) * np.uint64(segments)) >> np.uint64(24)
        mask = np.uint64(segment - 1)
        inside = [h & mask, (h >> np.uint64(13)) & mask, (h >> np.uint64(26)) & mask]
        where = [((start + np.uint64(j)) * np.uint64(segment) + inside[j]).astype(np.int64) for j in range(3)]
        mark = (_mix(h, 77) & np.uint64(0xFF)).astype(np.uint8)
        return np.stack(where, axis=1) if len(keys) else np.zeros((0, 3), np.int64), mark

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(np.asarray(keys, np.uint64))
        n = len(keys)
        segment = int(min(8192, max(4, 2 ** int(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2))) if n > 1 else 2.0
        for seed in range(100):
            segments = max(1, int(np.ceil(n * factor / segment)) - 2)
            size = (segments + 2) * segment
            where, mark = cls.places(keys, seed, segment, segments)
            count = np.bincount(where.ravel(), minlength=size)
            own = np.zeros(size, np.int64)
            for j in range(3):
                np.bitwise_xor.at(own, where[:, j], np.arange(n))
            rounds, left = [], n
            single = np.flatnonzero(count == 1)
            while len(single):
                key, first = np.unique(own[single], return_index=True)
                rounds.append((key, single[first]))
                left -= len(key)
                touched = where[key].ravel()
                np.subtract.at(count, touched, 1)
                np.bitwise_xor.at(own, touched, np.repeat(key, 3))
                touched = np.unique(touched)
                single = touched[count[touched] == 1]
            if left == 0:
                table = np.zeros(size, np.uint8)
                for key, place in reversed(rounds):
                    w = where[key]
                    rest = table[w[:, 0]] ^ table[w[:, 1]] ^ table[w[:, 2]] ^ table[place]
                    table[place] = mark[key] ^ rest
                return cls(seed, segment, segments, table)
            factor *= 1.02
        raise ValueError("no filter could be built")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        where, mark = self.places(np.asarray(keys, np.uint64), self.seed, self.segment, self.segments)
        return (self.table[where[:, 0]] ^ self.table[where[:, 1]] ^ self.table[where[:, 2]]) == mark


def _keys(digests: pd.Series) -> np.ndarray:
    return np.array([int(x[:16], 16) for x in digests], np.uint64)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    f = FuseFilter.build(_keys(pdf["digest"]))
    return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "seed": [f.seed], "segment": [f.segment], "segments": [f.segments], "filter": [f.table.tobytes()]})


def _probe(incoming: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if not len(incoming) or not len(filters):
        return pd.DataFrame({"digest": pd.Series([], dtype=str)})
    x = filters.iloc[0]
    f = FuseFilter(int(x["seed"]), int(x["segment"]), int(x["segments"]), np.frombuffer(x["filter"], np.uint8))
    return incoming.loc[f.contains(_keys(incoming["digest"])), ["digest"]]


def build_filters(digests: DataFrame, buckets: int) -> DataFrame:
    """One filter a bucket over the distinct hex digests in column ``digest``."""
    dealt = digests.select("digest", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket"))
    return dealt.groupBy("bucket").applyInPandas(_build, "bucket int, seed int, segment int, segments int, filter binary")


def screen(digests: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The digests that their bucket's filter holds to be known (a superset of those that are)."""
    dealt = digests.select("digest", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket"))
    return dealt.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(_probe, "digest string")


@F.pandas_udf(BooleanType())
def _one_text(forms: pd.Series) -> pd.Series:
    """Whether compressed forms hold one text; true for null."""
    z = zstandard.ZstdDecompressor()
    return forms.map(lambda f: f is None or len({z.decompress(x) for x in f}) == 1)


def _same(forms: Column) -> Column:
    """An array of compressed forms, at least one, that are checked to hold one text: the job fails if they don't.

    Equal forms are of equal texts, so only arrays with different ones are sent to be compared.
    """
    return F.when(_one_text(F.when(F.size(F.array_distinct(forms)) > 1, forms)), forms[0]).otherwise(F.raise_error(F.lit("two texts have one SHA-256 digest")).cast("binary"))


def exact_dedup(docs: DataFrame, snapshot: Column | None = None, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Of equal texts the row with the largest id stays.

    ``snapshot`` is a boolean condition over ``docs``: true rows are the snapshot, the rest the incoming batch; unset, a
    hash of the id halves the rows. The result doesn't depend on it.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``, one row for each input row. A null text counts as empty
    and equals other empty texts. Texts of any length are compared whole. A row repeated with the same id counts in
    group_size each time, and each of its rows has the same result. Null ids are kept as rows; a group of null ids alone
    has a null keep_id and kept false. Other columns are not read, so their names can't clash. An empty table gives an
    empty result. Two texts with one SHA-256 digest would fail the job rather than merge.
    """
    if snapshot is None:
        snapshot = F.pmod(F.xxhash64(F.col(id_col)), F.lit(2)) == 0
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("body"), F.coalesce(snapshot, F.lit(False)).alias("old"))
    rows = rows.withColumn("digest", F.sha2("body", 256))
    packed = compressed(rows.select("doc_id", F.col("body").cast("binary").alias("body"), "old", "digest"))
    groups = packed.groupBy("old", "digest").agg(F.collect_set("body").alias("forms"), F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
    groups = materialize(groups.select("old", "digest", _same(F.col("forms")).alias("body"), "n", "top"), "exact-groups")
    old, new = groups.where("old").drop("old"), groups.where("not old").drop("old")
    # enough buckets for either side, so that no task has more digests than a bucket should, whatever the snapshot is
    buckets = max(1, -(-max(old.count(), new.count()) // bucket_keys))
    filters = build_filters(old.select("digest"), buckets)
    positive = materialize(screen(new.select("digest"), filters, buckets), "exact-positive")
    known = new.join(positive.hint("merge"), "digest", "left_semi").select("digest", F.col("body").alias("new_body"), F.col("n").alias("new_n"), F.col("top").alias("new_top"))
    matched = known.hint("merge").join(old, "digest").select("digest", _same(F.array("body", "new_body")).alias("body"), (F.col("n") + F.col("new_n")).alias("n"), F.greatest("top", "new_top").alias("top"))
    matched = materialize(matched.where(F.col("body").isNotNull()).drop("body"), "exact-matched")
    alone = [x.select("digest", "n", "top").join(matched.select("digest"), "digest", "left_anti") for x in (old, new)]
    merged = materialize(matched.unionByName(alone[0]).unionByName(alone[1]), "exact-merged")
    discard(groups, positive, matched)
    out = rows.select("doc_id", "digest").join(merged, "digest")
    return out.select(
        "doc_id", F.col("top").alias("keep_id"), F.col("n").alias("group_size"), F.coalesce(F.col("doc_id") == F.col("top"), F.lit(False)).alias("kept"), F.col("digest").alias("text_sha256")
    )
