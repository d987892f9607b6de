"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

BLOCK, CHUNK, STEP = 8192, 1024, 4


class SortedLists:
    """Vectors of one block with each dimension's ids in the order of its values."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        self.order = np.argsort(self.vectors, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(self.vectors, self.order, axis=0)

    def top(self, own: int, q: np.ndarray, k: int, least: int | None = None) -> list[tuple[int, int]]:
        """The k highest (score, id) without the id ``own``, ties to smaller ids; those under ``least`` may be left out.

        Lists are read from their best end, a growing number of entries at a time; vectors met are scored in full. What
        hasn't been met can't score over the bound: the inner product of the query with the values reached. Reading
        stops when the bound is below the kth score; on a tie it goes on, as a smaller id could be unmet.
        """
        n = len(self.ids)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        allowed = self.ids != own
        seen = np.zeros(n, bool)
        best_score, best_row = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, STEP
        while depth < n:
            end = min(n, depth + step) if len(up) + len(down) else n
            met = np.zeros(n, bool)
            if len(up) + len(down):
                met[self.order[n - end : n - depth, up]] = True
                met[self.order[depth:end, down]] = True
            else:
                met[:] = True
            new = np.flatnonzero(met & ~seen & allowed)
            seen |= met
            if len(new):
                score = self.vectors[new] @ q
                best_score, best_row = np.append(best_score, score), np.append(best_row, new)
                if len(best_score) > 4 * k:
                    cut = np.partition(best_score, -k)[-k]
                    keep = best_score >= cut
                    best_score, best_row = best_score[keep], best_row[keep]
                keep = np.lexsort((best_row, -best_score))[:k]
                best_score, best_row = best_score[keep], best_row[keep]
            depth, step = end, step * 2
            kth = int(best_score[-1]) if len(best_score) == k else None
            kth = max((x for x in (kth, least) if x is not None), default=None)
            if depth < n and kth is not None:
                bound = int(self.values[n - 1 - depth, up] @ q[up] + self.values[depth, down] @ q[down])
                if bound < kth:
                    break
            if seen.all():
                break
        return [(int(s), int(self.ids[r])) for s, r in zip(best_score, best_row, strict=True)]


def _packed(rows: DataFrame, key: str) -> DataFrame:
    """One row for each dim and ``key``: ids and values as bytes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, v = pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["v"].to_numpy()).astype(np.int64)
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], key: pdf[key].iloc[:1], "ids": [ids.tobytes()], "values": [v.tobytes()]})

    return rows.groupBy("dim", key).applyInPandas(run, f"dim int, {key} int, ids binary, values binary")


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """For each row that meets ``queries``, the k other rows with the highest integer inner products.

    Components become floor(scale * x); they and the products must fit a long. Vectors are dealt into blocks. A block's lists
    are sorted once, in the task that holds it, and all queries stream past it in chunks; a query's kth score in the blocks
    that a task has done bounds its search of the next. A query's best of all blocks are merged.

    Returns ``query_id, rank, vec_id, score``: rank from 1, ties to smaller ids, all rows if there are fewer than k. Vectors
    that are null or hold null or non-finite components take no part, nor do rows with a null id; vectors of another length
    than the query's don't meet it. Vectors of any length are compared whole. Rows repeated with one id count each as
    candidates of other ids, and a repeated query has the results of one. Other columns are not read. An empty table gives an
    empty result.
    """
    ok = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    good = vectors.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(queries, F.lit(False)).alias("asks"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("v"), F.size(vector_col).alias("dim"))
    good = materialize(good, "topk-vectors")
    n, m = good.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1))).first()
    blocks, chunks = max(1, -(-n // block)), max(1, -(-m // chunk))
    # a row's place hashes a salt too, so that rows of one id spread
    lists = _packed(good.select("vec_id", "v", "dim", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block")), "block")
    lists = materialize(lists, "topk-blocks")
    asked = good.where("asks").dropDuplicates(["vec_id", "dim"]).select("vec_id", "v", "dim", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int").alias("chunk"))
    # one stream a block: its vectors, then all chunks of queries of their length
    held = lists.select("dim", "block", F.lit(-1).alias("chunk"), "ids", "values")
    where = lists.select("dim", "block")  # a row for each block
    asked = _packed(asked, "chunk").join(where, "dim").select("dim", "block", "chunk", "ids", "values")
    streams = held.unionByName(asked).repartition("dim", "block").sortWithinPartitions("dim", "block", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, best = None, {}
        for b in batches:
            for x in b.to_pylist():
                ids = np.frombuffer(x["ids"], np.int64)
                vectors = np.frombuffer(x["values"], np.int64).reshape(len(ids), x["dim"])
                if x["chunk"] < 0:
                    lists = SortedLists(ids, vectors)
                    continue
                out = []
                for own, q in zip(ids.tolist(), vectors, strict=True):
                    found = lists.top(own, q, k, best.get((x["dim"], own)))
                    if len(found) == k:
                        best[x["dim"], own] = max(found[-1][0], best.get((x["dim"], own), found[-1][0]))
                    out += [(own, i, s) for s, i in found]
                cols = list(zip(*out, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    met = streams.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
