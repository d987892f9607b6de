"""Line deduplication by overlapping windows of three lines, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

WINDOW = 3


def text_digest(text_col: str = "text"):
    """What tells texts of one id apart."""
    return F.xxhash64(text_or_empty(text_col))


def line_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, by_text: bool = False) -> DataFrame:
    """``doc_id, pos, h1, h2``: a 128-bit hash of each run of ``window`` consecutive lines, starting at line ``pos``.

    A line break is ``\\n``. Windows with no character but white space are left out. With ``by_text`` there is a ``digest``, too.
    """
    key = ["doc_id", "digest"] if by_text else ["doc_id"]
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(text_col).alias("digest"), F.split(text_or_empty(text_col), "\n", -1).alias("lines"))
    hashed = lines.select(
        *key,
        F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(7)).alias("b"), (F.length(F.trim(F.translate(x, "\t\r\x0b\f", "    "))) > 0).alias("full"))).alias("hs"),
    )
    starts = F.when(F.size("hs") >= window, F.sequence(F.lit(0), F.size("hs") - window)).otherwise(F.array().cast("array<int>"))
    # one narrow row a window: hashes of lines, not lines, are combined
    many = hashed.select(*key, "hs", F.explode(starts).alias("pos"))
    parts = [F.col("hs")[F.col("pos") + j] for j in range(window)]
    some = parts[0]["full"]
    for p in parts[1:]:
        some = some | p["full"]
    return many.where(some).select(*key, "pos", F.xxhash64(*[p["a"] for p in parts]).alias("h1"), F.xxhash64(*[p["b"] for p in parts]).alias("h2"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, by_text: bool = False) -> DataFrame:
    """Remove every line that a later occurrence of a repeated window covers.

    Windows of ``window`` consecutive lines are compared over all documents. The first occurrence of a window, by
    (doc_id, line), stays; the lines of all later ones go, where a line under any such window goes once.

    Returns ``doc_id, n_lines, n_removed, text``, one row for each input row; the lines that stay are joined by ``\\n``. A null
    text counts as empty: one empty line. Texts of fewer lines than a window lose nothing. If all lines go, the text is
    empty. Texts of any length are read whole. Rows repeated with one id are occurrences at one place, so they count as one and get the same result; rows
    with a null id lose nothing and are never first. With ``by_text`` rows of one id and different texts are documents of
    their own, in the order of a ``digest`` of the text, which is returned after ``doc_id``. Other columns are not read. An empty table gives an empty result.
    """
    key = ["doc_id", "digest"] if by_text else ["doc_id"]
    # lines are split and hashed once; the windows are narrow
    found = materialize(line_windows(docs.where(F.col(id_col).isNotNull()), id_col, text_col, window, by_text), "line-windows")
    repeated = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*key, "pos")).alias("first")).where("n > 1").select("h1", "h2", "first")
    later = found.join(repeated, ["h1", "h2"]).where(F.struct(*key, "pos") > F.col("first"))
    # the places of a document's own later windows: bounded by its own lines
    covered = later.groupBy(*key).agg(F.collect_set("pos").alias("starts"))
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(text_col).alias("digest"), text_or_empty(text_col).alias("body"))
    out = lines.join(covered, key, "left").withColumn("lines", F.split("body", "\n", -1))
    gone = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (window - 1)))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone)
    out = out.withColumn("kept", F.when(F.col("starts").isNotNull(), kept))
    return out.select(
        *key,
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
        F.when(F.col("kept").isNull(), F.col("body")).otherwise(F.array_join(F.transform("kept", lambda i: F.col("lines")[i]), "\n")).alias("text"),
    )
