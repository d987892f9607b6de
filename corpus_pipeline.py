"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last return the columns of their input.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import lang_id as _lang_id
from quillgraph.llm import line_dedup as _line_dedup
from quillgraph.llm import mixing as _mixing
from quillgraph.llm import packing as _packing
from quillgraph.llm import simhash as _simhash
from quillgraph.llm.common import materialize, table
from quillgraph.llm.queries import vocabulary

#: A text whose best language has less than this share of its probability is rejected, as is one without a letter.
LEAST_SCORE = 0.5


#: Columns of documents that stages read.
READ = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _whatever_columns(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that returns its input's columns, for input with columns of any other names: these are called by number inside."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = docs.select(*[F.col(f"`{c}`").alias(c if c in READ else f"x{k}") for k, c in enumerate(docs.columns)])
        return stage(spark, plain, sf_dir).toDF(*docs.columns)

    return run


@_whatever_columns
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; texts that are null, empty or without a letter go.

    If there is no row to learn a language from, all texts with a letter stay. Texts of any length are scored whole. Rows
    repeated, or with a null id, language or source, are judged by their text like any other. An empty table stays empty.
    """
    if _lang_id.learnable(docs).isEmpty():
        return docs.where(F.col("text").rlike(r"\p{L}"))
    said = _lang_id.lang_id(docs, vocabulary("piece_bpe_32k.model"), keep=True)
    return said.where((F.col("__lang") != "und") & (F.col("__score") >= LEAST_SCORE)).select(*_columns(docs))


@_whatever_columns
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines repeated from earlier ones; those of which nothing but white space is left go.

    Rows that share an id but not a text are documents of their own. Rows repeated with one id and text stay, each without the
    same lines. Those with a null id lose nothing, and a null or empty text has no lines to lose and stays. Texts of any
    length are read whole. ``n_chars``, where there is such a column, follows the text. An empty table stays empty.
    """
    key = [F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")]
    decided = _line_dedup.line_dedup(docs, by_text=True).where("n_removed > 0").select(*key, F.col("text").alias("__text")).dropDuplicates(["__id", "__digest"])
    same = (F.col("doc_id") == F.col("__id")) & (_line_dedup.text_digest() == F.col("__digest"))
    out = docs.join(decided, same, "left").where(F.col("__id").isNull() | F.col("__text").rlike(r"\S"))
    changed = {"text": F.coalesce("__text", "text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("__id").isNotNull(), F.length("__text").cast("long")).otherwise(F.col("n_chars"))
    return out.select(*[changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def _named(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``__id``, by which different documents are told apart in any later scan, and the ids that were dealt out.

    Rows with a null id, and all but one of the texts that share an id, get theirs once and are written: numbers dealt out by
    a scan change with the cores it is planned for. The second table has ``__id`` and the ``own`` id, null if there is none.
    """
    own, digest = F.col("doc_id").cast("long"), _line_dedup.text_digest()
    texts = docs.where(own.isNotNull()).groupBy(own.alias("__own")).agg(F.min(digest).alias("__first"), F.max(digest).alias("__last"))
    shared = materialize(texts.where("__first <> __last").select("__own", "__first"), "shared-ids")
    named, other = docs.where(own.isNotNull()).withColumn("__id", own), docs.where(own.isNull())
    if not shared.isEmpty():
        met = named.join(shared, F.col("__id") == F.col("__own"), "left").withColumn("__digest", digest)
        named = met.where(F.col("__own").isNull() | (F.col("__digest") == F.col("__first"))).drop("__own", "__first", "__digest")
        other = other.union(met.where(F.col("__digest") != F.col("__first")).dropDuplicates(["__id", "__digest"]).select(*_columns(docs)))
    dealt = materialize(other.withColumn("__id", F.lit(2**62) + F.monotonically_increasing_id()), "dealt-ids")
    return named.union(dealt), dealt.select("__id", own.alias("own"))


@_whatever_columns
def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id; rows repeated with one id and text become one.

    Near copies are within two bits of fingerprint or share five-word shingles to a similarity of 0.8. Rows that share an id
    but not a text are documents of their own. Those without an id come last. Texts without words, null ones included, are
    copies of each other. Texts of any length are compared whole. An empty table stays empty.
    """
    named, dealt = _named(docs)
    grouped = _simhash.near_dedup(named, "__id").select(F.col("doc_id").alias("__id"), "component_id")
    if not dealt.isEmpty():
        place = F.struct(F.coalesce("own", "__id"), "__id")
        first = grouped.join(dealt, "__id", "left").groupBy("component_id").agg(F.min(place).alias("first"))
        stays = first.select("first.__id")
    else:
        stays = grouped.where("__id = component_id").select("__id").distinct()
    return named.join(stays, "__id", "left_semi").dropDuplicates(["__id"]).select(*_columns(docs))


@_whatever_columns
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks; every one at least once.

    A null source is a source of its own. Null and empty texts have no tokens and go with their block, rows repeated with one
    id go together, and so do those with a null id. Texts are never cut. An empty table stays empty.
    """
    return _mixing.mix(docs).select(*_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed sequences, one row a piece.

    A null or empty text is the end id alone; longer texts than a sequence are cut into pieces; repeated rows and rows with a
    null id are packed each. Other columns aren't read. An empty table gives no rows.
    """
    return _packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Fingerprints, trained scores and packing have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
