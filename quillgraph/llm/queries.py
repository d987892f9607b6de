"""The corpus operators as registered queries, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html_text, lang_id, line_dedup, mixing, packing, simhash, substring_dedup, token_counts, topk
from .common import table


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = mixing.own_names(docs)
    return mixing.mix(docs).select("doc_id", "source", F.col(own["tokens"]).alias("n_tokens"), F.col(own["epoch"]).alias("epoch"), F.col(own["block"]).alias("block"), F.col(own["order"]).alias("block_order"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.lang_id(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1, "op2_token_counts": op2, "op3_mixing": op3, "op4_topk": op4, "op5_line_dedup": op5,
        "op6_packing": op6, "op7_html_text": op7, "op8_simhash": op8, "op9_exact_dedup": op9, "op10_lang_id": op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_topk": """
            WITH ok AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
                        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            met AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
                    FROM ok q JOIN ok c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
            SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
            FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM met) WHERE rank <= 5""",
        "op5_line_dedup": """
            WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
            win AS (SELECT doc_id, pos, lines[pos + 1] AS a, lines[pos + 2] AS b, lines[pos + 3] AS c
                    FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS pos FROM docs WHERE len(lines) >= 3)),
            later AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS rn FROM win
                      WHERE trim(translate(a || b || c, chr(9) || chr(13) || chr(11) || chr(12), '    ')) <> '') WHERE rn > 1),
            gone AS (SELECT DISTINCT doc_id, pos + j AS pos FROM later, (SELECT unnest([0, 1, 2]) AS j)),
            each AS (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS pos FROM docs),
            kept AS (SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.pos) AS text, count(*) AS n FROM each e
                     ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id)
            SELECT d.doc_id, CAST(len(d.lines) AS BIGINT) AS n_lines, CAST(len(d.lines) - coalesce(k.n, 0) AS BIGINT) AS n_removed, coalesce(k.text, '') AS text
            FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
        "op9_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
                   sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    }
