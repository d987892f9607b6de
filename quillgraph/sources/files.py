"""Records in files as DataFrames of triples."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import numbered
from ..plans.session import checkpoint
from ..schema import TRIPLES
from . import jsonld, rdfxml, turtle

#: Triples after which a reader hands on what it has.
ROWS = 5000

#: Readers by file extension; others are read as JSON-LD.
FORMATS = {"ttl": turtle.parse, "turtle": turtle.parse, "n3": turtle.parse, "nt": turtle.parse, "xml": rdfxml.parse, "rdf": rdfxml.parse, "jsonld": jsonld.parse, "json": jsonld.parse}


def parse(text: str, format_: str) -> list[jsonld.Triple]:
    return FORMATS.get(format_, jsonld.parse)(text)


def empty_graph(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TRIPLES)


def load_jsonld(spark: SparkSession, document, record_id: str = "record") -> DataFrame:
    """Triples of one JSON-LD object or list."""
    return spark.createDataFrame([(record_id, *t) for t in jsonld.parse(document)], TRIPLES)


def load_text(spark: SparkSession, text: str, format_: str, record_id: str = "record") -> DataFrame:
    return spark.createDataFrame([(record_id, *t) for t in parse(text, format_)], TRIPLES)


def parse_records(records: DataFrame, fold: Callable[[list[jsonld.Triple]], list[tuple]] | None = None, schema: str = TRIPLES) -> DataFrame:
    """``record_id, body, format`` to triples with a column ``error``, which is set on one row of each record that can't be read.

    With ``fold`` the rows are what it makes of the triples of a record, and ``schema`` is theirs after ``record_id``.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            out: list[tuple] = []
            for record, body, format_ in zip(pdf["record_id"], pdf["body"], pdf["format"], strict=True):
                try:
                    out += [(record, *t, None) for t in (parse(body, format_) if fold is None else fold(parse(body, format_)))]
                except Exception as e:  # noqa: BLE001  whatever is wrong with the record goes into its row
                    out.append((record, *[None] * (len(names) - 1), f"{type(e).__name__}: {e}"[:500]))
                if len(out) >= ROWS:
                    yield pd.DataFrame(out, columns=[*names, "error"], dtype=object)
                    out = []
            yield pd.DataFrame(out, columns=[*names, "error"], dtype=object)

    return records.select("record_id", "body", "format").mapInPandas(run, schema + ", error string")


def record_order(records: DataFrame) -> DataFrame:
    """``record_id, seq``: records numbered from one in the order of their names."""
    return numbered(records.select("record_id").distinct(), ["record_id"], 0, "seq")


def read_graphs(spark: SparkSession, path: str, pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """Triples of all files under a path, each a record, and ``record_id, error`` of those that can't be read.

    Files are parsed once. Those without triples have no rows. ``record_order`` numbers records by their names.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    records = files.select(F.col("path").alias("record_id"), F.decode("content", "UTF-8").alias("body"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("format"))
    parsed = checkpoint(parse_records(records))
    return parsed.where("error is null").drop("error"), parsed.where("error is not null").select("record_id", "error")
