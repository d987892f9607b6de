"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import remove, scratch_path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: lineage is cut, and lost executors lose nothing.

    The files go with ``discard``, or when the Python driver ends. The JVM is asked to collect its garbage, since shuffle
    files of what has been written stay until it does.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialized = path
    spark.sparkContext._jvm.System.gc()
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of materialized tables of which nothing more is read."""
    for df in tables:
        remove(df.sparkSession, df._materialized)


def compressed(df: DataFrame, column: str = "body") -> DataFrame:
    """``df`` with a binary column compressed, as texts are moved; equal values stay equal and others different."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            k = b.schema.names.index(column)
            yield b.set_column(k, column, pa.array([z.compress(x.as_py()) for x in b.column(k)], pa.binary()))

    return df.mapInArrow(run, df.schema)


def text_or_empty(column: str):
    """The text column with null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
