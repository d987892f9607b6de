"""Streams of records into the store."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.save import save_graph
from ..plans.session import checkpoint as keep
from ..plans.session import scratch
from ..plans.store import Store
from ..sources.files import parse_records


def record_stream(spark: SparkSession, path: str, format_: str = "jsonld") -> DataFrame:
    """New files under a path, each a whole record."""
    text = spark.readStream.format("text").option("wholetext", "true").load(path)
    return text.select(F.col("_metadata.file_path").alias("record_id"), F.col("value").alias("body"), F.lit(format_).alias("format"))


REJECTS = "record_id string, reason string"


def rejected(store: Store) -> DataFrame:
    """``record_id, reason, batch_id`` of the records that streams into the store have left out."""
    at = f"{store.path}/rejects"
    if not store._names(at):
        return store.spark.createDataFrame([], REJECTS + ", batch_id string")
    return store.spark.read.schema(REJECTS + ", batch_id string").parquet(f"{at}/*")


def ingest(records: DataFrame, store: Store, checkpoint: str, namespace: str, available_now: bool = True, **given) -> StreamingQuery:
    """Save every micro-batch of ``record_id, body, format``. A batch that is run again after a failure is applied once.

    Records that can't be read or saved are written to a table beside the store, with the reason. Scratch data goes with its
    batch.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        name = f"{checkpoint}#{batch_id}"
        with scratch(store.spark):
            parsed = keep(parse_records(batch))
            left = parsed.where("error is not null").select("record_id", F.col("error").alias("reason"))
            triples = parsed.where("error is null").drop("error")
            if not triples.isEmpty():
                out = save_graph(store, triples, namespace, batch_id=name, **given)
                left = left.unionByName(out.rejects.select("record_id", "reason"))
            # one folder a batch, written again if the batch is
            left = left.withColumn("batch_id", F.lit(name))
            if not left.isEmpty():
                left.write.mode("overwrite").parquet(f"{store.path}/rejects/batch={sha256(name.encode()).hexdigest()[:24]}")

    writer = records.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
