"""Cutting lineage in a place that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_COLLECTING: list[list[str]] = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of scratch data, if the session is still there."""
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session has ended; the folder is scratch space
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one on a single machine; an error elsewhere."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillgraph-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that goes when the driver ends, or when what collects paths is done."""
    path = f"{shared_dir(spark)}/quillgraph-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    for paths in _COLLECTING:
        paths.append(path)
    return path


def keep_records_together(spark: SparkSession) -> None:
    """Lets the session's joins by record and something else use data that lies by record: a setting of the planner, which changes no results."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.unionOutputPartitioning", "true")


def checkpoint(df: DataFrame, name: str = "step") -> DataFrame:
    """``df``, written once as Parquet to the shared folder and read from there, so lost executors lose nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def collecting() -> Iterator[list[str]]:
    """Gathers the paths of the scratch data that is written inside."""
    own: list[str] = []
    _COLLECTING.append(own)
    try:
        yield own
    finally:
        _COLLECTING.remove(own)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch data that is written inside, so a long-running driver doesn't fill the folder."""
    with collecting() as own:
        try:
            yield
        finally:
            for path in own:
                remove(spark, path)
