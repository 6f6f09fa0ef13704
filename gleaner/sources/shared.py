"""Stage tables: intermediate results written to the folder that all executors share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the one this session set.

    Where neither is set, a folder of the default file system; on a cluster that must not be a machine's own disk.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        sc.setCheckpointDir("/tmp/checkpoints")
        at = sc.getCheckpointDir()
        if at.startswith("file:") and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return at.rstrip("/")


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors, fixes row ids."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stages/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    for made in _SCOPES:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_stage_path"] = path
    return out


_SCOPES: list[list[str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete stage tables that no later plan reads."""
    for df in tables:
        if path := df.__dict__.get("_stage_path"):
            _delete(df.sparkSession, path)


@contextmanager
def only_result(spark: SparkSession):
    """Within it every stage table is noted; keep(df) on what it yields names those that stay, the others go at its end.

    For callers that write an operator's result themselves: the tables that result was read from are no longer needed.
    """
    made: list[str] = []
    stay: set[str] = set()
    _SCOPES.append(made)
    try:
        yield lambda df: stay.add(df.__dict__["_stage_path"])
    finally:
        _SCOPES.remove(made)
    for path in made:
        if path not in stay:
            _delete(spark, path)
