"""Registration of queries with the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a function (spark, sf_dir) under ``name``; ``covers`` lists the operator ids that it exercises."""

    def add(f):
        QUERIES[name], COVERS[name] = f, covers
        if sql:
            ORACLES[name] = sql
        return f

    return add


def shared_checkpoints(spark: SparkSession) -> None:
    """A folder for checkpoints: the one that the session names, else the warehouse, which all executors share."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/quillon-checkpoints")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
