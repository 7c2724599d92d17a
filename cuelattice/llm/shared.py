"""Helpers that the training-data operators share: tables, scratch tables, batch bounds."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bounds of one Arrow batch handed to a Python worker, so that its memory does not follow text length.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; only Spark reads it, so the path may be in any store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


@functools.lru_cache
def _own_scratch() -> str:
    return "file://" + tempfile.mkdtemp(prefix="cuelattice-")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is named: the warehouse, which is shared too; a temporary folder only where
    driver and executors are one process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] == "local":
        return _own_scratch()
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/cuelattice-scratch"


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors. Also its path."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
