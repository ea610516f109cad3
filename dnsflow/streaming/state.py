"""Session settings of the stateful operators."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors keep their state in RocksDB, on disk beside the executor."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
