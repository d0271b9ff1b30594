"""The state store that keyed processors need."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep state in RocksDB. Asking for the session's streams starts the state
    coordinator, which keyed processors over bounded rows need as well."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.streams.active  # noqa: B018
