"""A session with the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """UTC, adaptive execution, and the state store that streaming TTL state needs."""
    b = SparkSession.builder.master(master).appName("weftline")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
