"""Session settings shared by the bench, the tests and scripts."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Where tables are kept on a single machine whose session names no folder.
LOCAL_FOLDER = "/tmp/checkpoints/docloom"


def build_session(app: str = "docloom", master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow transfer and UTC timestamps.

    The number of shuffle partitions is left to the cluster; adaptive execution coalesces
    small ones. The bench and the tests set a low one for a single machine.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str):
    """One table of the test data, by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that the cluster shares, spark.checkpoint.dir; a local one only for a local master without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        base = LOCAL_FOLDER
    return f"{base.rstrip('/')}/docloom-{uuid.uuid4().hex}"
