"""Session helpers: configuration for local tests and a shared scratch location."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a job needs regardless of cluster size. AQE re-plans joins and splits
# skewed shuffle partitions at run time; UTC keeps TIMESTAMP_NTZ arithmetic exact.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

# Local runs only: the driver is the whole cluster, so it gets the heap.
LOCAL_CONF = {
    "spark.driver.memory": "16g",
    "spark.driver.maxResultSize": "4g",
}


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8,
              app_name: str = "blockwatch", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    if master.startswith("local"):
        conf.update(LOCAL_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Only a local run without the
    setting gets a folder of its own: on a cluster a local path is another disk on
    every machine, so there the setting is required.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        configured = os.path.join("/tmp", "blockwatch-checkpoints")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written intermediates."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/blockwatch/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: for a table that several branches of a
    plan read and that is too large to cache."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_by_value(module_name: str) -> None:
    """Pickle the named module's functions by value, so Python tasks that use them
    (``mapInPandas`` bodies) run on executors that do not have this package installed."""
    import importlib

    from pyspark import cloudpickle

    try:
        cloudpickle.register_pickle_by_value(importlib.import_module(module_name))
    except ValueError:  # already registered
        pass
