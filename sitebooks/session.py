"""Session settings the operators are designed for.

``tune`` only touches runtime SQL settings, so it is safe on a session that a
cluster already configured; ``local_session`` is for tests and the benchmark.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    # money text parses and dates are compared in one zone everywhere
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # split a hot join key even if the split costs one more shuffle upstream
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; fall back only where it is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set: name a folder all executors share"
            )
        shared = tempfile.mkdtemp(prefix="sitebooks-checkpoint-")
    context.setCheckpointDir(shared)


def kept(df: DataFrame) -> DataFrame:
    """An intermediate result that several steps read, written once below the checkpoint folder.

    A table and no ``checkpoint()``: its size is known to the steps that join it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def local_session(app: str = "sitebooks", cpus: str | int = "*", memory: str = "8g") -> SparkSession:
    partitions = str(cpus if str(cpus).isdigit() else os.cpu_count() or 8)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
