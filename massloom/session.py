"""Session settings the library is written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "massloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by name with _ for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    every = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (every | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the one that spark.checkpoint.dir names; a temporary one only where that is unset, in local mode."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="massloom-")
    return f"{root.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def spread(rows: DataFrame, *keys: str, each: int = 20_000) -> DataFrame:
    """rows in partitions of about `each`, by keys if given: rows of which much is made are more work than their bytes tell, so tasks are counted by rows."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))
    return rows.repartition(min(n, 100_000), *keys)
