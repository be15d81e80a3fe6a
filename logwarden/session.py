"""Session settings shared by tests, the benchmark and stand-alone jobs."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "logwarden", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session; on a cluster pass ``master=None`` and submit-time settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """Local session used by the test-suite and ``bench.py``."""
    settings = {
        "spark.sql.shuffle.partitions": str(cores if cores != "*" else 8),
        "spark.driver.memory": "12g",
        **conf,
    }
    spark = build_session("logwarden-local", f"local[{cores}]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of the shared folder named by ``spark.checkpoint.dir``.

    Only a local session (tests) may name none; it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.environ.get("LOGWARDEN_TEST_DIR") or tempfile.mkdtemp(prefix="logwarden-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that several users and lost executors cost no second computation."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
