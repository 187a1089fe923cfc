"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "armscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew-join splitting on.

    On a cluster leave ``master`` unset and let spark-submit decide it.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for files that a query writes and reads again.

    It lies under ``spark.checkpoint.dir``, which a cluster points at shared
    storage, or else under the warehouse, which executors share as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/armscope-work"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
