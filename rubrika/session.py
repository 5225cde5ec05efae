"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession

_local_dirs: dict[str, str] = {}


def build_session(app_name: str = "rubrika", master: str | None = None, **conf) -> SparkSession:
    """A session in UTC with adaptive execution; cluster settings come from spark-submit."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session zone: prediction dates and printed times are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for one run under the cluster's ``spark.checkpoint.dir``.

    Only a local session may do without the setting, since only there do all tasks
    see the driver's disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder every executor can reach")
        if context.applicationId not in _local_dirs:
            _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="rubrika-")
        base = _local_dirs[context.applicationId]
    return f"{base.rstrip('/')}/rubrika/{purpose}-{uuid4().hex}"
