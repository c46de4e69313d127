"""A session with the settings the engine expects, and its work folders."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int = 8, name: str = "blockfold", **conf: str) -> SparkSession:
    """UTC, adaptive execution, Arrow; conf adds or replaces settings (dots written as double underscores)."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", shuffle_partitions)
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.ui.enabled", "false")
    if master or "SPARK_MASTER" not in os.environ:
        builder = builder.master(master or "local[*]")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


_LOCAL: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir.

    Where that is unset, a local session (as in tests) gets a temporary folder
    that goes when Python ends; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = folder = tempfile.mkdtemp(prefix="checkpoints-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{_LOCAL[context.applicationId]}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
