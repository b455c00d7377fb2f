"""Paths in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The application's own folder below ``spark.checkpoint.dir``, or below a temporary one where everything runs in one process (tests)."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = tempfile.mkdtemp(prefix="folio-")
        base = _OWN[context.applicationId]
    return f"{base.rstrip('/')}/folio/{context.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> bool:
    """Deletes the application's scratch tables: once the results that read them are stored."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder(spark))
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
