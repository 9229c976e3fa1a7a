"""Reliable lineage cuts: what several plans read is computed once and survives lost executors; and bounds of what a Python worker holds."""

from __future__ import annotations

import ctypes
import re
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch between the JVM and Python.
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """Lower the session's bound of bytes of an Arrow batch to BATCH_BYTES: a batch of the default 10 000 rows holds as many pages, so that a worker's memory would grow with its share of the table."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def tidy() -> None:
    """Give freed memory back to the system: idle workers live on, and what they keep counts against their executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def checkpoint(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder that ``spark.checkpoint.dir`` names.

    A session in one process, as in tests, may go without that setting; on a cluster it is an error, as executors share no temporary folder.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="siteloom-audit-"))
    return df.checkpoint(eager=True)
