"""Session settings the operators rely on, and the shared folder of a cluster."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def use_utc(spark: SparkSession) -> SparkSession:
    """All instants are UTC; tables without a zone are read as UTC wall-clock time."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


@contextmanager
def state_partitions(spark: SparkSession):
    """For starting a stateful stream: no more state partitions than cores.

    A stream keeps the number of shuffle partitions it was started with, and opens a state store in each
    of them for every stateful step and batch; more of them than can run at once only costs time.
    """
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", min(int(before), spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="pulselake-")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder every executor can reach, for written tables and stream checkpoints.

    The cluster names its shared folder in ``spark.checkpoint.dir``. Only on one machine may that be unset: then a
    temporary folder is used. Executors elsewhere could not read it, so on a cluster it is an error.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if not named and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors can reach")
    base = named or _own_folder()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
