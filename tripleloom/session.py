"""Session settings the operators rely on, and the shared folder for written intermediate tables."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Values every operator needs to give the same result on every cluster.
REQUIRED = {
    # duplicate keys are legal JSON; the variant reader rejects them by default
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

CHECKPOINT_DIR = "spark.checkpoint.dir"


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes up to which Spark itself would broadcast a table."""
    number, unit = re.fullmatch(r"(-?\d+)([a-z]*)", spark.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower()).groups()
    return int(number) * _UNITS[unit]


def fits(spark: SparkSession, rows: list[tuple]) -> bool:
    """Are these rows, which the driver holds, small enough to be broadcast? Spark doesn't know their size."""
    return sum(len(str(value)) for row in rows for value in row) <= broadcast_limit(spark)


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows that the driver holds as a table, to be broadcast if they fit."""
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if fits(spark, rows) else table


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    Only a local-mode session without that setting (tests) gets a temporary folder.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="tripleloom-")
        spark.conf.set(CHECKPOINT_DIR, base)
    return os.path.join(base, f"{label}-{uuid.uuid4().hex}")
