"""Session defaults and the few settings the jobs read from it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

HOT_ROWS_KEY = "spark.ledgerlens.hotKeyRows"
HOT_ROWS_DEFAULT = 1_000_000
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
COMPILED_BYTES = 8000


def build_session(app: str = "ledgerlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job relies on: UTC, AQE with skew-join handling, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def hot_key_rows(spark: SparkSession, override: int | None = None) -> int:
    """Rows one entity may hold before its windows are split over several tasks."""
    if override is not None:
        return int(override)
    return int(spark.conf.get(HOT_ROWS_KEY, str(HOT_ROWS_DEFAULT)))


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``; a temp folder in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    created = tempfile.mkdtemp(prefix="ledgerlens-")
    spark.conf.set("spark.checkpoint.dir", created)
    return created


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Plans that are run inside keep whole-stage code only where the JVM compiles it.

    A projection of many columns makes one method beyond the 8,000 bytes up to which HotSpot compiles; it would be
    interpreted for every row. Without whole-stage code Spark splits such a projection into small methods.
    """
    before = spark.conf.get(METHOD_LIMIT)
    spark.conf.set(METHOD_LIMIT, str(min(int(before), COMPILED_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(METHOD_LIMIT, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage: write the rows below the shared folder and read them back.

    A written table survives executor loss, is column-pruned when read again, and gives the planner
    its real size.
    """
    path = work_dir(df.sparkSession, "table")
    with small_methods(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
