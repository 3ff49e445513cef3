"""Tables in the folder that driver and executors share, to cut lineage and to be read several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_unset_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _unset_dir:
            _unset_dir.append("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        base = _unset_dir[0]
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/chronopanel-{uuid.uuid4().hex[:12]}/{name}"


def staged(df: DataFrame, name: str = "staged") -> DataFrame:
    """``df`` written as Parquet, dealt into files by its bytes, and read back."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.hint("rebalance").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
