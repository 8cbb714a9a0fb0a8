"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from math import ceil

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(cores: str = "8", app: str = "sievework") -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sievework.spreadScans", cores if cores.isdigit() else "8")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.icu.caseMappings.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local session without one gets a
    temporary folder; a cluster without one is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named is None and current is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="sievework-")
    if current is None:
        spark.sparkContext.setCheckpointDir(named)
    return named or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, so that no run overwrites another."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage ends in files that survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small(made: DataFrame, most: int = 50_000) -> DataFrame:
    """A stored table, counted: up to ``most`` rows travel to the other side of a
    join, so that few keys with very many rows there do not gather in few tasks."""
    return F.broadcast(made) if made.limit(most + 1).count() <= most else made


def dealt(df: DataFrame, keys: list[str], rows: int = 1_000_000) -> DataFrame:
    """``df`` dealt by keys to tasks of about ``rows`` rows, whatever the session's
    number of shuffle partitions; grouping and joining by the keys stays inside."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, ceil(df.count() / rows)), *keys)


def raw_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as its files are; how many tasks read it is a matter of row
    groups and ``spark.sql.files.maxPartitionBytes``.

    Where ``spark.sievework.spreadScans`` is set (the local session sets it, as its
    files have one row group each and would be one task), the wide tables are dealt
    to that many tasks, whatever their size. Without the setting nothing is dealt."""
    df = raw_table(spark, sf_dir, name)
    tasks = spark.conf.get("spark.sievework.spreadScans", None)
    return df.repartition(int(tasks)) if tasks and name in WIDE_TABLES else df


WIDE_TABLES = ("documents", "pages", "conversations", "lineitem", "events")
