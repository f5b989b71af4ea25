"""Session settings, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows above which a dimension table is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 200_000


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-node session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("codeloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="codeloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and go on from there, so that a lost
    executor costs no replay of the plan behind it."""
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan_partitions(df: DataFrame) -> int | None:
    """Cores to spread a scan over when its files give fewer tasks than there are cores,
    as one large file does; None when the files already feed every core."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return cores if df.rdd.getNumPartitions() < cores else None


def spread(df: DataFrame) -> DataFrame:
    cores = scan_partitions(df)
    return df.repartition(cores) if cores else df


def has_at_most(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the table is measured to be small; otherwise leave the
    join to a shuffle, where AQE splits skewed partitions."""
    return F.broadcast(df) if has_at_most(df, rows) else df
