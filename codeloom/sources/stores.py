"""Stored tables: baseline, dismissals, run history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.catalog import DEFAULTS
from codeloom.functions.identity import content_fingerprint


def baseline_rows(findings: DataFrame) -> DataFrame:
    """One entry per finding. The hash is kept only where a snippet exists: without one
    it would stand for every finding of the rule in the file."""
    digest = content_fingerprint(F.col("rule_id"), F.col("file"), F.col("code_snippet"))
    return findings.select(
        "rule_id", "file", "message", F.when(F.col("code_snippet").isNotNull(), digest).alias("content_hash")
    )


def write_baseline(findings: DataFrame, path: str) -> None:
    baseline_rows(findings).write.mode("overwrite").parquet(path)


def dismissal_upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Add dismissals; a repeated (rule, pattern, type) adds to the count and takes the
    newest time. `new` rows count 1 each."""
    keys = ["rule_id", "pattern", "pattern_type"]
    added = new.withColumn("count", F.lit(1).cast("long"))
    columns = [*keys, "count", "dismissed_at"]
    return (
        stored.select(*columns)
        .unionByName(added.select(*columns))
        .groupBy(*keys)
        .agg(F.sum("count").alias("count"), F.max("dismissed_at").alias("dismissed_at"))
    )


def keep_newest_runs(runs: DataFrame, keep: int = DEFAULTS["history_runs"]) -> DataFrame:
    """The newest runs of every repository. The rank limit prunes before the shuffle."""
    newest = Window.partitionBy("repo").orderBy(F.col("run_at").desc(), F.col("run_id").desc())
    return runs.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= keep).drop("__n")


def append_run(runs: DataFrame, run: DataFrame, keep: int | None = DEFAULTS["history_runs"]) -> DataFrame:
    """The run list with a run more; the newest `keep` of each repository, all with None."""
    whole = runs.unionByName(run)
    return whole if keep is None else keep_newest_runs(whole, keep)


def write_run_findings(findings: DataFrame, path: str) -> None:
    """Detail rows by run; rewriting a run replaces only its own partition. Rows of one
    run are spread by file so that a large run is not written by one task."""
    (
        findings.repartition("run_id", "file", "line")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )


def load_run_findings(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """Findings of one run (partition-pruned); an unknown run is empty."""
    return spark.read.parquet(path).filter(F.col("run_id") == run_id)
