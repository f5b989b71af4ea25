"""Incremental runs: new files are scanned once, run summaries are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.operators import line_rules, results
from codeloom.session import cut_lineage
from codeloom.sources import corpus


#: What makes two findings of a file the same, whatever their lines.
_SAME = ("rule_id", "message", "code_snippet", "occurrence")


def _new_since(found: DataFrame, paths: DataFrame, seen: DataFrame) -> DataFrame:
    """Findings that the last version of their file in `seen` (file, batch, ...) did not have;
    of several equal ones as many stay as were added."""
    versions = seen.join(paths, "file", "left_semi").groupBy("file").agg(F.max("batch").alias("batch"))
    last = seen.filter("rule_id IS NOT NULL").join(versions, ["file", "batch"]).select("file", *[F.col(c).alias(f"_{c}") for c in _SAME])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _SAME]
    return found.alias("f").join(last.withColumnRenamed("file", "_file"), [F.col("file") == F.col("_file"), *same], "left_anti")


def incremental_check(
    files: DataFrame, baseline: DataFrame | None, out: str, checkpoint: str, state: str | None = None
) -> None:
    """Scan the files (path, content) of a stream that arrived since the last call and
    append the findings the baseline does not know to `out`. The checkpoint remembers which
    files were read.

    Without `state` every arrival is reported in full. With it, a folder, the findings of each
    file's last version are kept there by path, and a file that is saved again reports only
    what that version did not have; lines may have moved. A batch writes its own `batch`
    partitions, so one that is repeated after a failure replaces its rows. Versions of one file
    that arrive in the same batch count as one.
    """
    def scanned(rows: DataFrame) -> DataFrame:
        found = line_rules.secret_scan(corpus.line_explode(rows))
        return found if baseline is None else results.baseline_filter(found, baseline)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        equal = Window.partitionBy("file", *_SAME[:3]).orderBy("line", "col")
        found = cut_lineage(scanned(batch).withColumn("occurrence", F.row_number().over(equal)))
        paths = batch.select(F.col("path").alias("file")).distinct()
        # A version without findings leaves its path, so that it is known as the last one.
        held = found.select("file", *_SAME).unionByName(paths, allowMissingColumns=True).withColumn("batch", F.lit(batch_id))
        new = found
        if batch_id > 0:
            seen = spark.read.schema(held.schema).parquet(state).filter(F.col("batch") < batch_id)
            new = _new_since(found, paths, seen)
        new = new.drop("occurrence").withColumn("batch", F.lit(batch_id))
        for rows, folder in ((new, out), (held, state)):
            (
                rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                .partitionBy("batch").parquet(folder)
            )

    if state is None:
        sink = scanned(files).writeStream.format("parquet").option("path", out)
    else:
        sink = files.writeStream.foreachBatch(write)
    sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def incremental_runs(findings: DataFrame, out: str, checkpoint: str) -> None:
    """Append one summary and its breakdown rows per run and batch of a findings stream.

    A batch writes only its own `batch` partition, so a batch that is repeated after a
    failure replaces its rows instead of adding them again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        marked = lambda df: df.withColumn("batch", F.lit(batch_id))
        save = lambda df, name: (
            marked(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch").parquet(f"{out}/{name}")
        )
        counts = batch.groupBy("run_id", "analyzer", "rule_id", "severity", "file").agg(F.count("*").alias("n"))
        save(counts, "counts")

    query = (
        findings.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stored_summaries(spark: SparkSession, out: str) -> DataFrame:
    """Run summaries over all stored batches. A file seen in several batches counts once."""
    counts = spark.read.parquet(f"{out}/counts")
    of = lambda s: F.sum(F.when(F.col("severity") == s, F.col("n")).otherwise(0))
    per_file = counts.groupBy("run_id", "file").agg(
        F.sum("n").alias("total_findings"), of("error").alias("errors"),
        of("warning").alias("warnings"), of("info").alias("infos"),
    )
    sums = [F.sum(c).alias(c) for c in ("total_findings", "errors", "warnings", "infos")]
    return per_file.groupBy("run_id").agg(*sums, F.count("*").alias("total_files"))
