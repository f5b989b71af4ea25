"""Source trees, their lines and their diffs as tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.functions.text import regex


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every readable file below `root` as (path, content), path relative to `root`."""
    spark_files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("ignoreCorruptFiles", "true")
        .text(root, wholetext=True)
    )
    full = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    # Both as the file system names them; local paths come with one or three slashes.
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    prefix = re.sub("^file:/+", "file:/", system.makeQualified(folder).toString()).rstrip("/") + "/"
    one_slash = F.regexp_replace(full, "^file:/+", "file:/")
    return spark_files.select(
        F.substring(one_slash, F.lit(len(prefix) + 1), F.length(one_slash)).alias("path"), F.col("value").alias("content")
    )


def corpus_scan(files: DataFrame) -> DataFrame:
    """Files of a known language, all marked added."""
    language = paths.detect_language(F.col("path"))
    return (
        files.withColumn("language", language)
        .filter(F.col("language").isNotNull())
        .withColumn("status", F.lit("added"))
    )


def line_explode(files: DataFrame, text: str = "content") -> DataFrame:
    """One row per line, numbered from 1; a trailing empty line is kept."""
    rest = [c for c in files.columns if c != text]
    return files.select(*rest, F.posexplode(F.split(text, "\n", -1)).alias("line", "content")).withColumn(
        "line", F.col("line").cast("long") + 1
    )


def path_filter(
    files: DataFrame, include: list[str], exclude: list[str], languages: list[str]
) -> DataFrame:
    """Analysable files: not deleted, a selected language, included and not excluded."""
    path = F.col("path")
    return files.filter(
        (F.col("status") != "deleted")
        & F.col("language").isin(*languages)
        & paths.any_glob(path, include)
        & ~paths.any_glob(path, exclude)
    )


def diff_lines(diffs: DataFrame) -> DataFrame:
    """Unified diff texts (diff_id unique, diff) as one row per changed or context line.

    Every window partitions by diff_id, that is, by one text cell.
    """
    lines = diffs.select("diff_id", F.posexplode(F.split("diff", "\n", -1)).alias("pos", "text"))
    text = F.col("text")
    header = regex(r"^diff --git a/(.+) b/(.+)$")
    hunk = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    in_diff = Window.partitionBy("diff_id").orderBy("pos")
    in_file = Window.partitionBy("diff_id", "file_no").orderBy("pos")
    in_hunk = Window.partitionBy("diff_id", "file_no", "hunk").orderBy("pos")
    whole_file = Window.partitionBy("diff_id", "file_no")
    whole_hunk = Window.partitionBy("diff_id", "file_no", "hunk")

    number = lambda group: F.regexp_extract("text", hunk, group)
    count = lambda group: F.when(number(group) == "", F.lit(1)).otherwise(number(group).try_cast("int"))
    status = (
        F.when(text.startswith("new file"), "added")
        .when(text.startswith("deleted file"), "deleted")
        .when(text.startswith("rename from"), "renamed")
    )
    of_first = lambda cond, value: F.max(F.when(cond, value)).over(whole_file)
    is_header = text.rlike(header)
    is_hunk = text.rlike(hunk)
    marked = (
        lines.withColumn("file_no", F.sum(text.startswith("diff --git").cast("int")).over(in_diff))
        .filter("file_no > 0")
        .withColumn("hunk", F.sum(text.startswith("@@").cast("int")).over(in_file))
        .withColumn("old_path", of_first(is_header, F.regexp_extract("text", header, 1)))
        .withColumn("new_path", of_first(is_header, F.regexp_extract("text", header, 2)))
        .withColumn("status", F.max_by(status, F.when(status.isNotNull() & (F.col("hunk") == 0), F.col("pos"))).over(whole_file))
        .filter("old_path IS NOT NULL AND hunk > 0")
        .withColumns(
            {
                name: F.max(F.when(is_hunk, value)).over(whole_hunk)
                for name, value in [
                    ("old_start", number(1).try_cast("int")),
                    ("old_lines", count(2)),
                    ("new_start", number(3).try_cast("int")),
                    ("new_lines", count(4)),
                ]
            }
        )
        .filter("old_start IS NOT NULL")
    )
    sign = F.substring("text", 1, 1)
    preceding = in_hunk.rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda *signs: F.coalesce(F.sum(sign.isin(*signs).cast("long")).over(preceding), F.lit(0))
    line = F.when(sign == "-", F.col("old_start") + seen("-", " ")).otherwise(F.col("new_start") + seen("+", " "))
    change = F.when(sign == "+", "added").when(sign == "-", "removed").otherwise("context")
    return (
        marked.withColumn("line", line)
        .filter(sign.isin("+", "-", " "))
        .select(
            "diff_id",
            F.when(F.col("status") == "deleted", F.col("old_path")).otherwise(F.col("new_path")).alias("path"),
            paths.detect_language(F.col("new_path")).alias("language"),
            F.coalesce("status", F.lit("modified")).alias("status"),
            "hunk", "old_start", "old_lines", "new_start", "new_lines",
            "line",
            change.alias("change_type"),
            F.substring("text", 2, 2147483647).alias("content"),
        )
    )
