"""Manifests, coverage reports and rule rows as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions import paths
from codeloom.functions.identity import strip_version_prefix
from codeloom.functions.text import regex, trim


def manifest_deps(manifests: DataFrame) -> DataFrame:
    """Package manifests (path, content) as (path, name, version, ecosystem)."""
    name = paths.basename(F.col("path"))
    content = F.col("content")

    npm_schema = T.StructType(
        [
            T.StructField(k, T.MapType(T.StringType(), T.StringType()))
            for k in ("dependencies", "devDependencies")
        ]
    )
    parsed = F.from_json(content, npm_schema)
    entries = F.concat(
        *[
            F.coalesce(F.map_entries(parsed[k]), F.expr("cast(array() as array<struct<key:string,value:string>>)"))
            for k in ("dependencies", "devDependencies")
        ]
    )
    npm = (
        manifests.filter(name == "package.json")
        .select("path", F.explode(entries).alias("e"))
        .select(
            "path",
            F.col("e.key").alias("name"),
            strip_version_prefix(F.col("e.value")).alias("version"),
            F.lit("npm").alias("ecosystem"),
        )
    )

    def from_pattern(file: str, ecosystem: str, pattern: str, groups: int) -> DataFrame:
        found = [F.regexp_extract_all("content", F.lit(pattern), F.lit(g)) for g in range(1, groups + 1)]
        rows = manifests.filter(name == file).select("path", F.explode(F.arrays_zip(*found)).alias("m"))
        part = lambda i: F.col(f"m.`{i}`")
        label = part(0) if groups == 2 else F.concat(part(0), F.lit(":"), part(1))
        return rows.select(
            "path", label.alias("name"), part(groups - 1).alias("version"), F.lit(ecosystem).alias("ecosystem")
        )

    parts = [
        npm,
        from_pattern("go.mod", "Go", "(?m)" + regex(r"^\s+(\S+)\s+(v[\d.]+)"), 2),
        from_pattern("Cargo.toml", "crates.io", "(?m)" + regex(r'^(\w[\w-]*)\s*=\s*"([\d.]+)"'), 2),
        from_pattern(
            "pom.xml",
            "Maven",
            regex(r"<groupId>([^<]+)</groupId>\s*<artifactId>([^<]+)</artifactId>\s*<version>([^<]+)</version>"),
            3,
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def lcov_records(reports: DataFrame) -> DataFrame:
    """Line-coverage reports (report_id, report) as (report_id, path, line, hits).

    A record without DA rows keeps one row with a NULL line."""
    records = reports.select("report_id", F.posexplode(F.split("report", "end_of_record")).alias("record", "body"))
    lines = F.split(trim(F.col("body")), "\n")
    path = trim(F.substring(F.try_element_at(F.filter(lines, lambda l: l.startswith("SF:")), F.lit(-1)), 4, 2147483647))
    integer = lambda text: F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("long")
    rows = (
        records.withColumn("path", path)
        .filter("path IS NOT NULL AND path <> ''")
        .select("report_id", "record", "path", F.explode_outer(F.filter(lines, lambda l: l.startswith("DA:"))).alias("da"))
    )
    cells = F.split(F.substring("da", 4, 2147483647), ",")
    return rows.select(
        "report_id",
        "record",
        "path",
        integer(cells[0]).alias("line"),
        integer(F.try_element_at(cells, F.lit(2))).alias("hits"),
    )


def statement_coverage(reports: DataFrame) -> DataFrame:
    """JSON statement reports (report_id, report) as (report_id, path, statement, line, hits);
    a statement without a counter has 0 hits."""
    position = T.StructType([T.StructField("line", T.LongType())])
    entry = T.StructType(
        [
            T.StructField("statementMap", T.MapType(T.StringType(), T.StructType([T.StructField("start", position)]))),
            T.StructField("s", T.MapType(T.StringType(), T.LongType())),
        ]
    )
    files = reports.select(
        "report_id",
        F.explode(F.from_json("report", T.MapType(T.StringType(), entry))).alias("path", "coverage"),
    )
    return files.select(
        "report_id", "path", "coverage.s", F.explode("coverage.statementMap").alias("statement", "where")
    ).select(
        "report_id",
        "path",
        "statement",
        F.col("where.start.line").alias("line"),
        F.coalesce(F.try_element_at("s", F.col("statement")), F.lit(0)).alias("hits"),
    )


def rule_table(rows: DataFrame) -> DataFrame:
    """Rule rows that carry all mandatory texts; severity defaults to warning."""
    mandatory = ["id", "language", "rule", "message"]
    kept = rows.dropna(subset=mandatory)
    for column in mandatory:
        kept = kept.filter(F.col(column) != "")
    return kept.withColumn("severity", F.coalesce("severity", F.lit("warning")))
