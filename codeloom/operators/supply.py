"""Coverage, vulnerabilities and licenses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom import catalog
from codeloom.functions import paths, text
from codeloom.functions.identity import manifest_of
from codeloom.schema import findings

_D = catalog.DEFAULTS


def coverage_by_file(coverage: DataFrame) -> DataFrame:
    """(path, total, covered) of rows (path, line, hits); a NULL line counts nothing."""
    return coverage.groupBy("path").agg(
        F.count("line").alias("total"), F.count_if(F.col("hits") > 0).alias("covered")
    )


def file_coverage(coverage: DataFrame, minimum: float = _D["min_coverage"]) -> DataFrame:
    """Files covered below the minimum; an empty file counts as fully covered."""
    per_file = coverage_by_file(coverage)
    total, covered = F.col("total"), F.col("covered")
    low = per_file.filter((total > 0) & (covered / total * 100 < minimum))
    message = F.concat(
        F.lit("File coverage "), text.fixed_point(covered * 100, total, 1), F.lit(f"% is below threshold {minimum:g}%")
    )
    return findings(
        low, rule_id="coverage/below-threshold", analyzer="coverage", severity="warning",
        message=message, file="path", line=F.lit(1),
    )


def coverage_path_match(files: DataFrame, reports: DataFrame) -> DataFrame:
    """(path, report_path) of the first report row (report_path, ord) where one path ends
    with the other.

    The ends of the longer path are looked up by length and hash, at those lengths only that
    paths of the other side have; `endswith` then decides. Equal file names in many folders
    do not meet each other."""
    mine = files.select("path").distinct()
    theirs = reports.groupBy("report_path").agg(F.min("ord").alias("ord"))

    def ending(longer: DataFrame, long: str, shorter: DataFrame, short: str) -> DataFrame:
        # Lengths are numbers up to that of the longest path, so their list is short.
        sizes = [n for (n,) in shorter.select(F.char_length(short)).distinct().collect() if n is not None]
        fitting = F.filter(F.array(*map(F.lit, sorted(sizes))).cast("array<int>"), lambda n: n <= F.char_length(long))
        ends = longer.withColumn("size", F.explode(fitting))
        ends = ends.withColumn("end", F.xxhash64(F.substring(F.col(long), F.char_length(long) - F.col("size") + 1, F.col("size"))))
        whole = shorter.withColumn("size", F.char_length(short)).withColumn("end", F.xxhash64(short))
        return ends.join(whole, ["size", "end"]).filter(F.col(long).endswith(F.col(short))).select("path", "report_path", "ord")

    return (
        ending(mine, "path", theirs, "report_path").unionByName(ending(theirs, "report_path", mine, "path"))
        .groupBy("path").agg(F.min_by("report_path", F.struct("ord", "report_path")).alias("report_path"))
    )


def new_code_coverage(changes: DataFrame, coverage: DataFrame, minimum: float = _D["min_new_code_coverage"]) -> DataFrame:
    """The first five uncovered changed lines of every file whose changed lines are
    covered below the minimum. `coverage` is matched to `changes` by path."""
    changed = changes.select("path", "line").distinct()
    missed = coverage.groupBy("path", "line").agg(F.min("hits").alias("hits")).filter("hits <= 0")
    marked = changed.join(missed.select("path", "line", F.lit(True).alias("uncovered")), ["path", "line"], "left")
    measured = coverage.select("path").distinct()
    low = (
        marked.groupBy("path")
        .agg(F.count("*").alias("changed"), F.count_if("uncovered").alias("missed"))
        .join(measured, "path", "left_semi")
        .filter((F.col("changed") - F.col("missed")) / F.col("changed") * 100 < minimum)
    )
    first = Window.partitionBy("path").orderBy("line")
    shown = (
        marked.filter("uncovered").withColumn("i", F.row_number().over(first)).filter("i <= 5")
        .join(low, "path", "left_semi")
    )
    return findings(
        shown, rule_id="coverage/uncovered-new-code", analyzer="coverage", severity="warning",
        message=F.concat(F.lit("New/changed code at line "), F.col("line").cast("string"), F.lit(" is not covered by tests")),
        file="path", line="line",
    )


def vulnerability_join(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies (name, version, version_key, ecosystem) inside an advisory's range
    (advisory_id, name, ecosystem, introduced, fixed, summary); a NULL `fixed` is open.
    `version_key` orders versions: a number or an array of numbers on both sides."""
    version = F.col("version_key")
    affected = (
        deps.join(advisories, ["name", "ecosystem"])
        .filter((F.col("introduced") <= version) & (F.col("fixed").isNull() | (version < F.col("fixed"))))
    )
    return findings(
        affected, rule_id="dependency/known-vulnerability", analyzer="dependencies", severity="error",
        message=F.concat(
            F.col("name"), F.lit("@"), F.col("version"), F.lit(": "), F.col("summary"),
            F.lit(" ("), F.col("advisory_id"), F.lit(")"),
        ),
        file=manifest_of(F.col("ecosystem")), line=F.lit(1),
    )


def version_key(version: Column) -> Column:
    """Numeric parts of a dotted version, comparable as an array."""
    return F.transform(
        F.regexp_extract_all(F.regexp_extract(version, r"^v?([\d.]+)", 1), F.lit(r"\d+"), F.lit(0)),
        lambda part: part.cast("long"),
    )


def license_policy(
    deps: DataFrame, licenses: DataFrame, allow: list[str], deny: list[str], severity: str = "warning"
) -> DataFrame:
    """Denied licenses are errors; with a non-empty allow list all others that are not on
    it get the configured severity. Unknown licenses are skipped; only list entries with
    `*` are globs."""
    name = F.col("license")

    def on_list(entries: list[str]) -> Column:
        result = name.isin(*[e for e in entries if "*" not in e])
        return result | paths.any_glob(name, [e for e in entries if "*" in e])

    denied = on_list(deny) if deny else F.lit(False)
    stranger = ~on_list(allow) if allow else F.lit(False)
    label = F.concat(F.col("name"), F.lit("@"), F.col("version"))
    judged = (
        deps.join(licenses.filter("license IS NOT NULL AND license <> ''"), ["name", "ecosystem"])
        .withColumn(
            "verdict",
            F.when(denied, F.struct(F.lit("error").alias("severity"), F.concat(label, F.lit(" uses denied license: "), name).alias("message")))
            .when(stranger, F.struct(F.lit(severity).alias("severity"), F.concat(label, F.lit(" uses license '"), name, F.lit("' not in allowed list")).alias("message"))),
        )
        .filter("verdict IS NOT NULL")
    )
    return findings(
        judged, rule_id="license/incompatible-license", analyzer="licenses", severity=F.col("verdict.severity"),
        message=F.col("verdict.message"), file=manifest_of(F.col("ecosystem")), line=F.lit(1),
    )
