"""Summaries, gates, trends and reports over runs and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom import catalog
from codeloom.functions import identity

_D = catalog.DEFAULTS


def _severity_counts() -> list[Column]:
    of = lambda s: F.count_if(F.col("severity") == s)
    return [
        F.count("*").alias("total_findings"),
        of("error").alias("errors"),
        of("warning").alias("warnings"),
        of("info").alias("infos"),
    ]


def run_summary(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per run. Files are counted by two partial aggregations, so a run with a
    third of all findings is pre-aggregated before it meets in one task."""
    per_file = findings.groupBy(*keys, "file").agg(*_severity_counts())
    sums = [F.sum(c).alias(c) for c in ("total_findings", "errors", "warnings", "infos")]
    return per_file.groupBy(*keys).agg(*sums, F.count("*").alias("total_files"))


def finding_breakdowns(findings: DataFrame) -> DataFrame:
    """Counts by family, by rule and by file of every run."""
    runs = findings.groupingSets(
        [["run_id", "analyzer"], ["run_id", "rule_id"], ["run_id", "file"]],
        "run_id", "analyzer", "rule_id", "file",
    ).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    by_analyzer, by_rule = F.col("g") == 0b0011, F.col("g") == 0b0101
    dimension = F.when(by_analyzer, "analyzer").when(by_rule, "rule").otherwise("file")
    name = F.when(by_analyzer, F.col("analyzer")).when(by_rule, F.col("rule_id")).otherwise(F.col("file"))
    return runs.select("run_id", dimension.alias("dimension"), name.alias("name"), "n")


def quality_gate(
    runs: DataFrame,
    max_new_errors: int = _D["max_new_errors"],
    max_new_warnings: int = _D["max_new_warnings"],
    max_total: int = _D["max_total"],
) -> DataFrame:
    """One row per failed metric of each run against the run before it in its repository.
    The window holds one repository's run history, which is capped when it is written."""
    order = Window.partitionBy("repo").orderBy("run_at", "run_id")
    delta = lambda c: F.greatest(F.lit(0), F.col(c) - F.coalesce(F.lag(c).over(order), F.lit(0)))
    measured = runs.withColumns({"new_errors": delta("errors"), "new_warnings": delta("warnings")})

    def check(metric: str, label: str, actual: Column, limit: int) -> Column:
        message = F.concat(
            F.lit(f"{label} ("), actual.cast("string"), F.lit(f") exceed threshold ({limit})")
        )
        return F.when(
            actual > limit,
            F.struct(
                F.lit(metric).alias("metric"),
                actual.cast("long").alias("actual"),
                F.lit(limit).cast("long").alias("threshold"),
                message.alias("message"),
            ),
        )

    failures = F.array(
        check("newErrors", "New errors", F.col("new_errors"), max_new_errors),
        check("newWarnings", "New warnings", F.col("new_warnings"), max_new_warnings),
        check("totalFindings", "Total findings", F.col("total_findings"), max_total),
    )
    return measured.select("repo", "run_id", F.explode(F.array_compact(failures)).alias("f")).select(
        "repo", "run_id", "f.*"
    )


def run_outcome(runs: DataFrame, failed: DataFrame, fail_on: str = "error", max_warnings: int = _D["max_warnings"]) -> DataFrame:
    """Exit code per run: 4 gate failed, 1 failing severity present, 2 too many warnings, 0."""
    present = {
        "error": F.col("errors") > 0,
        "warning": (F.col("errors") > 0) | (F.col("warnings") > 0),
        "info": F.col("total_findings") > 0,
    }[fail_on]
    gate = failed.select("repo", "run_id").distinct().withColumn("gate_failed", F.lit(True))
    code = (
        F.when(F.col("gate_failed"), 4)
        .when(present, 1)
        .when(F.col("warnings") > max_warnings, 2)
        .otherwise(0)
    )
    return runs.join(gate, ["repo", "run_id"], "left").select("repo", "run_id", code.alias("exit_code"))


def latest_runs(findings: DataFrame, runs: int = 20) -> DataFrame:
    """Findings of the newest `runs` runs; the run list is at most `runs` rows."""
    newest = findings.select("run_id").distinct().orderBy(F.col("run_id").desc()).limit(runs)
    return findings.join(F.broadcast(newest), "run_id", "left_semi")


def rule_frequency(findings: DataFrame, runs: int = 20) -> DataFrame:
    return latest_runs(findings, runs).groupBy("rule_id").agg(F.count("*").alias("n"))


def top_files(findings: DataFrame, runs: int = 20, files: int = 20) -> DataFrame:
    """The files with most findings in the latest runs; ties by name."""
    counts = latest_runs(findings, runs).groupBy("file").agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "file").limit(files)


def run_cards(runs: DataFrame) -> DataFrame:
    """Run count, findings of the latest run, rounded mean duration per repository."""
    return runs.groupBy("repo").agg(
        F.count("*").alias("total_runs"),
        F.max_by("total_findings", F.struct("run_at", "run_id")).alias("latest_findings"),
        F.floor(F.avg("duration") + 0.5).alias("avg_duration"),
    )


def finding_trend(runs: DataFrame) -> DataFrame:
    """Later half against earlier half of each repository's runs, 0.5 either way is
    stable; an odd run belongs to the later half."""
    repo = Window.partitionBy("repo")
    order = repo.orderBy("run_at", "run_id")
    halves = runs.withColumns(
        {"n": F.count("*").over(repo), "position": F.row_number().over(order)}
    ).withColumn("early", F.col("position") <= F.floor(F.col("n") / 2))
    means = halves.groupBy("repo").agg(
        F.count("*").alias("runs"),
        (
            F.avg(F.when(~F.col("early"), F.col("total_findings")))
            - F.avg(F.when(F.col("early"), F.col("total_findings")))
        ).alias("difference"),
    )
    label = (
        F.when(F.col("runs") < 2, "stable")
        .when(F.col("difference") > 0.5, "increasing")
        .when(F.col("difference") < -0.5, "decreasing")
        .otherwise("stable")
    )
    return means.select("repo", "runs", "difference", label.alias("trend"))


def recent_runs(runs: DataFrame, last: int = 10) -> DataFrame:
    """The last runs of each repository in time order, with its total number of runs."""
    newest = Window.partitionBy("repo").orderBy(F.col("run_at").desc(), F.col("run_id").desc())
    recent = runs.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= last)
    totals = runs.groupBy("repo").agg(F.count("*").alias("total_runs"))
    return recent.join(totals, "repo").orderBy("repo", F.col("back").desc())


def list_runs(findings: DataFrame) -> DataFrame:
    """Distinct runs, newest first."""
    return findings.select("repo", "run_id", "run_at", "command").distinct().orderBy(F.col("run_at").desc(), "repo")


def rule_descriptors(findings: DataFrame) -> DataFrame:
    """First message of every rule."""
    return findings.groupBy("rule_id").agg(F.min_by("message", "seq").alias("message"))


def file_report(findings: DataFrame) -> DataFrame:
    """Findings in file and line order with their rank in the file, as rows: a global
    range sort splits a file with very many findings over several tasks."""
    columns = ["run_id", "file", "line", "seq", "severity", "rule_id", "message"]
    return findings.select(*columns).orderBy("run_id", "file", "line", "seq")


# Fixed values. Icons of review comments.
SEVERITY_ICONS = {"error": ":x:", "warning": ":warning:", "info": ":information_source:"}


def review_comments(findings: DataFrame, limit: int = _D["review_comments"]) -> DataFrame:
    """The first findings of each run that have a place, formatted as comment bodies."""
    suggestion = F.when(
        F.coalesce(F.col("suggestion"), F.lit("")) != "",
        F.concat(F.lit("\n> **Suggestion:** "), F.col("suggestion")),
    ).otherwise("")
    body = F.concat(
        F.coalesce(identity.lookup(SEVERITY_ICONS, F.col("severity")), F.lit("")),
        F.lit(" **["), F.col("rule_id"), F.lit("]** "), F.col("message"), suggestion,
    )
    order = Window.partitionBy("run_id").orderBy("seq")
    return (
        findings.filter((F.col("file") != "") & (F.col("line") > 0))
        .withColumn("__n", F.row_number().over(order))
        .filter(F.col("__n") <= limit)
        .select("run_id", "seq", F.col("file").alias("path"), "line", body.alias("body"))
    )


def pr_summary(findings: DataFrame) -> DataFrame:
    """Totals and non-zero family counts of every run as (section, name, n) rows."""
    totals = run_summary(findings, ["run_id"])
    metrics = [
        ("Total findings", "total_findings"), ("Errors", "errors"), ("Warnings", "warnings"),
        ("Info", "infos"), ("Files analyzed", "total_files"),
    ]
    stacked = F.explode(
        F.array(*[F.struct(F.lit(label).alias("name"), F.col(c).alias("n")) for label, c in metrics])
    )
    rows = totals.select("run_id", F.lit("metric").alias("section"), stacked.alias("m")).select(
        "run_id", "section", "m.*"
    )
    families = (
        findings.groupBy("run_id", "analyzer")
        .agg(F.count("*").alias("n"))
        .select("run_id", F.lit("analyzer").alias("section"), F.col("analyzer").alias("name"), "n")
    )
    return rows.unionByName(families)


def cache_evict(entries: DataFrame, keep: int = _D["cache_entries"]) -> DataFrame:
    """The most recently used entries of a (key, last_access) store."""
    return entries.orderBy(F.col("last_access").desc(), "key").limit(keep)


def fix_summary(results: DataFrame, dry_run: bool = False) -> DataFrame:
    """Fixed and skipped counts; a dry run skips everything."""
    done = F.lit(False) if dry_run else F.coalesce(F.col("applied"), F.lit(False))
    return results.agg(F.count_if(done).alias("fixed"), F.count_if(~done).alias("skipped"))
