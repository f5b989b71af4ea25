"""Exports as rows: JSON lines, SARIF parts, annotation lines, SBOM components.

A document of a large run does not fit one cell, so every export is one row per rule,
result or component plus one header row; a writer concatenates them file by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import identity, ordered
from codeloom.operators.history import run_summary


def _given(text: Column) -> Column:
    return F.when(text != "", text)


def findings_json(findings: DataFrame) -> DataFrame:
    """(run_id, section, doc): one `finding` object per finding, one `summary` per run."""
    finding = F.to_json(
        F.struct(
            F.col("rule_id").alias("ruleId"),
            "analyzer", "severity", "message", "file", "line",
            _given(F.col("suggestion")).alias("suggestion"),
        )
    )
    summary = F.to_json(
        F.struct(
            F.col("total_files").alias("totalFiles"),
            F.col("total_findings").alias("totalFindings"),
            "errors", "warnings", "infos",
        )
    )
    rows = findings.select("run_id", F.lit("finding").alias("section"), finding.alias("doc"))
    heads = run_summary(findings, ["run_id"]).select("run_id", F.lit("summary").alias("section"), summary.alias("doc"))
    return rows.unionByName(heads)


def sarif_rules(findings: DataFrame, help_uri: str = "") -> DataFrame:
    """Rule descriptors of every run: the first message of a rule describes it."""
    first = findings.groupBy("run_id", "rule_id").agg(F.min_by("message", "seq").alias("message"))
    return first.withColumn(
        "help_uri", F.concat(F.lit(help_uri + "#"), F.translate("rule_id", "/", "-"))
    )


def sarif_results(findings: DataFrame) -> DataFrame:
    return findings.select(
        "run_id",
        "seq",
        F.col("rule_id"),
        identity.sarif_level(F.col("severity")).alias("level"),
        "message",
        F.col("file").alias("uri"),
        F.col("line").alias("start_line"),
        F.col("col").alias("start_column"),
        "end_line",
        F.col("end_col").alias("end_column"),
    )


def findings_sarif(findings: DataFrame, help_uri: str = "") -> DataFrame:
    """(run_id, section, doc) rows of a SARIF 2.1.0 log: one object per rule and result."""
    text = lambda c: F.struct(F.col(c).alias("text"))
    rule = F.struct(
        F.col("rule_id").alias("id"), text("message").alias("shortDescription"), F.col("help_uri").alias("helpUri")
    )
    region = F.struct(
        F.col("start_line").alias("startLine"),
        F.col("start_column").alias("startColumn"),
        F.col("end_line").alias("endLine"),
        F.col("end_column").alias("endColumn"),
    )
    place = F.struct(
        F.struct(F.struct("uri").alias("artifactLocation"), region.alias("region")).alias("physicalLocation")
    )
    result = F.struct(
        F.col("rule_id").alias("ruleId"), "level", text("message").alias("message"), F.array(place).alias("locations")
    )
    rules = sarif_rules(findings, help_uri).select("run_id", F.lit("rule").alias("section"), F.to_json(rule).alias("doc"))
    results = sarif_results(findings).select("run_id", F.lit("result").alias("section"), F.to_json(result).alias("doc"))
    return rules.unionByName(results)


def finding_annotations(findings: DataFrame, title: str = "codeloom") -> DataFrame:
    """CI annotation lines; zero or missing positions are left out."""
    part = lambda label, c: F.when(
        F.coalesce(F.col(c), F.lit(0)) != 0, F.concat(F.lit(f",{label}="), F.col(c).cast("string"))
    ).otherwise("")
    line = F.concat(
        F.lit("::"), identity.annotation_level(F.col("severity")),
        F.lit(" file="), F.col("file"), F.lit(",line="), F.col("line").cast("string"),
        part("endLine", "end_line"), part("col", "col"), part("endColumn", "end_col"),
        F.lit(f",title={title} ["), F.col("rule_id"), F.lit("]::"), F.col("message"),
    )
    return findings.select("run_id", "seq", line.alias("annotation"))


def sbom_export(deps: DataFrame, order: str) -> DataFrame:
    """Component rows per document (repo): package URL, CycloneDX reference and the SPDX
    index by `order`, a unique whole number. The index is counted bucket by bucket."""
    numbered = ordered.row_position(deps, ["repo"], [order], "position")
    name, version, ecosystem = F.col("name"), F.col("version"), F.col("ecosystem")
    return numbered.select(
        "repo",
        "name",
        "version",
        identity.package_url(name, version, ecosystem).alias("purl"),
        F.concat(ecosystem, F.lit("/"), name, F.lit("@"), version).alias("bom_ref"),
        F.concat(F.lit("SPDXRef-Package-"), (F.col("position") - 1).cast("string")).alias("spdx_id"),
    )


def sbom_documents(components: DataFrame, format: str = "cyclonedx") -> DataFrame:
    """(repo, section, doc) rows: a header per document and one object per component."""
    if format == "spdx":
        reference = F.struct(
            F.lit("PACKAGE-MANAGER").alias("referenceCategory"),
            F.lit("purl").alias("referenceType"),
            F.col("purl").alias("referenceLocator"),
        )
        item = F.struct(
            F.col("spdx_id").alias("SPDXID"), "name", F.col("version").alias("versionInfo"),
            F.lit("NOASSERTION").alias("downloadLocation"), F.array(reference).alias("externalRefs"),
        )
        head = F.struct(
            F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("CC0-1.0").alias("dataLicense"),
            F.lit("SPDXRef-DOCUMENT").alias("SPDXID"),
        )
        section = "packages"
    else:
        item = F.struct(
            F.lit("library").alias("type"), "name", "version", "purl", F.col("bom_ref").alias("bom-ref")
        )
        head = F.struct(
            F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.lit(1).alias("version")
        )
        section = "components"
    rows = components.select("repo", F.lit(section).alias("section"), F.to_json(item).alias("doc"))
    heads = components.select("repo").distinct().select("repo", F.lit("document").alias("section"), F.to_json(head).alias("doc"))
    return heads.unionByName(rows)
