"""Whole runs: from tables of files, nodes and reports to findings, summary and gate."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom import catalog
from codeloom.operators import derive, duplicates, graph, history, line_rules, nodes, results, supply, taint
from codeloom.operators.registry import Detector, DetectorRegistry, Tables
from codeloom.session import cut_lineage
from codeloom.sources import corpus, reports

_D = catalog.DEFAULTS


@dataclass
class Settings:
    """Configuration of a run; every field has the usual default."""

    include: list[str] = field(default_factory=lambda: ["**/*"])
    exclude: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=lambda: list(catalog.LANGUAGES))
    enabled: dict[str, bool] = field(default_factory=dict)
    keyword: str = "scan-ignore"
    custom_patterns: list[tuple[str, str, str]] = field(default_factory=list)
    comment_ratio: float = _D["comment_ratio"]
    naming: dict[str, str] = field(default_factory=lambda: dict(nodes.DEFAULT_NAMING))
    naming_per_language: dict[str, dict[str, str]] = field(default_factory=dict)
    similarity: float = _D["similarity"]
    taint_cross_file: bool = False
    layers: list[tuple[str, list[str]]] = field(default_factory=list)
    layer_rules: list[tuple[str, list[str], list[str]]] = field(default_factory=list)
    impact_depth: int = _D["impact_depth"]
    max_cyclomatic: int = _D["max_cyclomatic"]
    max_cognitive: int = _D["max_cognitive"]
    entry_points: list[str] = field(default_factory=list)
    min_coverage: float = _D["min_coverage"]
    min_new_code_coverage: float = _D["min_new_code_coverage"]
    allowed_licenses: list[str] = field(default_factory=list)
    denied_licenses: list[str] = field(default_factory=list)


def _union(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _line_arrays(lines: DataFrame) -> DataFrame:
    """(path, lines) of the changed lines: at most the lines of one file per row."""
    return lines.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "content"))).alias("lines"))


def families(settings: Settings) -> dict[str, tuple[list[str], Detector]]:
    """Family -> (tables it needs, detector), in merge order.

    `lines` are the changed lines of the selected files, `nodes` all their nodes,
    `changed` the changed (path, line) rows or None for a whole-tree run.
    """
    s = settings

    def on_changed(found: DataFrame, tables: Tables) -> DataFrame:
        if tables.get("changed") is None:
            return found
        return line_rules.changed_line_semi(found, tables["changed"], "file")

    def security(t: Tables) -> DataFrame:
        parts = [line_rules.secret_scan(t["lines"])]
        if s.custom_patterns:
            parts.append(line_rules.custom_pattern_scan(t["lines"], s.custom_patterns))
        if "nodes" in t:
            n = t["nodes"]
            of_nodes = [f(n) for f in (nodes.sql_injection, nodes.xss_sinks, nodes.eval_calls, nodes.unsafe_regex)]
            parts += [on_changed(p, t) for p in of_nodes]
        return _union(parts)

    def smells(t: Tables) -> DataFrame:
        parts = [line_rules.comment_ratio(t["lines"], s.comment_ratio), line_rules.copy_paste_blocks(_line_arrays(t["lines"]))]
        if "nodes" in t:
            n = t["nodes"]
            of_nodes = [
                f(n) for f in (
                    graph.unused_imports, nodes.verbose_error_handling, nodes.type_assertion_any, nodes.proximity_cluster
                )
            ]
            parts += [on_changed(p, t) for p in of_nodes]
        return _union(parts)

    def conventions(t: Tables) -> DataFrame:
        chosen = (s.naming, s.naming_per_language)
        parts = [nodes.file_naming(t["files"], *chosen)]
        if "nodes" in t:
            checks = (nodes.function_naming, nodes.function_naming_multilang, nodes.class_naming, nodes.constant_naming)
            parts += [on_changed(f(t["nodes"], *chosen), t) for f in checks]
        return _union(parts)

    def clones(t: Tables) -> DataFrame:
        blocks = t["blocks"]
        if t.get("changed") is not None:
            blocks = duplicates.changed_block_semi(blocks, t["changed"])
        found = duplicates.clone_findings(duplicates.structural_clones(blocks))
        if "tokens" not in blocks.columns:
            return found
        return found.unionByName(duplicates.similar_findings(duplicates.similar_links(blocks, s.similarity)))

    def tainted(t: Tables) -> DataFrame:
        found = taint.taint_flow(t["assigns"], t["calls"])
        if s.taint_cross_file and all(name in t for name in ("functions", "exports", "imports")):
            summaries = taint.function_summaries(t["functions"], t["exports"], t["calls"])
            found = found.unionByName(taint.taint_cross_file(t["assigns"], t["calls"], edges(t), summaries))
        return on_changed(found, t)

    def complexity(t: Tables) -> DataFrame:
        scored = [
            nodes.complexity_findings(nodes.cyclomatic_complexity(t["nodes"]), "cyclomatic", s.max_cyclomatic),
            nodes.complexity_findings(nodes.cognitive_complexity(t["nodes"]), "cognitive", s.max_cognitive),
        ]
        return on_changed(_union(scored), t)

    def iac(t: Tables) -> DataFrame:
        lines = t["iac_lines"]
        rules = (
            line_rules.docker_absence_rules, line_rules.docker_line_rules, line_rules.k8s_rules,
            line_rules.workflow_script_injection, line_rules.workflow_mutable_ref,
        )
        return _union([rule(lines) for rule in rules])

    def coverage(t: Tables) -> DataFrame:
        parts = [supply.file_coverage(t["coverage"], s.min_coverage)]
        if t.get("changed") is not None:
            # Reports name files by other roots than the tree does.
            reports = t["coverage"].withColumnRenamed("path", "report_path")
            # The first report wins: by `ord`, or by the record of one report.
            place = next((F.col(c) for c in ("ord", "record") if c in reports.columns), F.lit(0))
            matched = supply.coverage_path_match(t["changed"], reports.withColumn("ord", place))
            parts.append(
                supply.new_code_coverage(t["changed"], reports.join(matched, "report_path"), s.min_new_code_coverage)
            )
        return _union(parts)

    edges = lambda t: graph.import_resolve(t["imports"], t["files"])
    return {
        "security": (["lines"], security),
        "ai-smells": (["lines"], smells),
        "conventions": (["files"], conventions),
        "duplicates": (["blocks"], clones),
        "architecture": (["imports"], lambda t: on_changed(graph.layer_violation(t["imports"], s.layers, s.layer_rules), t)),
        "impact": (["imports", "files"], lambda t: graph.impact_findings(edges(t), t["files"], s.impact_depth)),
        "taint": (["assigns", "calls"], tainted),
        "dependencies": (["deps", "advisories"], lambda t: supply.vulnerability_join(t["deps"], t["advisories"])),
        "complexity": (["nodes"], complexity),
        "iac": (["iac_lines"], iac),
        "dead-code": (
            ["imports", "files", "exports"],
            lambda t: graph.unused_exports(t["files"], t["exports"], edges(t), s.entry_points),
        ),
        "coverage": (["coverage"], coverage),
        "licenses": (
            ["deps", "licenses"],
            lambda t: supply.license_policy(t["deps"], t["licenses"], s.allowed_licenses, s.denied_licenses),
        ),
    }


def derived(tables: Tables, settings: Settings) -> Tables:
    """The given tables and those that follow from nodes and files, for the enabled families."""
    wanted = lambda *families: any(settings.enabled.get(f, True) for f in families)
    made: Tables = {}
    if "nodes" in tables:
        builders = {
            "blocks": (derive.spelled_blocks, ["duplicates"]),
            "assigns": (derive.assigns_of_nodes, ["taint"]),
            "calls": (derive.calls_of_nodes, ["taint"]),
            "functions": (derive.functions_of_nodes, ["taint"]),
            "imports": (graph.import_edges, ["architecture", "impact", "dead-code", "taint"]),
            "exports": (graph.export_names, ["dead-code", "taint"]),
        }
        # Several detectors read each of these, so they are stored.
        made = {
            name: cut_lineage(build(tables["nodes"]))
            for name, (build, families) in builders.items()
            if name not in tables and wanted(*families)
        }
    # Manifests and infrastructure files are read whatever languages are scanned.
    if wanted("dependencies", "licenses"):
        made["deps"] = reports.manifest_deps(tables["files"].select("path", "content"))
    if wanted("iac"):
        made["iac_lines"] = corpus.line_explode(line_rules.iac_file_select(tables["files"]))
    return made | tables


@dataclass
class Run:
    """`summary` is one row, also of a run without findings: counts by severity, files looked
    at, and the findings that directives, dismissals and the baseline took out. `failures`
    are the (name, problem) of plug-ins that had to be left out."""

    findings: DataFrame
    summary: DataFrame
    breakdowns: DataFrame
    failures: list[tuple[str, str]]


def scan(tables: Tables, run_id: str, settings: Settings | None = None, plugins: list[tuple[str, Detector]] = ()) -> Run:
    """Run every enabled family whose tables are given.

    `tables` needs files (path, content, language, status); optional are nodes, advisories,
    licenses, coverage, changes (for a diff run), baseline, dismissals and suggestions.
    Blocks, imports, exports, assigns, calls, functions, deps and iac_lines are derived from
    the nodes and files where they are not given.
    """
    settings = settings or Settings()
    files = corpus.path_filter(tables["files"], settings.include, settings.exclude, settings.languages)
    lines = corpus.line_explode(files)
    given = {**derived(tables, settings), "files": files, "lines": lines}
    if "changes" in tables:
        given["lines"] = line_rules.changed_line_semi(lines, tables["changes"])
        given["changed"] = tables["changes"].filter("change_type = 'added'")

    registry = DetectorRegistry()
    for family, (needed, detector) in families(settings).items():
        if all(name in given for name in needed):
            registry.register(family, detector)
    registry.load(plugins)

    # Findings are stored after every filter: the counts come from the stored tables, and
    # summary, breakdowns and exports read the last one several times.
    found = cut_lineage(registry.run(given, run_id, settings.enabled))
    filters = [("suppressed", lambda df: results.suppress(df, results.suppression_directives(lines, settings.keyword)))]
    if "dismissals" in tables:
        filters.append(("dismissed", lambda df: results.dismissal_filter(df, tables["dismissals"])))
    if "baseline" in tables:
        filters.append(("baselined", lambda df: results.baseline_filter(df, tables["baseline"])))
    dropped = {"suppressed": 0, "dismissed": 0, "baselined": 0}
    left = found.count()
    for name, keep in filters:
        found = cut_lineage(keep(found))
        before, left = left, found.count()
        dropped[name] = before - left
    if "suggestions" in tables:
        found = cut_lineage(results.suggestion_enrich(found, tables["suggestions"]))
    return Run(found, _summary(found, files, run_id, dropped), history.finding_breakdowns(found), registry.failures)


def _summary(found: DataFrame, files: DataFrame, run_id: str, dropped: dict[str, int]) -> DataFrame:
    counts = history.run_summary(found, ["run_id"]).drop("run_id", "total_files")
    zero_if_none = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts.columns]
    looked_at = files.agg(F.count("*").alias("total_files"))
    return counts.agg(*zero_if_none).crossJoin(looked_at).select(  # one row each
        F.lit(run_id).alias("run_id"), *counts.columns, "total_files", *[F.lit(n).cast("long").alias(c) for c, n in dropped.items()]
    )


def check_diff(diffs: DataFrame, files: DataFrame, run_id: str, settings: Settings | None = None, **tables: DataFrame) -> Run:
    """A run over unified diffs: only files and lines that the diffs add are looked at."""
    changes = corpus.diff_lines(diffs).select("path", "line", "content", "change_type")
    touched = files.join(changes.select("path").distinct(), "path", "left_semi")
    return scan({**tables, "files": touched, "changes": changes}, run_id, settings)
