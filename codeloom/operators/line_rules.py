"""Detectors that look at lines: secrets, custom patterns, comments, infrastructure files.

Rules are compiled into one projection, so any number of them costs a single pass over
the lines and no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom import catalog
from codeloom.functions import ordered, paths, text
from codeloom.functions.text import regex
from codeloom.schema import findings


def changed_line_semi(rows: DataFrame, changes: DataFrame, file: str = "path", line: str = "line") -> DataFrame:
    """Rows that sit on an added line of `changes`."""
    added = changes.filter(F.col("change_type") == "added").select(
        F.col("path").alias("__path"), F.col("line").alias("__line")
    )
    return rows.join(added, (rows[file] == added["__path"]) & (rows[line] == added["__line"]), "left_semi")


def match_rules(lines: DataFrame, rules: list[tuple[Column, dict[str, str]]]) -> DataFrame:
    """One row per (line, matching rule); a rule is a condition and its constant columns."""
    hits = [F.when(cond, F.struct(*[F.lit(v).alias(k) for k, v in values.items()])) for cond, values in rules]
    hit = F.explode(F.array_compact(F.array(*hits))).alias("rule")
    return lines.select("*", hit).select(*[F.col(c) for c in lines.columns], "rule.*")


def secret_scan(lines: DataFrame) -> DataFrame:
    """Eleven credential shapes; `//` comments that mention an example are skipped."""
    content = F.col("content")
    rules = [
        (content.rlike(regex(pattern, ignore_case)), {"secret": name, "severity": severity})
        for name, pattern, ignore_case, severity in catalog.SECRETS
    ]
    example = text.trim_start(content).startswith("//") & content.contains("example")
    matched = match_rules(lines.filter(~example), rules)
    return findings(
        matched,
        rule_id="security/hardcoded-secret",
        analyzer="security",
        severity=F.col("severity"),
        message=F.concat(F.lit("Possible hardcoded "), F.col("secret"), F.lit(" detected")),
        file="path",
        line="line",
        code_snippet=text.trim(content),
        suggestion=F.lit(catalog.SUGGESTION["security/hardcoded-secret"]),
    )


def custom_pattern_scan(lines: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Configured (name, regex, severity) rows over the lines."""
    rules = [
        (F.col("content").rlike(regex(pattern)), {"name": name, "severity": severity})
        for name, pattern, severity in patterns
    ]
    return findings(
        match_rules(lines, rules),
        rule_id=F.concat(F.lit("security/custom-"), F.col("name")),
        analyzer="security",
        severity=F.col("severity"),
        message=F.concat(F.lit("Custom security pattern matched: "), F.col("name")),
        file="path",
        line="line",
    )


def long_lines(lines: DataFrame, limit: int) -> DataFrame:
    """The sample detector of the registry: lines longer than `limit`."""
    return findings(
        lines.filter(F.length("content") > limit),
        rule_id="style/line-length",
        analyzer="style",
        severity="info",
        message=F.concat(F.lit("Line has "), F.length("content").cast("string"), F.lit(" characters")),
        file="path",
        line="line",
    )


def comment_ratio(lines: DataFrame, threshold: float = catalog.DEFAULTS["comment_ratio"]) -> DataFrame:
    """Files whose changed lines are mostly comments, at least five non-blank ones."""
    trimmed = text.trim(F.col("content"))
    marked = lines.filter(trimmed != "").select(
        "path",
        "line",
        text.is_comment(trimmed).alias("comment"),
        trimmed.rlike(r"^(?://|/\*|#)").alias("opener"),
    )
    per_file = marked.groupBy("path").agg(
        F.count_if("comment").alias("comments"),
        F.count("*").alias("total"),
        F.min(F.when(F.col("opener"), F.col("line"))).alias("first"),
    )
    comments, total = F.col("comments"), F.col("total")
    percent = text.fixed_point(comments * 100, total, 0)
    limit = F.lit(f"{threshold * 100:.0f}")
    return findings(
        per_file.filter((total >= 5) & (comments / total > threshold)),
        rule_id="ai-smell/excessive-comments",
        analyzer="ai-smells",
        severity="warning",
        message=F.concat(
            F.lit("Excessive comment-to-code ratio: "), percent, F.lit("% comments (threshold: "), limit, F.lit("%)")
        ),
        file="path",
        line=F.coalesce("first", F.lit(1)),
        suggestion=F.lit(catalog.SUGGESTION["ai-smell/excessive-comments"]),
    )


def copy_paste_blocks(files: DataFrame) -> DataFrame:
    """First run of six long lines that occurs again in the same file.

    `files` is (path, lines), the array of the changed (line, content) of one file, so a
    file is one row and its shingles are built inside that row without a shuffle.
    """
    block = 6
    cleaned = F.transform("lines", lambda l: F.struct(l["line"].alias("line"), text.trim(l["content"]).alias("text")))
    long = files.select("path", F.filter(cleaned, lambda l: F.length(l["text"]) > 20).alias("kept")).filter(
        F.size("kept") >= 10
    )
    shingles = long.select(
        "path",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(1), F.size("kept") - (block - 1)), lambda i: F.slice("kept", i, F.lit(block))
            )
        ).alias("pos", "shingle"),
    )
    plain = F.filter(
        "shingle", lambda l: ~text.is_boilerplate(l["text"]) & ~text.is_single_call(l["text"])
    )
    repeated = (
        shingles.filter(F.size(plain) >= 3)
        .select(
            "path",
            "pos",
            F.col("shingle")[0]["line"].alias("line"),
            F.sha2(F.array_join(F.transform("shingle", lambda l: l["text"]), "\n"), 256).alias("block"),
        )
        .groupBy("path", "block")
        .agg(F.count("*").alias("times"), F.min(F.struct("pos", "line")).alias("first"))
        .filter("times >= 2")
    )
    per_file = repeated.groupBy("path").agg(F.min(F.struct("first.pos", "first.line", "times")).alias("first"))
    return findings(
        per_file,
        rule_id="ai-smell/copy-paste",
        analyzer="ai-smells",
        severity="warning",
        message=F.concat(
            F.lit("Repeated code block found "), F.col("first.times").cast("string"), F.lit(" times in the same diff")
        ),
        file="path",
        line=F.col("first.line"),
        suggestion=F.lit(catalog.SUGGESTION["ai-smell/copy-paste"]),
    )


def unsafe_regex_text(lines: DataFrame) -> DataFrame:
    """Regex texts (path, line, content) at risk of catastrophic backtracking."""
    return findings(
        lines.filter(text.unsafe_regex(F.col("content"))),
        rule_id="security/unsafe-regex",
        analyzer="security",
        severity="warning",
        message=F.lit("Potential ReDoS: regex with nested quantifiers"),
        file="path",
        line="line",
        code_snippet=F.col("content"),
        suggestion=F.lit(catalog.SUGGESTION["security/unsafe-regex"]),
    )


# Fixed values. File globs of the infrastructure kinds.
IAC_GLOBS = {
    "docker": ["**/Dockerfile", "**/Dockerfile.*", "**/*.dockerfile"],
    "k8s": [
        "**/k8s/**/*.yml", "**/k8s/**/*.yaml",
        "**/kubernetes/**/*.yml", "**/kubernetes/**/*.yaml",
        "**/deploy/**/*.yml", "**/deploy/**/*.yaml",
    ],
    "workflow": [".github/workflows/*.yml", ".github/workflows/*.yaml"],
}


def iac_kind(path: Column) -> Column:
    """docker, k8s or workflow; NULL for other files, vendored folders and deep paths."""
    kind = F.coalesce(*[F.when(paths.any_glob(path, g), F.lit(k)) for k, g in IAC_GLOBS.items()])
    skipped = path.rlike(r"(?:^|/)(?:node_modules|\.git)(?:/|\z)")
    return F.when(~skipped & (F.size(F.split(path, "/")) - 1 <= 5), kind)


def iac_file_select(files: DataFrame) -> DataFrame:
    return files.withColumn("iac_kind", iac_kind(F.col("path"))).filter(F.col("iac_kind").isNotNull())


# Fixed values. Line rules: (kind, rule id, patterns of which one must match,
# case-insensitive, message).
IAC_LINE_RULES = [
    ("docker", "iac/docker-latest-tag", [r"^\s*FROM\s+\S+:latest\b"], True,
     "Avoid using :latest tag — pin to a specific version"),
    ("docker", "iac/docker-curl-pipe-bash", [r"curl\s.*\|\s*(bash|sh)\b", r"wget\s.*\|\s*(bash|sh)\b"], True,
     "Piping curl/wget to shell is dangerous — download and verify first"),
    ("docker", "iac/docker-exposed-secrets", [r"^\s*ENV\s+(SECRET|PASSWORD|API_KEY|TOKEN|PRIVATE_KEY)\s*="], True,
     "Sensitive values should not be hardcoded in ENV — use build args or secrets"),
    ("docker", "iac/docker-add-vs-copy", [r"^\s*ADD\s+(?!https?://)(?!\S+\.tar)"], False,
     "Use COPY instead of ADD for local files — ADD has unexpected behaviors"),
    ("k8s", "iac/k8s-privileged", [r"^\s*privileged:\s*true"], True,
     "Container running in privileged mode is a security risk"),
    ("k8s", "iac/k8s-latest-tag", [r"^\s*image:\s*\S+:latest\s*$"], True,
     "Avoid using :latest tag for container images — pin to specific version"),
    ("workflow", "iac/gha-mutable-action-ref", [r"^\s*-?\s*uses:\s*\S+@(main|master|develop|dev)\s*$"], False,
     "Pin GitHub Actions to a specific SHA instead of a mutable branch reference"),
]
RUN_ROOT = "Dockerfile has no USER instruction — container runs as root"
NO_HEALTHCHECK = "Dockerfile has no HEALTHCHECK instruction"
NO_LIMITS = "No resource limits defined — could lead to resource exhaustion"
SCRIPT_INJECTION = "Potential script injection — github.event context in run block should use environment variables"


def _of_kind(lines: DataFrame, kind: str) -> DataFrame:
    return lines.filter(iac_kind(F.col("path")) == kind)


def _iac(df: DataFrame, rule, message, severity: str, line="line", **optional) -> DataFrame:
    return findings(
        df, rule_id=rule, analyzer="iac", severity=severity, message=message, file="path", line=line, **optional
    )


def _line_rules(lines: DataFrame, kind: str, severity: str) -> DataFrame:
    content = F.col("content")
    rules = []
    for of, rule, patterns, ignore_case, message in IAC_LINE_RULES:
        if of == kind:
            either = "|".join(f"(?:{regex(p)})" for p in patterns)
            hit = content.rlike(("(?i)" if ignore_case else "") + either)
            rules.append((hit, {"rule_id": rule, "message": message}))
    matched = match_rules(_of_kind(lines, kind), rules)
    return _iac(matched, F.col("rule_id"), F.col("message"), severity, code_snippet=text.trim(content))


def docker_line_rules(lines: DataFrame, severity: str = "warning") -> DataFrame:
    return _line_rules(lines, "docker", severity)


def docker_absence_rules(lines: DataFrame, severity: str = "warning") -> DataFrame:
    """Dockerfiles with FROM but no USER, or no HEALTHCHECK, reported at line 1."""
    has = lambda word: F.bool_or(F.col("content").rlike(regex(rf"^\s*{word}\s+", True)))
    per_file = (
        _of_kind(lines, "docker")
        .groupBy("path")
        .agg(has("FROM").alias("based"), has("USER").alias("user"), has("HEALTHCHECK").alias("health"))
        .filter("based")
    )
    rules = [
        (~F.col("user"), {"rule_id": "iac/docker-run-as-root", "message": RUN_ROOT}),
        (~F.col("health"), {"rule_id": "iac/docker-no-healthcheck", "message": NO_HEALTHCHECK}),
    ]
    return _iac(match_rules(per_file, rules), F.col("rule_id"), F.col("message"), severity, line=F.lit(1))


def k8s_rules(lines: DataFrame, severity: str = "warning") -> DataFrame:
    """Manifests (files that mention apiVersion or kind): line rules plus missing limits."""
    content = F.col("content")
    manifest_lines = _of_kind(lines, "k8s")
    per_file = manifest_lines.groupBy("path").agg(
        F.bool_or(content.contains("apiVersion:") | content.contains("kind:")).alias("manifest"),
        F.bool_or(content.rlike("kind: (?:Deployment|Pod|StatefulSet)")).alias("workload"),
        F.bool_or(content.rlike(regex(r"^\s*resources:"))).alias("limits"),
    )
    manifests = per_file.filter("manifest")
    on_lines = _line_rules(lines, "k8s", severity)
    on_lines = on_lines.join(manifests.select(F.col("path").alias("file")), "file", "left_semi")
    unlimited = _iac(
        manifests.filter("workload AND NOT limits"),
        "iac/k8s-no-resource-limits",
        F.lit(NO_LIMITS),
        severity,
        line=F.lit(1),
    )
    return on_lines.select(unlimited.columns).unionByName(unlimited)


def workflow_mutable_ref(lines: DataFrame, severity: str = "warning") -> DataFrame:
    return _line_rules(lines, "workflow", severity)


def workflow_script_injection(lines: DataFrame, severity: str = "warning") -> DataFrame:
    """Event context inside a `run:` block; the block lasts until another key line."""
    content = F.col("content")
    switch = (
        F.when(content.rlike(regex(r"^\s*run:\s*")), True)
        .when(content.rlike(regex(r"^\s*\w+:")) & ~content.rlike(regex(r"^\s*-")), False)
    )
    state = ordered.last_known(_of_kind(lines, "workflow"), ["path"], "line", switch, "in_run")
    hits = state.filter(F.col("in_run") & content.rlike(regex(r"\$\{\{\s*github\.event\.")))
    return _iac(
        hits,
        "iac/gha-script-injection",
        F.lit(SCRIPT_INJECTION),
        severity,
        code_snippet=text.trim(content),
    )
