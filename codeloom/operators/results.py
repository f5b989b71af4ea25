"""The findings algebra: merge, de-duplicate, suppress, compare."""

from __future__ import annotations

from functools import reduce

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom import catalog
from codeloom.functions import identity, paths, text
from codeloom.functions.text import regex
from codeloom.operators.taint import mentions
from codeloom.schema import FINDING_COLUMNS
from codeloom.session import cut_lineage, small_side


def merge_findings(parts: list[DataFrame], run_id: Column) -> DataFrame:
    """Union of the families' findings in merge order, one run."""
    ranked = [part.select(*FINDING_COLUMNS).withColumn("family_order", F.lit(i)) for i, part in enumerate(parts)]
    return reduce(DataFrame.unionByName, ranked).withColumn("run_id", run_id)


def dedupe_findings(findings: DataFrame, order: list[str]) -> DataFrame:
    """The first finding per run, rule, file and line. `row_number() = 1` lets Spark drop
    the others before the shuffle, so one hot location costs one row per task."""
    first = Window.partitionBy("run_id", "rule_id", "file", "line").orderBy(*order)
    return findings.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def severity_at_least(findings: DataFrame, level: str) -> DataFrame:
    return findings.filter(identity.severity_rank(F.col("severity")) >= catalog.SEVERITY_RANK[level])


def enabled_filter(findings: DataFrame, enabled: dict[str, bool]) -> DataFrame:
    """Drop the findings of switched-off families; unknown families pass."""
    off = [family for family, on in enabled.items() if not on]
    return findings.filter(~F.col("analyzer").isin(*off)) if off else findings


def rule_catalog(settings: DataFrame) -> DataFrame:
    """Built-in rules of every repository with severity and switch from its settings
    (repo, family, severity, enabled); at most one settings row per repo and family."""
    rules = F.array(
        *[
            F.struct(F.lit(r).alias("rule_id"), F.lit(f).alias("analyzer"), F.lit(s).alias("default_severity"))
            for r, f, s, _ in catalog.RULES
        ]
    )
    per_repo = settings.groupBy("repo").agg(
        F.map_from_entries(
            F.collect_list(F.struct("family", F.struct("severity", "enabled")))
        ).alias("chosen")
    )
    chosen = F.try_element_at("chosen", F.col("r.analyzer"))
    return per_repo.select("repo", "chosen", F.explode(rules).alias("r")).select(
        "repo",
        "r.rule_id",
        "r.analyzer",
        F.coalesce(chosen["severity"], F.col("r.default_severity")).alias("severity"),
        F.coalesce(chosen["enabled"], F.lit(False)).alias("enabled"),
    )


def enabled_counts(rules: DataFrame) -> DataFrame:
    return rules.groupBy("repo").agg(F.count_if("enabled").alias("enabled"), F.count("*").alias("total"))


def suppression_directives(lines: DataFrame, keyword: str = "scan-ignore") -> DataFrame:
    """Ignore comments in (path, language, line, content) as (path, line, rule_id) of the
    line they act on; a NULL rule acts on every rule."""
    content = F.col("content")
    python = F.col("language") == "python"
    comment = lambda pattern: F.when(
        content.rlike(regex(pattern)), text.trim(F.regexp_extract(content, regex(pattern), 1))
    )
    styles = [
        F.when(~python, comment(r"//\s*(.*)")),
        F.when(python, comment(r"#\s*(.*)")),
        F.when(~python, comment(r"/\*\s*(.*?)\s*\*/")),
    ]
    same_line = f"{keyword}-line"

    def directive(key: str, offset: int, unless: str | None) -> Column:
        found = []
        for body in styles:
            cond = body.startswith(key)
            if unless:
                cond = cond & ~body.startswith(unless)
            rest = text.trim(F.substring(body, len(key) + 1, 2147483647))
            rule = F.when(rest != "", rest)
            found.append(
                F.when(cond, F.struct((F.col("line") + offset).alias("line"), rule.alias("rule_id")))
            )
        return F.coalesce(*found)

    both = F.array(directive(same_line, 0, None), directive(keyword, 1, same_line))
    return (
        lines.filter(content.contains(keyword))
        .select("path", F.explode(F.array_compact(both)).alias("d"))
        .select("path", "d.line", "d.rule_id")
    )


def suppress(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """Findings without a directive on their line for their rule or for all rules."""
    d = directives.distinct().select(
        F.col("path").alias("d_file"), F.col("line").alias("d_line"), F.col("rule_id").alias("d_rule")
    )
    hit = (
        (F.col("file") == F.col("d_file"))
        & (F.col("line") == F.col("d_line"))
        & (F.col("d_rule").isNull() | (F.col("d_rule") == F.col("rule_id")))
    )
    return findings.join(d, hit, "left_anti")


def baseline_filter(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings that the baseline knows neither by snippet hash nor by message; the line
    number does not matter."""
    digest = F.when(
        F.col("code_snippet").isNotNull(),
        identity.content_fingerprint(F.col("rule_id"), F.col("file"), F.col("code_snippet")),
    )
    hashes = baseline.filter("content_hash IS NOT NULL").select("content_hash").distinct()
    messages = baseline.select("rule_id", "file", "message").distinct()
    return (
        findings.withColumn("content_hash", digest)
        .join(hashes, "content_hash", "left_anti")
        .drop("content_hash")
        .join(messages, ["rule_id", "file", "message"], "left_anti")
    )


def _glob_anchor(pattern: Column) -> Column:
    """A text that every path matching the glob contains: its longest literal part, or what
    stands before the first group, class or escape. `**/` may stand for nothing."""
    special = pattern.rlike(r"[{\[\\]|^[!#]")
    parts = F.transform(F.split(pattern, r"\*\*/|[*?]+"), lambda p: F.struct(F.length(p).alias("size"), p.alias("part")))
    return F.when(special, F.regexp_extract(pattern, r"^[^*?{\[\\!#]*", 0)).otherwise(F.array_max(parts)["part"])


def _without_matches(findings: DataFrame, entries: DataFrame, column: str, match: Column) -> DataFrame:
    """Findings whose `column` no entry (rule or `*`, anchor, ...) matches, where `match` is a
    condition on the entry and `text`. Each text is looked at once per rule that has entries."""
    known = findings.filter(F.col(column).isNotNull())
    texts = known.select(F.lit("*").alias("rule"), F.col(column).alias("text"))
    texts = texts.unionByName(known.select(F.col("rule_id").alias("rule"), F.col(column).alias("text")))
    texts = texts.join(entries.select("rule").distinct(), "rule", "left_semi").distinct()
    texts = cut_lineage(texts.select(F.col("rule").alias("path"), F.monotonically_increasing_id().alias("text_id"), "text"))
    anchored = entries.filter("anchor <> ''").select(F.col("rule").alias("path"), F.col("anchor").alias("var"))
    near = mentions(texts, anchored).join(texts, ["path", "text_id"]).withColumnRenamed("var", "anchor")
    candidates = near.select("path", "anchor", "text").unionByName(texts.select("path", F.lit("").alias("anchor"), "text"))
    hits = cut_lineage(
        candidates.withColumnRenamed("path", "rule").join(entries, ["rule", "anchor"]).filter(match)
        .select("rule", F.col("text").alias(column)).distinct()
    )
    everywhere = hits.filter("rule = '*'").select(column)
    return findings.join(everywhere, column, "left_anti").join(
        hits.withColumnRenamed("rule", "rule_id"), ["rule_id", column], "left_anti"
    )


def dismissal_filter(findings: DataFrame, dismissals: DataFrame) -> DataFrame:
    """Findings that no stored dismissal (rule_id or `*`, pattern, pattern_type) matches: a
    `message` pattern is a part of the message, a `file` pattern a glob of the path.

    Patterns stay rows of a table. Each is looked up in an index of the texts' grams by a text
    that its matches must contain; a glob without such a text meets all paths of its rule.
    Patterns or rules that are null, and other kinds of patterns, match nothing.
    """
    entries = dismissals.select(F.col("rule_id").alias("rule"), "pattern", "pattern_type").dropna().distinct()
    text, pattern = F.col("text"), F.col("pattern")
    messages = entries.filter("pattern_type = 'message'").select("rule", "pattern", pattern.alias("anchor"))
    # The only Python code: a glob becomes a regex once per stored pattern. Workers get the
    # code of the module itself.
    register_pickle_by_value(paths)
    to_regex = F.udf(paths.glob_to_regex, "string")
    bare = F.ltrim(pattern, F.lit("!"))
    globs = cut_lineage(
        entries.filter("pattern_type = 'file'").select(
            "rule", _glob_anchor(pattern).alias("anchor"), to_regex(bare).alias("regex"),
            ((F.length(pattern) - F.length(bare)) % 2 == 0).alias("positive"),
        )
    )
    kept = _without_matches(findings, messages, "message", text.contains(pattern))
    return _without_matches(kept, globs, "file", F.regexp_like(text, F.col("regex")) == F.col("positive"))


def first_setting(files: DataFrame, overrides: list[tuple[str, dict]], base: dict) -> DataFrame:
    """Settings per file: the first glob that matches overrides single keys of `base`."""
    path = F.col("path")
    columns = {}
    for key, default in base.items():
        value = F.lit(default)
        for pattern, values in reversed(overrides):
            value = F.when(paths.glob_match(path, pattern), F.lit(values.get(key, default))).otherwise(value)
        columns[key] = value
    return files.withColumns(columns)


def fix_lookup(findings: DataFrame, fixers: dict[str, str]) -> DataFrame:
    """Fixer by exact rule id, else the naming fixer for every convention naming rule."""
    exact = identity.lookup(fixers, F.col("rule_id"))
    naming = next((f for r, f in fixers.items() if r.startswith("convention/") and r.endswith("-naming")), None)
    any_naming = F.when(F.col("rule_id").rlike(r"^convention/.*-naming\z"), F.lit(naming))
    return findings.withColumn("fixer", F.coalesce(exact, any_naming))


def suggestion_enrich(findings: DataFrame, cache: DataFrame) -> DataFrame:
    """Fill missing suggestions from a store (key, value) with unique keys."""
    key = identity.suggestion_key(F.col("rule_id"), F.col("file"), F.col("line"), F.col("code_snippet"))
    stored = cache.select(F.col("key").alias("__key"), F.col("value").alias("__value"))
    joined = findings.withColumn("__k", F.when(F.col("suggestion").isNull(), key))
    joined = joined.join(small_side(stored), F.col("__k") == F.col("__key"), "left")
    return joined.withColumn("suggestion", F.coalesce("suggestion", "__value")).drop("__k", "__key", "__value")


def finding_lifecycle(before: DataFrame, after: DataFrame) -> DataFrame:
    """resolved / persisting / new per (rule, file, line) between two runs."""
    keys = ["rule_id", "file", "line"]
    old = before.select(*keys).distinct().withColumn("old", F.lit(True))
    new = after.select(*keys).distinct().withColumn("new", F.lit(True))
    status = (
        F.when(F.col("old") & F.col("new"), "persisting").when(F.col("old"), "resolved").otherwise("new")
    )
    return old.join(new, keys, "full_outer").select(*keys, status.alias("status"))
