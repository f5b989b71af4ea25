"""Queries over findings and runs."""

from pyspark.sql import functions as F

from codeloom import catalog
from codeloom.checks.base import FINDING, query, trim
from codeloom.checks.lines import PURL, secret_sql
from codeloom.checks.views import EXTENSIONS as _EXTENSIONS
from codeloom.functions import identity, names
from codeloom.functions.text import SPACES
from codeloom.operators import edits, export, history, line_rules, results
from codeloom.operators.registry import DetectorRegistry
from codeloom.plans import scan
from codeloom.session import scratch_path
from codeloom.sources import corpus, stores
from codeloom.streaming import incremental

_FIRST = (
    "first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, rule_id, file, line ORDER BY seq) AS i FROM v_findings) x WHERE i = 1)"
)


def deduped(v):
    return results.dedupe_findings(v("v_findings"), ["seq"])


def flagship(v):
    """De-duplicated findings of every run, broken down by family, rule and file."""
    return history.finding_breakdowns(deduped(v))


_BREAKDOWN = f"""
WITH {_FIRST}
SELECT run_id, 'analyzer' AS dimension, analyzer AS name, count(*) AS n FROM first GROUP BY run_id, analyzer
UNION ALL SELECT run_id, 'rule', rule_id, count(*) FROM first GROUP BY run_id, rule_id
UNION ALL SELECT run_id, 'file', file, count(*) FROM first GROUP BY run_id, file"""


@query("finding_breakdowns", _BREAKDOWN)
def _(v):
    return flagship(v)


@query("dedupe_findings", f"WITH {_FIRST} SELECT run_id, rule_id, file, line, seq, message, severity FROM first")
def _(v):
    return deduped(v).select("run_id", "rule_id", "file", "line", "seq", "message", "severity")


@query("severity_at_least", "SELECT seq, severity FROM v_findings WHERE severity IN ('warning', 'error')")
def _(v):
    return results.severity_at_least(v("v_findings"), "warning").select("seq", "severity")


@query("enabled_filter", "SELECT seq, analyzer FROM v_findings WHERE analyzer NOT IN ('click', 'view')")
def _(v):
    enabled = {"click": False, "view": False, "error": True}
    return results.enabled_filter(v("v_findings"), enabled).select("seq", "analyzer")


_PARTS = """
u AS (SELECT rule_id, severity, message, file, line, 0 AS family_order FROM v_findings
  UNION ALL SELECT 'rule/' || 'click', 'info', 'Line has ' || length(content) || ' characters', 'src/u' || (doc_id % 10) || '.ts', line, 1 FROM v_lines WHERE length(content) > 30)"""


@query(
    "merge_findings",
    f"WITH {_PARTS} SELECT rule_id, severity, message, file, line, CAST(family_order AS INT) AS family_order, 'all' AS run_id FROM u",
)
def _(v):
    lines = v("v_lines").withColumn("path", F.concat(F.lit("src/u"), F.col("doc_id") % 10, F.lit(".ts")))
    second = line_rules.long_lines(lines, 30).withColumn("rule_id", F.lit("rule/click"))
    merged = results.merge_findings([v("v_findings"), second], F.lit("all"))
    return merged.select("rule_id", "severity", "message", "file", "line", "family_order", "run_id")


_HASH = (
    f"sha256(rule_id || chr(0) || file || chr(0) || {trim(f'''regexp_replace(coalesce(code_snippet, ''), '[{SPACES}]+', ' ', 'g')''')})"
)


@query(
    "baseline_write",
    f"SELECT rule_id, file, message, CASE WHEN code_snippet IS NOT NULL THEN {_HASH} END AS content_hash FROM v_findings",
)
def _(v):
    path = scratch_path(v.spark, "baseline")
    stores.write_baseline(v("v_findings"), path)
    return v.spark.read.parquet(path)


@query("content_fingerprint", f"SELECT seq, {_HASH} AS fingerprint FROM v_findings")
def _(v):
    key = identity.content_fingerprint(F.col("rule_id"), F.col("file"), F.col("code_snippet"))
    return v("v_findings").select("seq", key.alias("fingerprint"))


@query("message_fingerprint", "SELECT seq, rule_id || chr(0) || file || chr(0) || message AS fingerprint FROM v_findings")
def _(v):
    key = identity.message_fingerprint(F.col("rule_id"), F.col("file"), F.col("message"))
    return v("v_findings").select("seq", key.alias("fingerprint"))


_MIDDLE = "'2024-01-10'"


@query(
    "baseline_filter",
    f"""WITH h AS (SELECT *, CASE WHEN code_snippet IS NOT NULL THEN {_HASH} END AS digest FROM v_findings),
    b AS (SELECT * FROM h WHERE run_id < {_MIDDLE})
    SELECT seq, rule_id, file, message FROM h WHERE run_id >= {_MIDDLE}
      AND (digest IS NULL OR digest NOT IN (SELECT digest FROM b WHERE digest IS NOT NULL))
      AND NOT EXISTS (SELECT 1 FROM b WHERE b.rule_id = h.rule_id AND b.file = h.file AND b.message = h.message)""",
)
def _(v):
    every = v("v_findings")
    baseline = stores.baseline_rows(every.filter(f"run_id < {_MIDDLE}"))
    return results.baseline_filter(every.filter(f"run_id >= {_MIDDLE}"), baseline).select("seq", "rule_id", "file", "message")


@query(
    "dismissal_upsert",
    """SELECT rule_id, pattern, pattern_type, CAST(sum(n) AS BIGINT) AS count, max(dismissed_at) AS dismissed_at FROM (
      SELECT DISTINCT rule_id, pattern, pattern_type, 1 AS n, DATE '2023-12-31' AS dismissed_at FROM v_dismiss_log WHERE rule_id = 'rule/error'
      UNION ALL SELECT rule_id, pattern, pattern_type, 1, dismissed_at FROM v_dismiss_log) x GROUP BY ALL""",
)
def _(v):
    log = v("v_dismiss_log")
    stored = (
        log.filter("rule_id = 'rule/error'").select("rule_id", "pattern", "pattern_type").distinct()
        .select("*", F.lit(1).cast("long").alias("count"), F.lit("2023-12-31").cast("date").alias("dismissed_at"))
    )
    return stores.dismissal_upsert(stored, log)


@query(
    "dismissal_filter",
    """SELECT seq, rule_id, file, message FROM v_findings f WHERE NOT EXISTS (SELECT 1 FROM v_dismissals d
      WHERE (d.rule_id = '*' OR d.rule_id = f.rule_id) AND CASE WHEN d.pattern_type = 'message' THEN contains(f.message, d.pattern)
        ELSE regexp_matches(f.file, '^' || replace(replace(d.pattern, '.', '\\.'), '?', '[^/]') || '$') END)""",
)
def _(v):
    return results.dismissal_filter(v("v_findings"), v("v_dismissals")).select("seq", "rule_id", "file", "message")


_RUN_COLUMNS = ["repo", "run_id", "total_findings", "errors", "warnings", "infos"]


@query(
    "runs_append",
    f"""SELECT {', '.join(_RUN_COLUMNS)} FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY run_at DESC, run_id DESC) AS i FROM (
      SELECT repo, run_id, run_at, total_findings, errors, warnings, infos FROM v_runs
      UNION ALL SELECT repo, 'new', max(run_at) || 'x', CAST(sum(total_findings) AS BIGINT), CAST(sum(errors) AS BIGINT), CAST(sum(warnings) AS BIGINT), CAST(sum(infos) AS BIGINT) FROM v_runs GROUP BY repo) u) x WHERE i <= 12""",
)
def _(v):
    runs = v("v_runs").select(*_RUN_COLUMNS, "run_at")
    sums = [F.sum(c).alias(c) for c in _RUN_COLUMNS[2:]]
    new = runs.groupBy("repo").agg(F.lit("new").alias("run_id"), *sums, F.concat(F.max("run_at"), F.lit("x")).alias("run_at"))
    return stores.append_run(runs, new, 12).select(*_RUN_COLUMNS)


@query("run_history", "SELECT run_id, seq, rule_id, file, line, message FROM v_findings")
def _(v):
    path = scratch_path(v.spark, "runs")
    stores.write_run_findings(v("v_findings").select("run_id", "seq", "rule_id", "file", "line", "message"), path)
    stored = v.spark.read.parquet(path)
    return stored.withColumn("run_id", F.col("run_id").cast("string")).select("run_id", "seq", "rule_id", "file", "line", "message")


_SUMMARY = """count(*) AS total_findings, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings,
  count(*) FILTER (severity = 'info') AS infos, count(DISTINCT file) AS total_files"""


@query("run_summary", f"SELECT repo, run_id, {_SUMMARY} FROM v_findings GROUP BY repo, run_id")
def _(v):
    return history.run_summary(v("v_findings"), ["repo", "run_id"])


_ESCAPED = """replace(message, '"', '\\"')"""


@query(
    "findings_json",
    f"""SELECT run_id, 'finding' AS section, '{{"ruleId":"' || rule_id || '","analyzer":"' || analyzer || '","severity":"' || severity || '","message":"' || {_ESCAPED} ||
      '","file":"' || file || '","line":' || line || CASE WHEN coalesce(suggestion, '') <> '' THEN ',"suggestion":"' || suggestion || '"' ELSE '' END || '}}' AS doc FROM v_findings
    UNION ALL SELECT run_id, 'summary', '{{"totalFiles":' || total_files || ',"totalFindings":' || total_findings || ',"errors":' || errors || ',"warnings":' || warnings || ',"infos":' || infos || '}}'
    FROM (SELECT run_id, {_SUMMARY} FROM v_findings GROUP BY run_id) s""",
)
def _(v):
    return export.findings_json(v("v_findings"))


_LEVEL = "CASE severity WHEN 'info' THEN '{info}' ELSE severity END"
_OPTIONAL = lambda label, c: f"""CASE WHEN {c} IS NOT NULL THEN ',"{label}":' || {c} ELSE '' END"""


@query(
    "findings_sarif",
    f"""SELECT run_id, 'rule' AS section, '{{"id":"' || rule_id || '","shortDescription":{{"text":"' || arg_min({_ESCAPED}, seq) || '"}},"helpUri":"#' || replace(rule_id, '/', '-') || '"}}' AS doc
    FROM v_findings GROUP BY run_id, rule_id
    UNION ALL SELECT run_id, 'result', '{{"ruleId":"' || rule_id || '","level":"' || {_LEVEL.format(info='note')} || '","message":{{"text":"' || {_ESCAPED} ||
      '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || file || '"}},"region":{{"startLine":' || line || {_OPTIONAL('startColumn', 'col')} ||
      {_OPTIONAL('endLine', 'end_line')} || {_OPTIONAL('endColumn', 'end_col')} || '}}}}}}]}}' FROM v_findings""",
)
def _(v):
    return export.findings_sarif(v("v_findings"))


@query("severity_level", f"SELECT seq, {_LEVEL.format(info='note')} AS sarif, {_LEVEL.format(info='notice')} AS annotation FROM v_findings")
def _(v):
    severity = F.col("severity")
    return v("v_findings").select(
        "seq", identity.sarif_level(severity).alias("sarif"), identity.annotation_level(severity).alias("annotation")
    )


_PART = lambda label, c: f"CASE WHEN coalesce({c}, 0) <> 0 THEN ',{label}=' || {c} ELSE '' END"


@query(
    "finding_annotations",
    f"""SELECT run_id, seq, '::' || {_LEVEL.format(info='notice')} || ' file=' || file || ',line=' || line || {_PART('endLine', 'end_line')} || {_PART('col', 'col')} ||
      {_PART('endColumn', 'end_col')} || ',title=codeloom [' || rule_id || ']::' || message AS annotation FROM v_findings""",
)
def _(v):
    return export.finding_annotations(v("v_findings"))


_COMPONENTS = f"""SELECT repo, name, version, {PURL} AS purl, ecosystem || '/' || name || '@' || version AS bom_ref,
  'SPDXRef-Package-' || (row_number() OVER (PARTITION BY repo ORDER BY seq) - 1) AS spdx_id FROM v_deps"""


@query("sbom_export", _COMPONENTS)
def _(v):
    return export.sbom_export(v("v_deps"), "seq")


@query(
    "sbom_documents",
    f"""WITH c AS ({_COMPONENTS})
    SELECT DISTINCT repo, 'document' AS section, '{{"spdxVersion":"SPDX-2.3","dataLicense":"CC0-1.0","SPDXID":"SPDXRef-DOCUMENT"}}' AS doc FROM c
    UNION ALL SELECT repo, 'packages', '{{"SPDXID":"' || spdx_id || '","name":"' || name || '","versionInfo":"' || version ||
      '","downloadLocation":"NOASSERTION","externalRefs":[{{"referenceCategory":"PACKAGE-MANAGER","referenceType":"purl","referenceLocator":"' || purl || '"}}]}}' FROM c
    UNION ALL SELECT DISTINCT repo, 'document', '{{"bomFormat":"CycloneDX","specVersion":"1.5","version":1}}' FROM c
    UNION ALL SELECT repo, 'components', '{{"type":"library","name":"' || name || '","version":"' || version || '","purl":"' || purl || '","bom-ref":"' || bom_ref || '"}}' FROM c""",
)
def _(v):
    components = export.sbom_export(v("v_deps"), "seq")
    return export.sbom_documents(components, "spdx").unionByName(export.sbom_documents(components))


# --- catalogue, fixers, suggestions -----------------------------------------------------------

_RULES = "(VALUES " + ", ".join(f"('{r}', '{f}', '{s}')" for r, f, s, _ in catalog.RULES) + ") r(rule_id, analyzer, default_severity)"
_FAMILIES = catalog.FAMILY_ORDER
_SETTINGS = (
    "SELECT DISTINCT 'repo' || c_nationkey AS repo, CASE c_nationkey % 4 WHEN 0 THEN 'security' WHEN 1 THEN 'iac' WHEN 2 THEN 'taint' ELSE 'impact' END AS family, "
    "CASE c_nationkey % 3 WHEN 0 THEN 'info' WHEN 1 THEN 'error' END AS severity, c_nationkey % 5 <> 0 AS enabled FROM {customer}"
)


def rule_settings(v):
    v.table("customer").createOrReplaceTempView("codeloom_customer")
    return v.spark.sql(_SETTINGS.format(customer="codeloom_customer"))


_CATALOG = f"""WITH s AS ({_SETTINGS.format(customer='customer')}), repos AS (SELECT DISTINCT repo FROM s)
SELECT p.repo, r.rule_id, r.analyzer, coalesce(s.severity, r.default_severity) AS severity, coalesce(s.enabled, false) AS enabled
FROM repos p CROSS JOIN {_RULES} LEFT JOIN s ON s.repo = p.repo AND s.family = r.analyzer"""


@query("rule_catalog", _CATALOG)
def _(v):
    return results.rule_catalog(rule_settings(v))


@query("rule_catalog_counts", f"SELECT repo, count(*) FILTER (enabled) AS enabled, count(*) AS total FROM ({_CATALOG}) c GROUP BY repo")
def _(v):
    return results.enabled_counts(results.rule_catalog(rule_settings(v)))


_FIX_RULE = (
    "CASE event_type WHEN 'error' THEN 'ai-smell/unused-import' WHEN 'click' THEN 'convention/class-naming' WHEN 'purchase' THEN 'convention/function-naming' ELSE rule_id END"
).replace("event_type", "analyzer")


@query(
    "fix_lookup",
    f"""SELECT seq, rule_id, CASE WHEN rule_id = 'ai-smell/unused-import' THEN 'remove-import' WHEN rule_id LIKE 'convention/%-naming' THEN 'rename' END AS fixer
    FROM (SELECT seq, {_FIX_RULE} AS rule_id FROM v_findings) f""",
)
def _(v):
    fixers = {"ai-smell/unused-import": "remove-import", "convention/function-naming": "rename"}
    ruled = v("v_findings").withColumn("rule_id", F.expr(_FIX_RULE))
    return results.fix_lookup(ruled, fixers).select("seq", "rule_id", "fixer")


_KEY = "sha256(rule_id || chr(0) || file || chr(0) || line || chr(0) || coalesce(code_snippet, ''))"


@query(
    "suggestion_enrich",
    f"""WITH k AS (SELECT *, {_KEY} AS key FROM v_findings), c AS (SELECT key, 'cached ' || min(seq) AS value FROM k WHERE run_id < {_MIDDLE} GROUP BY key)
    SELECT seq, coalesce(suggestion, value) AS suggestion FROM k LEFT JOIN c USING (key)""",
)
def _(v):
    every = v("v_findings")
    key = identity.suggestion_key(F.col("rule_id"), F.col("file"), F.col("line"), F.col("code_snippet"))
    cache = every.filter(f"run_id < {_MIDDLE}").groupBy(key.alias("key")).agg(
        F.concat(F.lit("cached "), F.min("seq").cast("string")).alias("value")
    )
    return results.suggestion_enrich(every, cache).select("seq", "suggestion")


@query(
    "finding_lifecycle",
    f"""WITH o AS (SELECT DISTINCT rule_id, file, line FROM v_findings WHERE run_id < {_MIDDLE}), n AS (SELECT DISTINCT rule_id, file, line FROM v_findings WHERE run_id >= {_MIDDLE})
    SELECT coalesce(o.rule_id, n.rule_id) AS rule_id, coalesce(o.file, n.file) AS file, coalesce(o.line, n.line) AS line,
      CASE WHEN n.rule_id IS NULL THEN 'resolved' WHEN o.rule_id IS NULL THEN 'new' ELSE 'persisting' END AS status
    FROM o FULL JOIN n ON o.rule_id = n.rule_id AND o.file = n.file AND o.line = n.line""",
)
def _(v):
    every = v("v_findings")
    return results.finding_lifecycle(every.filter(f"run_id < {_MIDDLE}"), every.filter(f"run_id >= {_MIDDLE}"))


# --- runs -----------------------------------------------------------------------------------

_DELTA = lambda c: f"greatest(0, {c} - coalesce(lag({c}) OVER (PARTITION BY repo ORDER BY run_at), 0))"
_GATE = f"""
WITH d AS (SELECT *, {_DELTA('errors')} AS new_errors, {_DELTA('warnings')} AS new_warnings FROM v_runs)
SELECT repo, run_id, 'newErrors' AS metric, CAST(new_errors AS BIGINT) AS actual, CAST(0 AS BIGINT) AS threshold, 'New errors (' || new_errors || ') exceed threshold (0)' AS message FROM d WHERE new_errors > 0
UNION ALL SELECT repo, run_id, 'newWarnings', new_warnings, 5, 'New warnings (' || new_warnings || ') exceed threshold (5)' FROM d WHERE new_warnings > 5
UNION ALL SELECT repo, run_id, 'totalFindings', total_findings, 40, 'Total findings (' || total_findings || ') exceed threshold (40)' FROM d WHERE total_findings > 40"""


def gate(v):
    return history.quality_gate(v("v_runs"), max_total=40)


@query("quality_gate", _GATE)
def _(v):
    return gate(v)


@query(
    "run_outcome",
    f"""SELECT r.repo, r.run_id, CAST(CASE WHEN g.run_id IS NOT NULL THEN 4 WHEN errors > 0 THEN 1 WHEN warnings > 2 THEN 2 ELSE 0 END AS INT) AS exit_code
    FROM v_runs r LEFT JOIN (SELECT DISTINCT repo, run_id FROM ({_GATE}) x) g ON g.repo = r.repo AND g.run_id = r.run_id""",
)
def _(v):
    return history.run_outcome(v("v_runs"), gate(v), max_warnings=2)


_LATEST = "(SELECT * FROM v_findings WHERE run_id IN (SELECT DISTINCT run_id FROM v_findings ORDER BY run_id DESC LIMIT 20))"


@query("rule_frequency", f"SELECT rule_id, count(*) AS n FROM {_LATEST} f GROUP BY rule_id")
def _(v):
    return history.rule_frequency(v("v_findings"))


@query("top_files", f"SELECT file, count(*) AS n FROM {_LATEST} f GROUP BY file ORDER BY n DESC, file LIMIT 20")
def _(v):
    return history.top_files(v("v_findings"))


@query(
    "run_cards",
    "SELECT repo, count(*) AS total_runs, arg_max(total_findings, run_at) AS latest_findings, CAST(floor(avg(duration) + 0.5) AS BIGINT) AS avg_duration FROM v_runs GROUP BY repo",
)
def _(v):
    return history.run_cards(v("v_runs"))


@query(
    "finding_trend",
    """WITH h AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY run_at) AS p, count(*) OVER (PARTITION BY repo) AS n FROM v_runs),
    m AS (SELECT repo, count(*) AS runs, avg(total_findings) FILTER (p > n // 2) - avg(total_findings) FILTER (p <= n // 2) AS difference FROM h GROUP BY repo)
    SELECT repo, runs, difference, CASE WHEN runs < 2 THEN 'stable' WHEN difference > 0.5 THEN 'increasing' WHEN difference < -0.5 THEN 'decreasing' ELSE 'stable' END AS trend FROM m""",
)
def _(v):
    return history.finding_trend(v("v_runs"))


@query(
    "recent_runs",
    """SELECT repo, run_id, total_findings, CAST(back AS INT) AS back, total_runs FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY run_at DESC) AS back, count(*) OVER (PARTITION BY repo) AS total_runs FROM v_runs) x WHERE back <= 10""",
)
def _(v):
    return history.recent_runs(v("v_runs")).select("repo", "run_id", "total_findings", "back", "total_runs")


@query("list_runs", "SELECT DISTINCT repo, run_id, run_at, command FROM v_findings")
def _(v):
    return history.list_runs(v("v_findings"))


@query("rule_descriptors", "SELECT rule_id, arg_min(message, seq) AS message FROM v_findings GROUP BY rule_id")
def _(v):
    return history.rule_descriptors(v("v_findings"))


@query("file_report", "SELECT run_id, file, line, seq, severity, rule_id, message FROM v_findings ORDER BY run_id, file, line, seq")
def _(v):
    return history.file_report(v("v_findings"))


@query(
    "review_comments",
    """SELECT run_id, seq, file AS path, line, CASE severity WHEN 'error' THEN ':x:' WHEN 'warning' THEN ':warning:' ELSE ':information_source:' END || ' **[' || rule_id || ']** ' || message ||
      CASE WHEN coalesce(suggestion, '') <> '' THEN chr(10) || '> **Suggestion:** ' || suggestion ELSE '' END AS body
    FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS i FROM v_findings WHERE file <> '' AND line > 0) x WHERE i <= 50""",
)
def _(v):
    return history.review_comments(v("v_findings"))


@query(
    "pr_summary",
    f"""WITH s AS (SELECT run_id, {_SUMMARY} FROM v_findings GROUP BY run_id)
    SELECT run_id, 'metric' AS section, unnest(['Total findings', 'Errors', 'Warnings', 'Info', 'Files analyzed']) AS name,
      unnest([total_findings, errors, warnings, infos, total_files]) AS n FROM s
    UNION ALL SELECT run_id, 'analyzer', analyzer, count(*) FROM v_findings GROUP BY run_id, analyzer""",
)
def _(v):
    return history.pr_summary(v("v_findings"))


@query(
    "cache_evict",
    f"SELECT key, last_access FROM (SELECT {_KEY} AS key, max(seq) AS last_access FROM v_findings GROUP BY ALL) c ORDER BY last_access DESC, key LIMIT 200",
)
def _(v):
    key = identity.suggestion_key(F.col("rule_id"), F.col("file"), F.col("line"), F.col("code_snippet"))
    return history.cache_evict(v("v_findings").groupBy(key.alias("key")).agg(F.max("seq").alias("last_access")))


# --- fixes ----------------------------------------------------------------------------------

_NAME = "regexp_extract(message, '''([^'']+)''.*should use (\\S+) naming', 1)"


@query(
    "message_name",
    f"SELECT path, line, {_NAME} AS name, 'camelCase' AS shape FROM v_fixes",
)
def _(v):
    found = names.message_name(F.col("message"))
    return v("v_fixes").select("path", "line", found["name"].alias("name"), found["shape"].alias("shape"))


_WORDS = (
    "list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(name, '[-_]', ' ', 'g'), "
    "'([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '\\s+'), lambda w: w <> ''), lambda w: lower(w))"
)
_CAMEL = "w[1] || array_to_string(list_transform(w, lambda x: upper(x[1]) || x[2:])[2:], '')"
_RENAMES = f"""
n AS (SELECT DISTINCT path, line, rule_id, name AS old_name, {_CAMEL} AS new_name FROM (SELECT *, {_WORDS} AS w FROM v_fixes) x),
renames AS (SELECT n.path AS file, n.line, rule_id, old_name, new_name, l.content AS old_text,
    regexp_replace(l.content, '\\b' || old_name || '\\b', new_name) AS new_text
  FROM n JOIN v_lines l ON l.path = n.path AND l.line = n.line WHERE old_name <> new_name AND regexp_matches(l.content, '\\b' || old_name || '\\b'))"""


def renames(v):
    return edits.rename_edits(v("v_fixes"), v("v_lines"))


@query("rename_edits", f"WITH {_RENAMES} SELECT * FROM renames")
def _(v):
    return renames(v)


@query(
    "import_edits",
    """SELECT path, line, content, name, k IN (0, 1, 2, 7, 8, 9) AS dropped, CASE k
        WHEN 3 THEN 'import { a, b } from "m"' WHEN 5 THEN 'import React from "m"' WHEN 6 THEN 'import React, { k } from "m"' WHEN 10 THEN content
        WHEN 4 THEN 'import { ' || name || ' as y } from "m"' END AS new_text
      FROM (SELECT *, line % 11 AS k FROM v_import_lines) x""",
)
def _(v):
    return edits.import_edits(v("v_import_lines")).select("path", "line", "content", "name", "dropped", "new_text")


@query(
    "apply_edits",
    f"""WITH {_RENAMES}, e AS (SELECT file, line, min(new_text) AS new_text FROM renames GROUP BY file, line),
    p AS (SELECT l.path, string_agg(coalesce(e.new_text, l.content), chr(10) ORDER BY l.line) AS content
      FROM v_lines l LEFT JOIN e ON e.file = l.path AND e.line = l.line GROUP BY l.path)
    SELECT path, sha256(content) AS digest FROM p""",
)
def _(v):
    changes = renames(v).select(F.col("file").alias("path"), "line", F.lit(False).alias("dropped"), "new_text")
    patched = edits.apply_edits(v("v_files").select("path", "content"), changes)
    return patched.select("path", F.sha2("content", 256).alias("digest"))


@query(
    "fix_summary",
    f"""WITH {_RENAMES}, r AS (SELECT f.path, f.line, f.name, EXISTS (SELECT 1 FROM renames x WHERE x.file = f.path AND x.line = f.line AND x.old_name = f.name) AS applied FROM v_fixes f)
    SELECT count(*) FILTER (applied) AS fixed, count(*) FILTER (NOT applied) AS skipped FROM r""",
)
def _(v):
    done = renames(v).select(F.col("file").alias("path"), "line", F.col("old_name").alias("name")).distinct()
    results = v("v_fixes").join(done.withColumn("applied", F.lit(True)), ["path", "line", "name"], "left")
    return history.fix_summary(results)


# --- whole runs -------------------------------------------------------------------------------

_SCAN_LINES = "(SELECT path, line, content FROM v_lines WHERE path NOT LIKE '%.md') scanned"
_SCAN = f"""
WITH u AS (SELECT rule_id, severity, message, file, line, 0 AS o FROM ({secret_sql(_SCAN_LINES)}) s
  UNION ALL SELECT 'security/custom-the', 'info', 'Custom security pattern matched: the', path, line, 0 FROM {_SCAN_LINES} WHERE regexp_matches(content, '\\bthe\\b')
  UNION ALL SELECT 'style/line-length', 'info', 'Line has ' || length(content) || ' characters', path, line, 1 FROM {_SCAN_LINES} WHERE length(content) > 60),
d AS (SELECT *, row_number() OVER (PARTITION BY rule_id, file, line ORDER BY o, message) AS i FROM u)
SELECT rule_id, severity, message, file, line FROM d WHERE i = 1 AND file NOT LIKE 'src/src3/%'"""


@query("scan_run", _SCAN)
def _(v):
    files = corpus.corpus_scan(v("v_files").select("path", "content"))
    off = {family: False for family in catalog.FAMILY_ORDER if family != "security"}
    settings = scan.Settings(exclude=["src/src3/**"], enabled=off, custom_patterns=[("the", r"\bthe\b", "info")])
    plugins = [("style", lambda tables: line_rules.long_lines(tables["lines"], 60))]
    return scan.scan({"files": files}, "all", settings, plugins).findings.select(*FINDING)


# --- plug-ins and streams --------------------------------------------------------------------

_STYLE = "SELECT 'style/line-length' AS rule_id, 'info' AS severity, 'Line has ' || length(content) || ' characters' AS message, path AS file, line FROM v_lines WHERE length(content) > 120"


@query("register_detector", _STYLE)
def _(v):
    registry = DetectorRegistry()
    registry.register("style", lambda tables: line_rules.long_lines(tables["lines"], 120))
    return registry.run({"lines": v("v_lines")}, "all").select(*FINDING)


_UNKNOWN_LINES = "(SELECT path, line, content FROM v_lines WHERE path NOT LIKE '%.py') unknown"


@query("incremental_check", secret_sql(_UNKNOWN_LINES))
def _(v):
    documents = v.stream("documents")
    extensions = F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.col("doc_id") % 13 + 1).cast("int"))
    files = documents.select(
        F.concat(F.lit("src/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), extensions).alias("path"),
        F.col("text").alias("content"),
    )
    out, checkpoint = scratch_path(v.spark, "check"), scratch_path(v.spark, "check-progress")
    # The baseline knows what Python files hold.
    found = line_rules.secret_scan(v("v_lines"))
    baseline = stores.baseline_rows(found.filter("file LIKE '%.py'"))
    incremental.incremental_check(files, baseline, out, checkpoint, scratch_path(v.spark, "check-state"))
    return v.spark.read.schema(found.schema).parquet(out).select(*FINDING, "code_snippet")


@query("incremental_runs", f"SELECT run_id, {_SUMMARY} FROM v_findings GROUP BY run_id")
def _(v):
    events = v.stream("events")
    kind = F.col("event_type")
    findings = events.select(
        F.concat(F.lit("rule/"), kind).alias("rule_id"),
        kind.alias("analyzer"),
        F.when(kind == "error", "error").when(kind.isin("purchase", "signup"), "warning").otherwise("info").alias("severity"),
        F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit(".ts")).alias("file"),
        F.col("ts").cast("date").cast("string").alias("run_id"),
    )
    out, checkpoint = scratch_path(v.spark, "summaries"), scratch_path(v.spark, "summaries-progress")
    incremental.incremental_runs(findings, out, checkpoint)
    return incremental.stored_summaries(v.spark, out)
