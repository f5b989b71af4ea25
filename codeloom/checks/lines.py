"""Queries over files, lines, diffs and reports."""

from pyspark.sql import functions as F

from codeloom import catalog
from codeloom.checks.base import FINDING, fixed, hit, in_list, lit, query, rx, trim
from codeloom.functions import identity, names, paths, text
from codeloom.functions.kinds import only
from codeloom.operators import line_rules, nodes, results, supply
from codeloom.sources import corpus, reports

LANGUAGE_ROWS = "(VALUES " + ", ".join(f"('{e}', '{l}')" for e, l in catalog.LANGUAGE_BY_EXTENSION.items()) + ") lang_of(ext, language)"
EXT = r"regexp_extract(path, '(\.[^.]*)$', 1)"

# A scratch view used by several oracles: files with their language.
TYPED = f"typed AS (SELECT f.*, l.language FROM v_files f LEFT JOIN {LANGUAGE_ROWS} ON l.ext = {EXT})"
TYPED = TYPED.replace("lang_of(ext, language)", "l(ext, language)")


def typed_files(v):
    return v("v_files").withColumn("language", paths.detect_language(F.col("path"))).withColumn("status", F.lit("added"))


@query("corpus_scan", f"WITH {TYPED} SELECT path, language, 'added' AS status, sha256(content) AS digest FROM typed WHERE language IS NOT NULL")
def _(v):
    return corpus.corpus_scan(v("v_files").select("path", "content")).select(
        "path", "language", "status", F.sha2("content", 256).alias("digest")
    )


@query("line_explode", "SELECT path, line, content FROM v_lines")
def _(v):
    return corpus.line_explode(v("v_files").select("path", "content"))


_DIFF = """
WITH l AS (SELECT *, max(line) OVER (PARTITION BY doc_id) AS n FROM v_lines),
one AS (SELECT DISTINCT doc_id, n FROM l)
SELECT doc_id AS diff_id, CASE WHEN status = 'deleted' THEN 'old/doc_' ELSE 'new/doc_' END || doc_id || '.ts' AS path,
  'typescript' AS language, status, CAST(hunk AS BIGINT) AS hunk, CAST(os AS INT) AS old_start, CAST(ol AS INT) AS old_lines,
  CAST(ns AS INT) AS new_start, CAST(nl AS INT) AS new_lines, CAST(line AS BIGINT) AS line, change_type, content
FROM (
  SELECT doc_id, 'added' AS status, 1 AS hunk, 0 AS os, 0 AS ol, 1 AS ns, 9 AS nl, line, 'added' AS change_type, content FROM l WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, 'modified', 1, 3, 1, 5, 1, 3, 'removed', 'was here' FROM one WHERE doc_id % 4 = 1
  UNION ALL SELECT doc_id, 'modified', 1, 3, 1, 5, 1, line + 4, 'context', content FROM l WHERE doc_id % 4 = 1
  UNION ALL SELECT doc_id, 'modified', 1, 3, 1, 5, 1, 5 + n, 'added', 'at end' FROM one WHERE doc_id % 4 = 1
  UNION ALL SELECT doc_id, 'deleted', 1, 1, 9, 0, 0, line, 'removed', content FROM l WHERE doc_id % 4 = 2
  UNION ALL SELECT doc_id, 'renamed', 1, 1, 1, 1, 1, line, 'added', content FROM l WHERE doc_id % 4 = 3
  UNION ALL SELECT doc_id, 'renamed', 2, 90, 2, 95, 2, 90, 'removed', 'gone' FROM one WHERE doc_id % 4 = 3
  UNION ALL SELECT doc_id, 'renamed', 2, 90, 2, 95, 2, 95, 'added', 'came' FROM one WHERE doc_id % 4 = 3
) x"""


@query("diff_lines", _DIFF)
def _(v):
    return corpus.diff_lines(v("v_diff"))


@query("detect_language", f"WITH {TYPED} SELECT path, language FROM typed")
def _(v):
    return v("v_files").select("path", paths.detect_language(F.col("path")).alias("language"))


_MANIFESTS = """
SELECT path, name, version, ecosystem FROM (
  SELECT path, unnest([
    {'name': w1, 'version': p_size || '.0.1'}, {'name': w2, 'version': '=' || p_size}, {'name': 'dev-' || w1, 'version': '1.2'}
  ], recursive := true), 'npm' AS ecosystem FROM v_manifests WHERE p_partkey % 4 = 0
  UNION ALL SELECT path, unnest([
    {'name': 'example.com/' || w1, 'version': 'v1.' || p_size || '.0'}, {'name': 'example.com/' || w2, 'version': 'v0.1'}
  ], recursive := true), 'Go' FROM v_manifests WHERE p_partkey % 4 = 1
  UNION ALL SELECT path, unnest([
    {'name': w1, 'version': '1.' || p_size}, {'name': w2 || '-x', 'version': '0.3'}
  ], recursive := true), 'crates.io' FROM v_manifests WHERE p_partkey % 4 = 2
  UNION ALL SELECT path, 'g.' || w1 || ':' || w2, p_size || '.0', 'Maven' FROM v_manifests WHERE p_partkey % 4 = 3
) x"""


@query("manifest_deps", _MANIFESTS)
def _(v):
    return reports.manifest_deps(v("v_manifests").select("path", "content"))


_LCOV = """
SELECT report_id, CAST(record AS INT) AS record, path, CAST(line AS BIGINT) AS line, CAST(hits AS BIGINT) AS hits FROM (
  SELECT report_id, 0 AS record, 'src/s' || l_suppkey || '.ts' AS path, l_orderkey AS line, l_partkey % 5 AS hits FROM v_lcov
  UNION ALL SELECT report_id, 0, 'src/s' || l_suppkey || '.ts', l_orderkey + 1, l_partkey % 2 FROM v_lcov
  UNION ALL SELECT report_id, 1, 'src/p' || l_partkey || '.ts', CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END,
    CASE WHEN l_linenumber % 2 = 0 THEN 0 END FROM v_lcov
) x"""


@query("lcov_records", _LCOV)
def _(v):
    return reports.lcov_records(v("v_lcov").select("report_id", "report"))


_STATEMENTS = """
SELECT report_id, 'src/s' || l_suppkey || '.ts' AS path, statement, CAST(line AS BIGINT) AS line, CAST(hits AS BIGINT) AS hits FROM (
  SELECT report_id, l_suppkey, '0' AS statement, l_orderkey AS line, l_partkey % 3 AS hits FROM v_stmt_json
  UNION ALL SELECT report_id, l_suppkey, '1', l_orderkey + 7, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 2 ELSE 0 END FROM v_stmt_json
) x"""


@query("statement_coverage", _STATEMENTS)
def _(v):
    return reports.statement_coverage(v("v_stmt_json").select("report_id", "report"))


@query(
    "rule_table",
    "SELECT id, language, kind, rule, message, coalesce(severity, 'warning') AS severity, fix FROM v_rule_rows "
    "WHERE language IS NOT NULL AND rule <> '' AND id <> '' AND message <> ''",
)
def _(v):
    return reports.rule_table(v("v_rule_rows"))


INCLUDE = ["src/**/*.{ts,tsx,mts}", "**/doc_1*.py", "src/src1?/*"]
EXCLUDE = ["src/src3/**", "**/*_7.*"]
KEPT_LANGUAGES = ["typescript", "python", "go", "javascript"]


@query(
    "path_filter",
    f"""WITH {TYPED} SELECT path, language FROM typed WHERE language IN {in_list(KEPT_LANGUAGES)}
    AND (regexp_matches(path, '^src/.*\\.(ts|tsx|mts)$') OR regexp_matches(path, '/doc_1[^/]*\\.py$') OR regexp_matches(path, '^src/src1[^/]/[^/]+$'))
    AND NOT (path LIKE 'src/src3/%' OR regexp_matches(path, '_7\\.[^/]*$'))""",
)
def _(v):
    return corpus.path_filter(typed_files(v), INCLUDE, EXCLUDE, KEPT_LANGUAGES).select("path", "language")


def secret_sql(source):
    tests = ", ".join(
        f"CASE WHEN {hit('content', p, i)} THEN {{'n': {lit(n)}, 's': {lit(s)}}} END" for n, p, i, s in catalog.SECRETS
    )
    return f"""
    SELECT 'security/hardcoded-secret' AS rule_id, m.s AS severity, 'Possible hardcoded ' || m.n || ' detected' AS message,
      path AS file, line, {trim('content')} AS code_snippet
    FROM (SELECT path, line, content, unnest([{tests}]) AS m FROM {source}
      WHERE NOT (starts_with(ltrim(content, {lit(text.SPACES)}), '//') AND contains(content, 'example'))) x WHERE m IS NOT NULL"""


SECRET_INPUT = "(SELECT path, line, content FROM v_secret_lines UNION ALL SELECT path, line, content FROM v_lines) input"


def secret_input(v):
    return v("v_secret_lines").select("path", "line", "content").unionByName(v("v_lines").select("path", "line", "content"))


@query("secret_scan", secret_sql(SECRET_INPUT))
def _(v):
    return line_rules.secret_scan(secret_input(v)).select(*FINDING, "code_snippet")


CUSTOM = [("key", r"key\s*=", "error"), ("the", r"\bthe\b.*\.$", "info"), ("digits", r"\d{4,}", "warning")]


@query(
    "custom_pattern_scan",
    " UNION ALL ".join(
        f"SELECT 'security/custom-{n}' AS rule_id, '{s}' AS severity, 'Custom security pattern matched: {n}' AS message, "
        f"path AS file, line FROM {SECRET_INPUT} WHERE {hit('content', p)}"
        for n, p, s in CUSTOM
    ),
)
def _(v):
    return line_rules.custom_pattern_scan(secret_input(v), CUSTOM).select(*FINDING)


@query(
    "sql_text_predicate",
    f"SELECT path, line, {hit('content', catalog.SQL_VERB, True)} AND {hit('content', catalog.SQL_SHAPE, True)} AS sql_like FROM {SECRET_INPUT}",
)
def _(v):
    return secret_input(v).select("path", "line", text.looks_like_sql(F.col("content")).alias("sql_like"))


UNSAFE = (
    "len(list_filter(regexp_extract_all(regexp_replace({c}, '\\[(?:[^\\]\\\\]|\\\\.)*\\]', '#', 'g'), '\\(([^)]+)\\)(?:[+*]|\\{{[^}}]*,)', 1), "
    "lambda g: regexp_matches(g, '[+*]') AND NOT regexp_matches(g, '[^#.\\\\+*?{{}}()|](?:[^+*?{{]|$)'))) > 0"
)


@query(
    "unsafe_regex_text",
    f"SELECT 'security/unsafe-regex' AS rule_id, 'warning' AS severity, 'Potential ReDoS: regex with nested quantifiers' AS message, "
    f"path AS file, line, content AS code_snippet FROM v_regexes WHERE {UNSAFE.format(c='content')}",
)
def _(v):
    return line_rules.unsafe_regex_text(v("v_regexes")).select(*FINDING, "code_snippet")


_STEM = "regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]+$', '')"
_SHAPES = catalog.NAME_SHAPES


def shape_test(name, shape):
    return "CASE " + shape + " " + " ".join(f"WHEN '{s}' THEN regexp_matches({name}, '{p}')" for s, p in _SHAPES.items()) + " END"


FILE_SHAPE = "CASE WHEN language = 'java' THEN 'PascalCase' WHEN language IN ('python', 'go', 'rust') THEN 'snake_case' ELSE 'kebab-case' END"


@query(
    "file_naming",
    f"""WITH {TYPED}, s AS (SELECT path, {_STEM} AS stem, {FILE_SHAPE} AS shape FROM typed)
    SELECT 'convention/file-naming' AS rule_id, 'warning' AS severity,
      'File ''' || regexp_extract(path, '([^/]*)$', 1) || ''' should use ' || shape || ' naming' AS message, path AS file, CAST(1 AS BIGINT) AS line
    FROM s WHERE NOT ({shape_test('stem', 'shape')})""",
)
def _(v):
    return nodes.file_naming(typed_files(v)).select(*FINDING)


CLASSIFIED = "CASE " + " ".join(f"WHEN regexp_matches(name, '{p}') THEN '{s}'" for s, p in _SHAPES.items()) + " END"


@query(
    "naming_conformance",
    "SELECT DISTINCT name, " + ", ".join(f"regexp_matches(name, '{p}') AS {s.replace('-case', '')}" for s, p in _SHAPES.items()) + " FROM v_names",
)
def _(v):
    return v("v_names").select(
        "name", *[names.matches_shape(F.col("name"), s).alias(s.replace("-case", "")) for s in _SHAPES]
    ).distinct()


@query("classify_name", f"SELECT path, line, name, {CLASSIFIED} AS shape FROM v_names")
def _(v):
    return v("v_names").select("path", "line", "name", names.classify_name(F.col("name")).alias("shape"))


_WORDS = (
    "list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(name, '[-_]', ' ', 'g'), "
    "'([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '\\s+'), lambda w: w <> ''), lambda w: lower(w))"
)
_CAPS = "list_transform(w, lambda x: upper(x[1]) || x[2:])"


@query(
    "convert_name",
    f"""SELECT name, w[1] || array_to_string({_CAPS}[2:], '') AS camel, array_to_string({_CAPS}, '') AS pascal,
      array_to_string(w, '_') AS snake, upper(array_to_string(w, '_')) AS upper_snake, array_to_string(w, '-') AS kebab
    FROM (SELECT name, {_WORDS} AS w FROM (SELECT DISTINCT name FROM (SELECT name FROM v_names UNION ALL SELECT text FROM v_nodes WHERE field = 'name')) n) x""",
)
def _(v):
    all_names = v("v_names").select("name").unionByName(
        only(v.projected("v_nodes"), "field", "name").select(F.col("text").alias("name"))
    ).distinct()
    to = lambda s: names.convert_name(F.col("name"), s)
    return all_names.select(
        "name", to("camelCase").alias("camel"), to("PascalCase").alias("pascal"), to("snake_case").alias("snake"),
        to("UPPER_SNAKE").alias("upper_snake"), to("kebab-case").alias("kebab"),
    )


GLOBS = ["**/*.ts", "src/*/doc_?.{py,go}", "src/**", "*", "src/src[12]/*", "**/doc_1*"]
GLOB_SQL = [r"\.ts$", r"^src/[^/]+/doc_[^/]\.(py|go)$", "^src/.+$", "^[^/]+$", "^src/src[12]/[^/]+$", "(^|/)doc_1[^/]*$"]


@query("glob_match", "SELECT path, " + ", ".join(f"regexp_matches(path, {lit(p)}) AS g{i}" for i, p in enumerate(GLOB_SQL)) + " FROM v_files")
def _(v):
    return v("v_files").select("path", *[paths.glob_match(F.col("path"), g).alias(f"g{i}") for i, g in enumerate(GLOBS)])


@query(
    "posix_join",
    r"SELECT path, line, source, regexp_replace(regexp_extract(path, '^(.*)/', 1) || '/' || source, '[^/]+/\.\./', '') AS target FROM v_imports",
)
def _(v):
    return v("v_imports").select(
        "path", "line", "source", paths.posix_join(paths.dirname(F.col("path")), F.col("source")).alias("target")
    )


@query("file_stem", f"SELECT path, split_part(regexp_extract(path, '([^/]*)$', 1), '.', 1) AS first_dot, {_STEM} AS last_dot FROM v_files")
def _(v):
    return v("v_files").select(
        "path", paths.stem_first_dot(F.col("path")).alias("first_dot"), paths.stem_last_dot(F.col("path")).alias("last_dot")
    )


_PREFIXED = "CASE p_partkey % 6 WHEN 0 THEN '^' WHEN 1 THEN '~' WHEN 2 THEN '>=' WHEN 3 THEN '<' WHEN 4 THEN '=' ELSE '' END || version"


@query("strip_version_prefix", f"SELECT name, regexp_replace({_PREFIXED}, '^[\\^~>=<]', '') AS version FROM v_deps")
def _(v):
    return v("v_deps").select("name", identity.strip_version_prefix(F.expr(_PREFIXED)).alias("version"))


_BOILERPLATE = f"({trim('content')} IN ('{{', '}}', '}});', ']);', ')', ');', 'break;', 'continue;') OR regexp_matches({trim('content')}, '^(?:return|import|export) '))"


@query(
    "boilerplate_line",
    f"SELECT path, line, {_BOILERPLATE} AS boilerplate, regexp_matches({trim('content')}, {rx(chr(94) + r'\w+[\w.]*\(.*\)[;,]?$')}) AS single_call "
    "FROM (SELECT path, line, content FROM v_lines UNION ALL SELECT path, line, content FROM v_import_lines UNION ALL SELECT path, line, 'f.g' || content FROM v_regexes) x",
)
def _(v):
    lines = (
        v("v_lines").select("path", "line", "content")
        .unionByName(v("v_import_lines").select("path", "line", "content"))
        .unionByName(v("v_regexes").select("path", "line", F.concat(F.lit("f.g"), "content").alias("content")))
    )
    trimmed = text.trim(F.col("content"))
    return lines.select(
        "path", "line", text.is_boilerplate(trimmed).alias("boilerplate"), text.is_single_call(trimmed).alias("single_call")
    )


# --- infrastructure files -----------------------------------------------------------------

_IAC = "'warning' AS severity"
_KIND = {"docker": "path LIKE '%/Dockerfile'", "k8s": "path LIKE 'a/k8s/%'", "workflow": "path LIKE '.github/%'"}


def _iac_sql(rule, message, kind, cond):
    return (
        f"SELECT '{rule}' AS rule_id, {_IAC}, {lit(message)} AS message, path AS file, CAST(line AS BIGINT) AS line, {trim('content')} AS code_snippet "
        f"FROM v_iac_lines WHERE {_KIND[kind]} AND {cond}"
    )


def _line_rule_sql(kind):
    parts = []
    for of, rule, patterns, ignore_case, message in line_rules.IAC_LINE_RULES:
        if of != kind:
            continue
        if rule == "iac/docker-add-vs-copy":
            # The look-ahead restated; as there, the blanks after ADD may be given back one by one.
            cond = (
                f"{hit('content', '^' + chr(92) + 's*ADD' + chr(92) + 's+')} AND "
                f"(regexp_matches(content, '^\\s*ADD\\s\\s+\\S') OR NOT regexp_matches(content, '^\\s*ADD\\s+(https?://|\\S+\\.tar)'))"
            )
        else:
            cond = "(" + " OR ".join(hit("content", p, ignore_case) for p in patterns) + ")"
        parts.append(_iac_sql(rule, message, kind, cond))
    return " UNION ALL ".join(parts)


@query("docker_line_rules", _line_rule_sql("docker"))
def _(v):
    return line_rules.docker_line_rules(v("v_iac_lines")).select(*FINDING, "code_snippet")


_DOCKER = (
    "WITH f AS (SELECT path, bool_or(regexp_matches(content, '(?i)^\\s*FROM\\s+')) AS based, bool_or(regexp_matches(content, '(?i)^\\s*USER\\s+')) AS u, "
    f"bool_or(regexp_matches(content, '(?i)^\\s*HEALTHCHECK\\s+')) AS h FROM v_iac_lines WHERE {_KIND['docker']} GROUP BY path) "
    f"SELECT 'iac/docker-run-as-root' AS rule_id, {_IAC}, {lit(line_rules.RUN_ROOT)} AS message, path AS file, CAST(1 AS BIGINT) AS line FROM f WHERE based AND NOT u "
    f"UNION ALL SELECT 'iac/docker-no-healthcheck', 'warning', {lit(line_rules.NO_HEALTHCHECK)}, path, 1 FROM f WHERE based AND NOT h"
)


@query("docker_absence_rules", _DOCKER)
def _(v):
    return line_rules.docker_absence_rules(v("v_iac_lines")).select(*FINDING)


_K8S = f"""
WITH f AS (SELECT path, bool_or(contains(content, 'apiVersion:') OR contains(content, 'kind:')) AS manifest,
    bool_or(contains(content, 'kind: Deployment') OR contains(content, 'kind: Pod') OR contains(content, 'kind: StatefulSet')) AS workload,
    bool_or(regexp_matches(content, '^\\s*resources:')) AS limits FROM v_iac_lines WHERE {_KIND['k8s']} GROUP BY path),
r AS ({_line_rule_sql('k8s')})
SELECT r.* FROM r JOIN f ON f.path = r.file WHERE f.manifest
UNION ALL SELECT 'iac/k8s-no-resource-limits', 'warning', {lit(line_rules.NO_LIMITS)}, path, 1, NULL FROM f WHERE manifest AND workload AND NOT limits"""


@query("k8s_rules", _K8S)
def _(v):
    return line_rules.k8s_rules(v("v_iac_lines")).select(*FINDING, "code_snippet")


@query("workflow_mutable_ref", _line_rule_sql("workflow"))
def _(v):
    return line_rules.workflow_mutable_ref(v("v_iac_lines")).select(*FINDING, "code_snippet")


@query(
    "workflow_script_injection",
    f"""WITH s AS (SELECT *, CASE WHEN regexp_matches(content, '^\\s*run:\\s*') THEN 1
        WHEN regexp_matches(content, '^\\s*\\w+:') AND NOT regexp_matches(content, '^\\s*-') THEN 0 END AS flag
      FROM v_iac_lines WHERE {_KIND['workflow']}),
    c AS (SELECT *, last_value(flag IGNORE NULLS) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS inside FROM s)
    SELECT 'iac/gha-script-injection' AS rule_id, 'warning' AS severity, {lit(line_rules.SCRIPT_INJECTION)} AS message, path AS file, line,
      {trim('content')} AS code_snippet FROM c WHERE inside = 1 AND regexp_matches(content, '\\$\\{{\\{{\\s*github\\.event\\.')""",
)
def _(v):
    return line_rules.workflow_script_injection(v("v_iac_lines")).select(*FINDING, "code_snippet")


@query(
    "iac_file_select",
    """SELECT DISTINCT path, CASE WHEN path LIKE '%/Dockerfile' THEN 'docker' WHEN path LIKE 'a/k8s/%' THEN 'k8s' ELSE 'workflow' END AS iac_kind
    FROM (SELECT path FROM v_iac_lines UNION ALL SELECT 'node_modules/' || path FROM v_iac_lines) x
    WHERE path LIKE '%/Dockerfile' AND path NOT LIKE 'node_modules/%' OR path LIKE 'a/k8s/%' OR path LIKE '.github/%'""",
)
def _(v):
    lines, docs = v("v_iac_lines").select("path"), v("v_files").select("path")
    vendored = lines.select(F.concat(F.lit("node_modules/"), "path").alias("path"))
    return line_rules.iac_file_select(lines.unionByName(docs).unionByName(vendored).distinct())


# --- comments and copies --------------------------------------------------------------------

_COMMENTS = f"""
WITH t AS (SELECT path, line, {trim('content')} AS c FROM v_lines_ann),
f AS (SELECT path, count(*) FILTER (regexp_matches(c, '^(//|/\\*|\\*|#)')) AS n, count(*) AS total,
  min(line) FILTER (regexp_matches(c, '^(//|/\\*|#)')) AS first FROM t WHERE c <> '' GROUP BY path)
SELECT 'ai-smell/excessive-comments' AS rule_id, 'warning' AS severity,
  'Excessive comment-to-code ratio: ' || ({fixed('n * 100', 'total', 0)}) || '% comments (threshold: 15%)' AS message, path AS file, coalesce(first, 1) AS line
FROM f WHERE total >= 5 AND n / total > 0.15"""


@query("comment_ratio", _COMMENTS)
def _(v):
    return line_rules.comment_ratio(v("v_lines_ann"), 0.15).select(*FINDING)


_COPIES = f"""
WITH k AS (SELECT path, line, {trim('content')} AS c FROM v_lines),
o AS (SELECT path, line, c, row_number() OVER w AS pos, count(*) OVER (PARTITION BY path) AS n FROM k WHERE length(c) > 20 WINDOW w AS (PARTITION BY path ORDER BY line)),
s AS (SELECT path, line, pos, list(c) OVER (PARTITION BY path ORDER BY pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS block, n FROM o WHERE n >= 10),
g AS (SELECT path, block, count(*) AS times, min(pos) AS pos, min(line) AS line FROM s
  WHERE len(block) = 6 AND len(list_filter(block, lambda t: NOT (t IN ('{{', '}}', '}});', ']);', ')', ');', 'break;', 'continue;') OR regexp_matches(t, '^(?:return|import|export) '))
    AND NOT regexp_matches(t, {rx(chr(94) + r'\w+[\w.]*\(.*\)[;,]?$')}))) >= 3
  GROUP BY path, block HAVING count(*) >= 2)
SELECT 'ai-smell/copy-paste' AS rule_id, 'warning' AS severity, 'Repeated code block found ' || arg_min(times, pos) || ' times in the same diff' AS message,
  path AS file, arg_min(line, pos) AS line FROM g GROUP BY path"""


def file_line_arrays(files):
    lines = F.transform(
        F.split("content", "\n", -1),
        lambda text, i: F.struct((i + 1).cast("long").alias("line"), text.alias("content")),
    )
    return files.select("path", lines.alias("lines"))


@query("copy_paste_blocks", _COPIES)
def _(v):
    return line_rules.copy_paste_blocks(file_line_arrays(v("v_files"))).select(*FINDING)


@query(
    "changed_line_semi",
    """WITH long AS (SELECT path AS file, line FROM v_lines WHERE length(content) > 60)
    SELECT file, line FROM long WHERE EXISTS (SELECT 1 FROM v_changes c WHERE c.change_type = 'added' AND c.path = long.file AND c.line = long.line)""",
)
def _(v):
    long = line_rules.long_lines(v("v_lines"), 60)
    return line_rules.changed_line_semi(long, v("v_changes"), "file").select("file", "line")


# --- suppression ----------------------------------------------------------------------------


def _directive_sql(keyword, offset, line_form):
    def body(p):
        return f"CASE WHEN regexp_matches(content, '{p}') THEN {trim(f'''regexp_extract(content, '{p}', 1)''')} END"

    slash, hash_, block = body("//\\s*(.*)"), body("#\\s*(.*)"), body("/\\*\\s*(.*?)\\s*\\*/")
    ok = lambda b: f"starts_with({b}, '{keyword}')" + ("" if line_form else f" AND NOT starts_with({b}, '{keyword}-line')")
    rest = lambda b: trim(f"substr({b}, {len(keyword) + 1})")
    chosen = (
        f"CASE WHEN language = 'python' THEN CASE WHEN {ok('b2')} THEN {rest('b2')} END "
        f"WHEN language = 'script' THEN CASE WHEN {ok('b1')} THEN {rest('b1')} WHEN {ok('b3')} THEN {rest('b3')} END END"
    )
    return (
        f"SELECT path, line + {offset} AS line, CASE WHEN r <> '' THEN r END AS rule_id FROM "
        f"(SELECT path, line, {chosen} AS r FROM (SELECT path, line, language, {slash} AS b1, {hash_} AS b2, {block} AS b3 FROM v_lines_ann) a) b WHERE r IS NOT NULL"
    )


_DIRECTIVES = _directive_sql("scan-ignore-line", 0, True) + " UNION ALL " + _directive_sql("scan-ignore", 1, False)


@query("suppression_directives", _DIRECTIVES)
def _(v):
    return results.suppression_directives(v("v_lines_ann"))


_LONG = (
    "SELECT CASE WHEN line % 2 = 0 THEN 'style/line-length' ELSE 'style/other' END AS rule_id, 'info' AS severity, "
    "'Line has ' || length(content) || ' characters' AS message, path AS file, line FROM v_lines_ann WHERE length(content) > 30"
)


@query(
    "suppress",
    f"""WITH d AS ({_DIRECTIVES}), f AS ({_LONG})
    SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.path = f.file AND d.line = f.line AND (d.rule_id IS NULL OR d.rule_id = f.rule_id))""",
)
def _(v):
    lines = v("v_lines_ann")
    other = F.when(F.col("line") % 2 == 0, F.col("rule_id")).otherwise("style/other")
    long = line_rules.long_lines(lines, 30).withColumn("rule_id", other)
    return results.suppress(long, results.suppression_directives(lines)).select(*FINDING)


@query(
    "naming_resolution",
    f"""WITH {TYPED} SELECT path,
      CASE language WHEN 'python' THEN 'camelCase' WHEN 'rust' THEN 'snake_case' WHEN 'tsx' THEN 'PascalCase' ELSE 'camelCase' END AS functions_naming,
      'PascalCase' AS classes_naming,
      CASE language WHEN 'go' THEN 'camelCase' ELSE 'UPPER_SNAKE' END AS constants_naming,
      {FILE_SHAPE} AS files_naming
    FROM typed WHERE language IS NOT NULL""",
)
def _(v):
    overrides = {"python": {"functions": "camelCase"}, "tsx": {"functions": "PascalCase"}}
    known = typed_files(v).filter("language IS NOT NULL")
    resolved = nodes.naming_resolution(known, nodes.DEFAULT_NAMING, overrides)
    return resolved.select("path", *[f"{c}_naming" for c in catalog.NAMING_CATEGORIES])


@query(
    "workspace_settings",
    """SELECT path, CASE WHEN regexp_matches(path, '^src/src1[^/]*/') THEN 'info' WHEN path LIKE '%.py' THEN 'warning' ELSE 'error' END AS fail_on,
      CASE WHEN regexp_matches(path, '^src/src1[^/]*/') THEN 20 WHEN path LIKE '%.py' THEN 5 ELSE 20 END AS max_warnings FROM v_files""",
)
def _(v):
    overrides = [("src/src1*/**", {"fail_on": "info"}), ("**/*.py", {"fail_on": "warning", "max_warnings": 5})]
    base = {"fail_on": "error", "max_warnings": 20}
    return results.first_setting(v("v_files").select("path"), overrides, base)


# --- coverage -------------------------------------------------------------------------------

_PER_FILE = "SELECT path, count(line) AS total, count(*) FILTER (hits > 0) AS covered FROM v_coverage GROUP BY path"


@query(
    "file_coverage",
    f"""SELECT 'coverage/below-threshold' AS rule_id, 'warning' AS severity,
      'File coverage ' || ({fixed('covered * 100', 'total', 1)}) || '% is below threshold 80%' AS message, path AS file, CAST(1 AS BIGINT) AS line
    FROM ({_PER_FILE}) c WHERE total > 0 AND covered / total * 100 < 80""",
)
def _(v):
    return supply.file_coverage(v("v_coverage")).select(*FINDING)


_REPORT_PATHS = """
SELECT doc_id AS ord, CASE doc_id % 4 WHEN 0 THEN 'doc_' || doc_id || '.ts' WHEN 1 THEN '/abs/repo/' || path WHEN 2 THEN '_' || (doc_id % 10) || '.py' ELSE 'none_' || doc_id END AS report_path
FROM v_files"""


@query(
    "coverage_path_match",
    f"""SELECT f.path, arg_min(r.report_path, r.ord) AS report_path FROM v_files f JOIN ({_REPORT_PATHS}) r
      ON ends_with(f.path, r.report_path) OR ends_with(r.report_path, f.path) GROUP BY f.path""",
)
def _(v):
    files = v("v_files")
    report = F.expr(
        "CASE doc_id % 4 WHEN 0 THEN 'doc_' || doc_id || '.ts' WHEN 1 THEN '/abs/repo/' || path "
        "WHEN 2 THEN '_' || (doc_id % 10) || '.py' ELSE 'none_' || doc_id END"
    )
    return supply.coverage_path_match(files, files.select(report.alias("report_path"), F.col("doc_id").alias("ord")))


_CHANGED_CODE = "SELECT DISTINCT 'src/s' || l_suppkey || '.ts' AS path, l_orderkey + l_partkey % 2 AS line FROM lineitem"


@query(
    "new_code_coverage",
    f"""WITH ch AS ({_CHANGED_CODE}), miss AS (SELECT path, line FROM v_coverage GROUP BY path, line HAVING min(hits) <= 0),
    m AS (SELECT ch.*, miss.line IS NOT NULL AS u FROM ch LEFT JOIN miss USING (path, line)),
    low AS (SELECT path FROM m GROUP BY path HAVING (count(*) - count(*) FILTER (u)) / count(*) * 100 < 90),
    r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS i FROM m WHERE u AND path IN (SELECT path FROM low))
    SELECT 'coverage/uncovered-new-code' AS rule_id, 'warning' AS severity, 'New/changed code at line ' || line || ' is not covered by tests' AS message,
      path AS file, line FROM r WHERE i <= 5""",
)
def _(v):
    changed = v.table("lineitem").select(
        F.concat(F.lit("src/s"), "l_suppkey", F.lit(".ts")).alias("path"),
        (F.col("l_orderkey") + F.col("l_partkey") % 2).alias("line"),
    )
    return supply.new_code_coverage(changed, v("v_coverage")).select(*FINDING)


# --- supply chain ---------------------------------------------------------------------------

_MANIFEST = "CASE ecosystem WHEN 'Go' THEN 'go.mod' WHEN 'crates.io' THEN 'Cargo.toml' WHEN 'Maven' THEN 'pom.xml' ELSE 'package.json' END"


@query(
    "vulnerability_join",
    f"""SELECT 'dependency/known-vulnerability' AS rule_id, 'error' AS severity,
      d.name || '@' || d.version || ': ' || a.summary || ' (' || a.advisory_id || ')' AS message, {_MANIFEST.replace('ecosystem', 'd.ecosystem')} AS file, CAST(1 AS BIGINT) AS line
    FROM v_deps d JOIN v_advisories a ON d.name = a.name AND d.ecosystem = a.ecosystem
    WHERE a.introduced <= d.version_key AND (a.fixed IS NULL OR d.version_key < a.fixed)""",
)
def _(v):
    return supply.vulnerability_join(v("v_deps"), v("v_advisories")).select(*FINDING)


@query(
    "license_policy",
    f"""SELECT 'license/incompatible-license' AS rule_id, CASE WHEN l.license LIKE 'GPL%' THEN 'error' ELSE 'warning' END AS severity,
      d.name || '@' || d.version || CASE WHEN l.license LIKE 'GPL%' THEN ' uses denied license: ' || l.license ELSE ' uses license ''' || l.license || ''' not in allowed list' END AS message,
      {_MANIFEST.replace('ecosystem', 'd.ecosystem')} AS file, CAST(1 AS BIGINT) AS line
    FROM v_deps d JOIN v_licenses l ON d.name = l.name AND d.ecosystem = l.ecosystem WHERE l.license IS NOT NULL AND l.license NOT IN ('MIT', 'Apache-2.0', 'BSD-3-Clause')""",
)
def _(v):
    return supply.license_policy(v("v_deps"), v("v_licenses"), ["MIT", "Apache-2.0", "BSD-*"], ["GPL-*"]).select(*FINDING)


@query("manifest_of", f"SELECT name, {_MANIFEST} AS manifest FROM v_deps")
def _(v):
    return v("v_deps").select("name", identity.manifest_of(F.col("ecosystem")).alias("manifest"))


PURL = (
    "'pkg:' || CASE ecosystem WHEN 'npm' THEN 'npm/' || replace(name, '@', '%40') WHEN 'Go' THEN 'golang/' || name WHEN 'crates.io' THEN 'cargo/' || name "
    "ELSE 'maven/' || replace(name, ':', '/') END || '@' || version"
)


@query("package_url", f"SELECT name, {PURL} AS purl FROM v_deps")
def _(v):
    return v("v_deps").select(
        "name", identity.package_url(F.col("name"), F.col("version"), F.col("ecosystem")).alias("purl")
    )
