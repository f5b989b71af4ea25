"""Input tables of the registered queries, derived from the driver tables.

Each view is one SQL text that Spark and DuckDB both understand; `@name` stands for a
driver table and the few spots where the dialects differ are written as `{{...}}` tokens.
All rows and whole texts of the driver tables are used.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from codeloom.functions.kinds import Asked
from codeloom.session import scan_partitions

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs", ".py", ".go", ".rs", ".java", ".md"]
LANGUAGES = ["typescript", "javascript", "tsx", "jsx", "python", "go", "rust", "java"]


def pick(index: str, values: list[str]) -> str:
    """CASE that maps 0, 1, ... to quoted values (or to SQL when they start with =)."""
    cases = " ".join(
        f"WHEN {i} THEN {v[1:] if v.startswith('=') else quote(v)}" for i, v in enumerate(values)
    )
    return f"CASE {index} {cases} END"


def quote(text: str) -> str:
    """A string literal without characters that only one dialect escapes."""
    pieces, out = re.split(r"([\\\n${}])", text), []
    for piece in pieces:
        if piece and piece in "\\\n${}":
            out.append(f"chr({ord(piece)})")
        elif piece:
            out.append("'" + piece.replace("'", "{{quote}}") + "'")
    return "(" + " || ".join(out) + ")" if len(out) > 1 else (out[0] if out else "''")


def div(a: str, b: int | str) -> str:
    return f"CAST(FLOOR(({a}) / {b}) AS BIGINT)"


NL = "chr(10)"
FIVE_SHAPES = ["camelCase", "PascalCase", "snake_case", "UPPER_SNAKE", "kebab-case"]


def five_names(shape: str, a: str, b: str, k: str) -> str:
    cap = lambda w: w[0].upper() + w[1:]
    return pick(
        shape,
        [f"='{a}{cap(b)}' || {k}", f"='{cap(a)}{cap(b)}' || {k}", f"='{a}_{b}_' || {k}",
         f"='{a.upper()}_{b.upper()}_' || {k}", f"='{a}-{b}-' || {k}"],
    )


VIEWS: dict[str, str] = {}

VIEWS["v_files"] = f"""
SELECT doc_id, 'src/' || source || '/doc_' || doc_id || {pick('doc_id % 13', EXTENSIONS)} AS path, text AS content, lang
FROM @documents"""

VIEWS["v_lines"] = "{{lines:doc_id, path:v_files}}"

VIEWS["v_changes"] = """
SELECT path, line, content, CASE WHEN (doc_id + line) % 3 = 0 THEN 'context' ELSE 'added' END AS change_type
FROM v_lines"""

VIEWS["v_lines_ann"] = """
SELECT path, doc_id, line,
  CASE WHEN doc_id % 13 = 8 THEN 'python' WHEN doc_id % 13 = 12 THEN NULL ELSE 'script' END AS language,
  CASE WHEN line % 13 = 0 THEN '// scan-ignore style/line-length'
       WHEN line % 17 = 0 THEN content || ' /* scan-ignore */'
       WHEN line % 19 = 0 THEN content || ' # scan-ignore'
       WHEN line % 11 = 0 THEN content || ' // scan-ignore-line'
       WHEN line % 7 = 0 THEN '// ' || content
       WHEN line % 5 = 0 THEN 'run: ' || content
       WHEN line % 6 = 0 THEN 'key:'
       ELSE content END AS content
FROM v_lines"""

VIEWS["v_diff"] = f"""
SELECT doc_id AS diff_id,
  'diff --git a/old/doc_' || doc_id || '.ts b/new/doc_' || doc_id || '.ts' || {NL} ||
  CASE doc_id % 4
    WHEN 0 THEN 'new file mode 100644' || {NL} || '@@ -0,0 +1,9 @@' || {NL} || '+' || replace(text, {NL}, {NL} || '+')
    WHEN 1 THEN 'index 1..2' || {NL} || '@@ -3 +5 @@' || {NL} || '-was here' || {NL} || ' ' || replace(text, {NL}, {NL} || ' ') || {NL} || '+at end'
    WHEN 2 THEN 'deleted file mode 100644' || {NL} || '@@ -1,9 +0,0 @@' || {NL} || '-' || replace(text, {NL}, {NL} || '-') || {NL} || chr(92) || ' No newline at end of file'
    ELSE 'rename from old' || {NL} || '@@ -1 +1 @@ head' || {NL} || '+' || replace(text, {NL}, {NL} || '+') || {NL} || '@@ -90,2 +95,2 @@' || {NL} || '-gone' || {NL} || '+came'
  END AS diff
FROM @documents"""

VIEWS["v_words"] = "{{words}}"

VIEWS["v_names"] = """
SELECT category, doc_id, line, place, path,
  CASE doc_id % 5 WHEN 0 THEN lower(w1) WHEN 1 THEN upper(substr(w1, 1, 1)) || lower(substr(w1, 2))
    WHEN 2 THEN lower(w1) || '_' || lower(w2) WHEN 3 THEN upper(w1) || '_' || upper(w2)
    ELSE lower(w1) || '-' || lower(w2) END AS name
FROM (
  SELECT lang AS category, doc_id, line, place, path, {{word:place}} AS w1, {{word:place + 1}} AS w2
  FROM ({{places:lang, doc_id, line, path}}) p
) w WHERE w2 IS NOT NULL"""

# A tree per document: lines of words in groups of six lines. Words that hide a child, plain
# literals, identifiers and keywords by their length.
VIEWS["v_spoken"] = """
SELECT path, doc_id, line, {{div6}} AS part, place, {{word:place}} AS word,
  row_number() OVER (PARTITION BY path ORDER BY line, place) AS seq
FROM ({{places:path, doc_id, line}}) p"""

VIEWS["v_tree_nodes"] = """
SELECT path, 'typescript' AS language, node_id, parent_id, CAST(NULL AS {{string}}) AS field, kind, text, pre, post, TRUE AS named, start_line, end_line
FROM (
  SELECT path, CAST(0 AS BIGINT) AS node_id, CAST(NULL AS BIGINT) AS parent_id, 'function_declaration' AS kind, CAST(NULL AS {{string}}) AS text,
    CAST(0 AS BIGINT) AS pre, 4 * max(seq) + 3 AS post, min(line) AS start_line, max(line) AS end_line FROM v_spoken GROUP BY path
  UNION ALL SELECT path, 4 * min(seq), 0, CASE WHEN part % 2 = 0 THEN 'if_statement' ELSE 'try_statement' END, NULL, 4 * min(seq), 4 * max(seq) + 3, min(line), max(line)
    FROM v_spoken GROUP BY path, part
  UNION ALL SELECT path, 4 * min(seq) + 1, min(head), 'expression_statement', NULL, 4 * min(seq) + 1, 4 * max(seq) + 3, line, line
    FROM (SELECT *, 4 * min(seq) OVER (PARTITION BY path, part) AS head FROM v_spoken) s GROUP BY path, line
  UNION ALL SELECT path, 4 * seq + 2, 4 * head + 1, {{wordkind}}, word, 4 * seq + 2, 4 * seq + 3, line, line
    FROM (SELECT *, min(seq) OVER (PARTITION BY path, line) AS head FROM v_spoken) s
  UNION ALL SELECT path, 4 * seq + 3, 4 * seq + 2, 'string_fragment', word, 4 * seq + 3, 4 * seq + 3, line, line FROM v_spoken WHERE length(word) = 4
) n"""

# Assignments and functions with one call each, as nodes.
VIEWS["v_flow"] = """
SELECT a.path, a.line AS e, 40 * a.line AS b, a.var, a.value, c.callee, c.arg0, c.arg1, c.args,
  CASE WHEN a.line % 3 = 0 THEN c.arg0 ELSE 'p0' END AS p0, CASE WHEN a.line % 5 = 0 THEN c.arg1 ELSE 'p1' END AS p1
FROM v_assigns a JOIN v_calls c ON c.path = a.path AND c.line = a.line"""

_FLOW = [
    # condition, offset, parent's offset, field, kind, text, last offset
    ("TRUE", 0, None, None, "CASE WHEN e % 2 = 0 THEN 'variable_declarator' ELSE 'assignment_expression' END", "var || ' = ' || value", 3),
    ("TRUE", 1, 0, "CASE WHEN e % 2 = 0 THEN 'name' ELSE 'left' END", "'identifier'", "var", 1),
    ("TRUE", 2, 0, "CASE WHEN e % 2 = 0 THEN 'value' ELSE 'right' END", "'expression'", "value", 3),
    ("e % 2 = 0", 5, None, None, "'export_statement'", "'export'", 30),
    ("TRUE", 6, 5, None, "CASE WHEN e % 7 = 0 THEN 'method_definition' ELSE 'function_declaration' END", "'function'", 30),
    ("TRUE", 7, 6, "'name'", "'identifier'", "'f' || e", 7),
    ("e % 11 <> 0", 8, 6, "'parameters'", "'formal_parameters'", "'(...)'", 14),
    ("e % 11 <> 0", 9, 8, None, "'('", "'('", 9),
    ("e % 11 <> 0", 10, 8, None, "'required_parameter'", "'p: any'", 11),
    ("e % 11 <> 0", 11, 10, "'pattern'", "CASE WHEN e % 13 = 0 THEN 'object_pattern' ELSE 'identifier' END", "p0", 11),
    ("e % 11 <> 0", 12, 8, None, "','", "','", 12),
    ("e % 11 <> 0", 13, 8, None, "'identifier'", "p1", 13),
    ("e % 11 <> 0", 14, 8, None, "')'", "')'", 14),
    ("TRUE", 16, 6, None, "'call_expression'", "callee || args", 25),
    ("TRUE", 17, 16, "'function'", "'identifier'", "callee", 17),
    ("TRUE", 18, 16, "'arguments'", "'arguments'", "args", 25),
    ("TRUE", 19, 18, None, "'('", "'('", 19),
    ("TRUE", 20, 18, None, "'expression'", "arg0", 20),
    ("TRUE", 21, 18, None, "','", "','", 21),
    ("TRUE", 22, 18, None, "'expression'", "arg1", 22),
    ("TRUE", 23, 18, None, "')'", "')'", 23),
]
VIEWS["v_flow_nodes"] = " UNION ALL ".join(
    f"SELECT path, 'javascript' AS language, b + {at} AS node_id, CAST({f'b + {parent}' if parent is not None else 'NULL'} AS BIGINT) AS parent_id, "
    f"CAST({field or 'NULL'} AS {{{{string}}}}) AS field, {kind} AS kind, {text} AS text, b + {at} AS pre, b + {last} AS post, TRUE AS named, "
    f"e AS start_line, e AS end_line FROM v_flow WHERE {cond}"
    for cond, at, parent, field, kind, text, last in _FLOW
)

VIEWS["v_blocks"] = "{{blocks}}"

VIEWS["v_imports"] = """
SELECT path, line, '../src' || (t % 20) || '/doc_' || t || '.js' AS source
FROM (
  SELECT path, line, CASE line WHEN 1 THEN (7 * doc_id + 3) % n ELSE (doc_id * doc_id + 1) % n END AS t
  FROM (SELECT path, doc_id, (SELECT count(*) FROM @documents) AS n, {{one_two}} AS line FROM v_files) f
) x"""

VIEWS["v_findings"] = """
SELECT 'rule/' || event_type AS rule_id, event_type AS analyzer,
  CASE WHEN event_type = 'error' THEN 'error' WHEN event_type IN ('purchase', 'signup') THEN 'warning' ELSE 'info' END AS severity,
  props AS message, 'src/u' || user_id || '.ts' AS file, CAST(FLOOR(value) AS BIGINT) + 1 AS line,
  CASE WHEN event_id % 4 = 0 THEN event_id % 80 END AS col,
  CASE WHEN event_id % 5 = 0 THEN CAST(FLOOR(value) AS BIGINT) + 3 END AS end_line,
  CASE WHEN event_id % 6 = 0 THEN event_id % 100 END AS end_col,
  CASE WHEN event_id % 2 = 0 THEN '  ' || props || '   x' END AS code_snippet,
  CASE event_id % 3 WHEN 0 THEN 'use ' || event_type WHEN 1 THEN '' END AS suggestion,
  'repo' || (user_id % 7) AS repo, CAST(CAST(ts AS DATE) AS {{string}}) AS run_id,
  CAST(CAST(ts AS DATE) AS {{string}}) AS run_at, 'scan' AS command, event_id AS seq
FROM @events"""

VIEWS["v_runs"] = """
SELECT repo, run_id, run_id AS run_at, count(*) AS total_findings,
  CAST(sum(CASE WHEN severity = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors,
  CAST(sum(CASE WHEN severity = 'warning' THEN 1 ELSE 0 END) AS BIGINT) AS warnings,
  CAST(sum(CASE WHEN severity = 'info' THEN 1 ELSE 0 END) AS BIGINT) AS infos,
  count(DISTINCT file) AS total_files, 100 + 3 * count(*) AS duration
FROM v_findings GROUP BY repo, run_id"""

VIEWS["v_dismissals"] = """
SELECT DISTINCT 'rule/' || event_type AS rule_id, '"k": ' || (event_id % 10) AS pattern, 'message' AS pattern_type
FROM @events WHERE event_type IN ('error', 'click')
UNION ALL SELECT DISTINCT '*', 'src/u' || (user_id % 5) || '?.ts', 'file' FROM @events"""

VIEWS["v_dismiss_log"] = """
SELECT 'rule/' || event_type AS rule_id, '"k": ' || (event_id % 10) AS pattern,
  CASE event_id % 2 WHEN 0 THEN 'message' ELSE 'file' END AS pattern_type,
  CAST(ts AS DATE) AS dismissed_at, event_id FROM @events"""

VIEWS["v_fixes"] = """
SELECT path, path AS file, line, 'convention/function-naming' AS rule_id, name,
  'Function ' || {{quote_char}} || name || {{quote_char}} || ' should use camelCase naming' AS message
FROM v_names WHERE NOT {{camel:name}}"""

VIEWS["v_coverage"] = """
SELECT 'src/s' || l_suppkey || '.ts' AS path, l_orderkey AS line, l_partkey % 5 AS hits FROM @lineitem"""

VIEWS["v_lcov"] = f"""
SELECT l_orderkey * 1000 + l_linenumber AS report_id,
  'TN:' || {NL} || 'SF:src/s' || l_suppkey || '.ts' || {NL} || 'DA:' || l_orderkey || ',' || (l_partkey % 5) || {NL} ||
  'DA:' || (l_orderkey + 1) || ',' || (l_partkey % 2) || {NL} || 'end_of_record' || {NL} ||
  'SF: src/p' || l_partkey || '.ts ' || {NL} || CASE WHEN l_linenumber % 2 = 0 THEN 'DA:' || l_linenumber || ',0' || {NL} ELSE '' END ||
  'LF:1' || {NL} || 'end_of_record' || {NL} AS report,
  l_orderkey, l_suppkey, l_partkey, l_linenumber
FROM @lineitem"""

VIEWS["v_stmt_json"] = """
SELECT l_orderkey * 1000 + l_linenumber AS report_id,
  '{"src/s' || l_suppkey || '.ts":{"path":"x","statementMap":{"0":{"start":{"line":' || l_orderkey || ',"column":1},"end":{"line":9}},"1":{"start":{"line":' || (l_orderkey + 7) || '}}},"s":{"0":' || (l_partkey % 3) ||
  CASE WHEN l_linenumber % 2 = 0 THEN ',"1":' || (l_partkey % 2) ELSE '' END || '}}}' AS report,
  l_orderkey, l_suppkey, l_partkey, l_linenumber
FROM @lineitem"""

VIEWS["v_deps"] = f"""
SELECT p_brand AS repo, p_partkey AS seq,
  CASE p_partkey % 4 WHEN 0 THEN '@scope/' WHEN 3 THEN 'org.' || p_brand || ':' ELSE '' END || replace(p_name, ' ', '-') || '-' || p_partkey AS name,
  CAST(p_size AS {{{{string}}}}) AS version, p_size AS version_key, {pick('p_partkey % 4', ['npm', 'Go', 'crates.io', 'Maven'])} AS ecosystem,
  p_partkey
FROM @part"""

VIEWS["v_advisories"] = """
SELECT 'ADV-' || p_partkey AS advisory_id, name, ecosystem, version_key - 5 AS introduced,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE version_key + (p_partkey % 7) - 3 END AS fixed, 'bad ' || name AS summary
FROM v_deps"""

VIEWS["v_licenses"] = f"""
SELECT name, ecosystem, {pick('p_partkey % 6', ['MIT', 'Apache-2.0', 'GPL-3.0', 'BSD-3-Clause', '=NULL', 'LGPL-2.1'])} AS license
FROM v_deps"""

VIEWS["v_manifests"] = f"""
SELECT 'r' || p_partkey || '/' || {pick('p_partkey % 4', ['package.json', 'go.mod', 'Cargo.toml', 'pom.xml'])} AS path,
  p_partkey, p_size, w1, w2,
  CASE p_partkey % 4
    WHEN 0 THEN '{{"name":"x","dependencies":{{"' || w1 || '":"^' || p_size || '.0.1","' || w2 || '":">=' || p_size || '"}},"devDependencies":{{"dev-' || w1 || '":"~1.2"}}}}'
    WHEN 1 THEN 'module x' || {NL} || 'require (' || {NL} || chr(9) || 'example.com/' || w1 || ' v1.' || p_size || '.0' || {NL} || chr(9) || 'example.com/' || w2 || ' v0.1' || {NL} || ')'
    WHEN 2 THEN '[dependencies]' || {NL} || w1 || ' = "1.' || p_size || '"' || {NL} || w2 || '-x="0.3"' || {NL} || 'other = {{ version = "1" }}'
    ELSE '<dependency><groupId>g.' || w1 || '</groupId>' || {NL} || ' <artifactId>' || w2 || '</artifactId><version>' || p_size || '.0</version></dependency>'
  END AS content
FROM (SELECT p_partkey, p_size, substr(p_name, 1, instr(p_name, ' ') - 1) AS w1, substr(p_name, instr(p_name, ' ') + 1) AS w2 FROM @part) p"""

VIEWS["v_assigns"] = f"""
SELECT 'u' || user_id AS path, 2 * event_id AS pre, event_id AS line, 'v' || (event_id % 97) || '_' || CASE WHEN event_id % 53 = 0 THEN '.innerHTML' ELSE '' END AS var,
  CASE event_type WHEN 'error' THEN 'req.query' WHEN 'purchase' THEN 'v' || (7 * event_id % 97) || '_'
    WHEN 'signup' THEN 'parseInt(v' || (5 * event_id % 97) || '_)' ELSE '0' END AS value
FROM @events"""

VIEWS["v_calls"] = f"""
SELECT 'u' || user_id AS path, 2 * event_id + 1 AS pre, event_id AS line, {pick('event_id % 3', ['query', 'eval', 'log'])} AS callee,
  '(v' || (11 * event_id % 97) || '_, v' || (13 * event_id % 97) || '_)' AS args,
  'v' || (11 * event_id % 97) || '_' AS arg0, 'v' || (13 * event_id % 97) || '_' AS arg1
FROM @events"""

VIEWS["v_summaries"] = """
SELECT DISTINCT 'u' || user_id AS path, 'query' AS fn, CAST(user_id % 2 AS INT) AS idx FROM @events"""

VIEWS["v_user_edges"] = """
SELECT DISTINCT 'u' || user_id AS src, 'u' || ((7 * user_id + 3) % (SELECT max(user_id) + 1 FROM @events)) AS dst FROM @events"""

_LETTERS = "repeat('Ab1', 20)"
VIEWS["v_secret_lines"] = f"""
SELECT 'src/u' || user_id || '.ts' AS path, event_id AS line, user_id, event_type,
""" + pick("event_id % 18", [
    f"='key = AKIA' || upper(substr({_LETTERS}, 1, 16))",
    f"='aws_secret_access_key=' || substr({_LETTERS}, 1, 40)",
    f"='API_KEY: \"' || substr({_LETTERS}, 1, 24) || '\"'",
    "='  Password = \"pass' || event_id || 'word\"  '",
    "='-----BEGIN RSA ' || 'PRIVATE KEY-----'",
    f"='t = ghp_' || substr({_LETTERS}, 1, 36)",
    "='slack xox' || 'b-' || lpad('' || event_id, 12, '0')",
    f"='jwt eyJ' || substr({_LETTERS}, 1, 12) || '.eyJ' || substr({_LETTERS}, 1, 12) || '.' || substr({_LETTERS}, 1, 12)",
    f"='g AIza' || substr({_LETTERS}, 1, 35)",
    f"='s sk' || '_live_' || substr({_LETTERS}, 1, 24)",
    "='db Postgres://user:' || event_id || '@host/db'",
    "='  // example password = \"pass' || event_id || 'word\"'",
    "='pwd = \"short\"'",
    "='SELECT name FROM t' || event_id || ' WHERE x'",
    "='please UPDATE the text ' || event_id",
    "='insert  into t' || event_id",
    "='token: \"pass' || event_id || 'word\" and sk' || '_test_' || substr(repeat('Zz9', 20), 1, 22)",
    "",
]) + " AS content FROM @events"

VIEWS["v_regexes"] = "SELECT 'src/u' || user_id || '.ts' AS path, event_id AS line, " + pick("event_id % 10", [
    "/(a+)+$/", "/([a-z]+)*x/", "/(_[a-z0-9]+)*/", "/(abc)+/", "/(\\d+){2,}/", "/([\\]x]*)+/", "/(.*)*/", "/plain+/",
    "/(x+y)*/", "/(a+b+)+/",
]) + " AS content FROM @events"

VIEWS["v_iac_lines"] = f"""
SELECT CASE o_custkey % 3 WHEN 0 THEN 'd' || o_custkey || '/Dockerfile' WHEN 1 THEN 'a/k8s/x' || o_custkey || '.yml' ELSE '.github/workflows/w' || o_custkey || '.yml' END AS path,
  o_orderkey AS line,
  CASE o_custkey % 3
  WHEN 0 THEN """ + pick("o_orderkey % 14", [
    "FROM node:latest", "from node:18", "USER app", "HEALTHCHECK CMD x", "RUN curl http://x | sh", "ENV TOKEN=abc",
    "ADD local /x", "ADD http://x /y", "ADD a.tar /x", "COPY a b", "RUN wget -q x | bash -s", "  add lower /x",
    "RUN make", "FROM ubuntu:latestx",
]) + " WHEN 1 THEN " + pick("o_orderkey % 12", [
    "kind: Deployment", "kind: Service", "  privileged: true", "image: nginx:latest", "image: nginx:1.2",
    "  resources:", "apiVersion: v1", "kind: Pod", "Privileged: True", "image: a:latest  ", "name: x", "spec:",
]) + " ELSE " + pick("o_orderkey % 10", [
    "    - run: echo", "  run: |", "   echo ${{ github.event.issue.title }}", "  name: x",
    "  - uses: a/b@main", "    uses: a/b@0123456", "   echo hi", "  - uses: c/d@v1", "env:",
    "  echo ${{github.event.head}} x",
]) + " END AS content FROM @orders"

VIEWS["v_rule_rows"] = f"""
SELECT 'R' || num AS id, {pick('num % 7', ['typescript', 'javascript', 'python', 'go', '=NULL', 'java', 'tsx'])} AS language,
  {pick('num % 4', ['call_expression', 'if_statement', 'regex', 'template_string'])} AS kind,
  {pick('num % 5', ['eval', '.', 'SELECT|INSERT', '^[a-z]+', ''])} AS rule,
  'rule ' || num AS message, {pick('num % 4', ['error', 'INFO', '=NULL', 'fatal'])} AS severity,
  CASE WHEN num % 2 = 0 THEN 'fix ' || num END AS fix
FROM (SELECT DISTINCT CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS num FROM @part) b"""

VIEWS["v_import_lines"] = """
SELECT 'src/u' || user_id || '.ts' AS path, event_id AS line, 'n' || event_id AS name,
""" + pick("event_id % 11", [
    "='import n' || event_id || ' from {{quote}}m{{quote}};'".replace("{{quote}}", '"'),
    "='  import * as n' || event_id || ' from \"m\"'",
    "='import {n' || event_id || '} from \"m\"'",
    "='import { a, n' || event_id || ', b } from \"m\"'",
    "='import { x as n' || event_id || ', n' || event_id || ' as y } from \"m\"'",
    "='import React, { n' || event_id || ' } from \"m\"'",
    "='import React, { n' || event_id || ', k } from \"m\"'",
    "='import type n' || event_id || ' from \"m\"'",
    "='import type { n' || event_id || ' } from \"m\"'",
    "='import \"./n' || event_id || '.css\"'",
    "='const n' || event_id || ' = 1'",
]) + " AS content FROM @events"

# --- syntax nodes -------------------------------------------------------------------------
# One block of 1000 positions per order; a file is a run of eight orders. Every entry is
# (condition, id, parent id, field, kind, text, pre, post, named, start line, end line).


def _node_rows_of_orders() -> list[tuple]:
    lang = lambda values: pick("lang", values)
    ts = "lang < 4"
    fn_name = (
        "CASE WHEN k % 50 = 7 THEN 'constructor' WHEN k % 50 = 9 THEN '_hidden' || k WHEN k % 50 = 11 THEN 'main' "
        "WHEN k % 50 = 13 THEN 'i' ELSE " + five_names("k % 5", "fetch", "row", "k") + " END"
    )
    cls = five_names("(k + 1) % 5", "data", "box", "k")
    const = five_names("(k + 2) % 5", "max", "size", "k")
    other = five_names("k % 5", "load", "all", "k")
    function_kind = lang(["function_declaration"] * 4 + ["function_definition", "function_declaration", "function_item", "method_declaration"])
    class_kind = lang(["class_declaration"] * 4 + ["class_definition", "type_declaration", "struct_item", "class_declaration"])
    second_kind = lang(["interface_declaration"] * 4 + ["class_definition", "type_declaration", "enum_item", "interface_declaration"])
    import_kind = (
        "CASE WHEN lang < 4 THEN 'import_statement' WHEN lang = 4 AND k % 2 = 0 THEN 'import_statement' "
        "WHEN lang = 4 THEN 'import_from_statement' WHEN lang = 6 THEN 'use_declaration' ELSE 'import_declaration' END"
    )
    import_text = "CASE WHEN lang = 6 THEN 'use a::lib' || k || ';' WHEN lang = 7 AND k % 16 = 7 THEN 'import static a.b.Lib' || k || ';' WHEN lang = 7 THEN 'import a.b.Lib' || k || ';' ELSE 'import' END"
    local = "'lib' || k"
    used = f"CASE WHEN k % 3 <> 0 THEN {local} ELSE 'free' || k END"
    N = "NULL"
    first = "k % 8 = 0"
    # The shape of the script import turns with the file, so all four occur.
    style = f"{div('k', 32)} % 4"
    row = lambda cond, i, parent, field, kind, text, pre, post, named="true", line="1", end=None: (
        cond, f"b + {i}" if isinstance(i, int) else i,
        f"b + {parent}" if isinstance(parent, int) else parent, field, kind, text,
        f"b + {pre}", f"b + {post}", named, f"k * 50 + {line}", f"k * 50 + {end if end is not None else line}",
    )
    q = lambda s: f"'{s}'"
    program = f"8000 * {div('k', 8)}"
    rows = [
        # the whole file, written by its first order: 8 blocks wide
        row(first, 0, N, N, q("program"), N, 0, 7999, "true", "1", "400"),
        # imports
        row("true", 1, program, N, import_kind, import_text, 1, 9, "true", "1"),
        row(ts, 2, 1, q("source"), q("string"), "{{quote_char}} || './lib' || k || '.js' || {{quote_char}}", 2, 2),
        row(f"{ts} AND {style} IN (0, 3)", 3, 1, N, q("import_clause"), N, 3, 6),
        row(f"{ts} AND {style} = 0", 4, 3, N, q("identifier"), local, 4, 4),
        row(f"{ts} AND {style} IN (1, 2)", 3, 1, N, q("import_specifier"), N, 3, 6),
        row(f"{ts} AND {style} = 1", 4, 3, q("name"), q("identifier"), local, 4, 4),
        row(f"{ts} AND {style} = 2", 4, 3, q("name"), q("identifier"), "'orig' || k", 4, 4),
        row(f"{ts} AND {style} = 2", 5, 3, q("alias"), q("identifier"), local, 5, 5),
        row(f"{ts} AND {style} = 3", 4, 3, N, q("namespace_import"), N, 4, 5),
        row(f"{ts} AND {style} = 3", 5, 4, N, q("identifier"), local, 5, 5),
        row("lang = 4 AND k % 2 = 1", 2, 1, q("module_name"), q("dotted_name"), "'pkg.mod' || k", 2, 2),
        row("lang = 4 AND k % 3 < 2", 3, 1, q("name"), q("dotted_name"), local, 3, 3),
        row("lang = 4 AND k % 3 = 2", 3, 1, q("name"), q("aliased_import"), f"'orig as ' || {local}", 3, 5),
        row("lang = 4 AND k % 3 = 2", 4, 3, q("name"), q("dotted_name"), "'orig' || k", 4, 4),
        row("lang = 4 AND k % 3 = 2", 5, 3, q("alias"), q("identifier"), local, 5, 5),
        row("lang = 5 AND k % 2 = 0", 2, 1, N, q("import_spec"), N, 2, 4),
        row("lang = 5 AND k % 2 = 0", 3, 2, q("path"), q("interpreted_string_literal"), "'\"ex.com/a/lib' || k || '\"'", 3, 3),
        row("lang = 5 AND k % 4 = 0", 4, 2, q("name"), q("package_identifier"), "'al' || k", 4, 4),
        row("lang = 5 AND k % 2 = 1", 2, 1, N, q("interpreted_string_literal"), "'\"ex.com/b/lib' || k || '\"'", 2, 2),
        row("lang = 6", 2, 1, N, q("scoped_identifier"), "'a::lib' || k", 2, 4),
        row("lang = 6", 3, 2, N, q("identifier"), "'a'", 3, 3),
        row("lang = 6 AND k % 2 = 0", 5, 1, N, q("identifier"), local, 5, 5),
        row("lang = 6 AND k % 2 = 1", 5, 1, N, q("use_as_clause"), "'x as y'", 5, 7),
        row("lang = 6 AND k % 2 = 1", 6, 5, q("alias"), q("type_identifier"), "'Al' || k", 6, 6),
        # types
        row("true", 10, program, N, class_kind, N, 10, 19, "true", "4", "6"),
        row("true", 11, 10, q("name"), q("type_identifier"), cls, 11, 11, "true", "4"),
        row("lang = 6", 12, 10, N, q("visibility_modifier"), "CASE WHEN k % 4 < 2 THEN 'pub' ELSE 'pub(crate)' END", 12, 12),
        row("true", 20, program, N, second_kind, N, 20, 25, "true", "7", "8"),
        row("true", 21, 20, q("name"), q("type_identifier"), five_names("(k + 3) % 5", "my", "kind", "k"), 21, 21, "true", "7"),
        # constants: a literal one and a computed one
        row(ts, 30, program, N, q("lexical_declaration"), N, 30, 35, "true", "9"),
        row(ts, 31, 30, N, q("const"), q("const"), 31, 31, "false", "9"),
        row(ts, 32, 30, N, q("variable_declarator"), N, 32, 34, "true", "9"),
        row(ts, 33, 32, q("name"), q("identifier"), const, 33, 33, "true", "9"),
        row(ts, 34, 32, q("value"), pick("k % 3", ["number", "string", "call_expression"]), q("1"), 34, 34, "true", "9"),
        # a function held by a variable
        row(ts, 40, program, N, q("lexical_declaration"), N, 40, 45, "true", "10", "12"),
        row(ts, 41, 40, N, q("const"), q("const"), 41, 41, "false", "10"),
        row(ts, 42, 40, N, q("variable_declarator"), N, 42, 45, "true", "10", "12"),
        row(ts, 43, 42, q("name"), q("identifier"), other, 43, 43, "true", "10"),
        row(ts, 44, 42, q("value"), q("arrow_function"), N, 44, 45, "true", "10", "12"),
        # a method, every sixth one an accessor
        row(ts, 50, 10, N, q("method_definition"), N, 13, 16, "true", "5"),
        row(ts, 51, 50, q("name"), q("property_identifier"), five_names("(k + 4) % 5", "get", "part", "k"), 14, 14, "true", "5"),
        row(f"{ts} AND k % 6 = 0", 52, 50, N, q("get"), q("get"), 15, 15, "false", "5"),
        # an exported class and an exported name
        row(ts, 60, program, N, q("export_statement"), N, 60, 69, "true", "13"),
        row(f"{ts} AND k % 2 = 0", 61, 60, N, q("class_declaration"), N, 61, 63, "true", "13"),
        row(f"{ts} AND k % 2 = 0", 62, 61, q("name"), q("type_identifier"), five_names("k % 5", "out", "type", "k"), 62, 62, "true", "13"),
        row(ts, 63, 60, N, q("identifier"), "'exp' || k", 64, 64, "true", "13"),
        # a React attribute
        row("lang IN (2, 3) AND k % 3 = 0", 70, program, N, q("jsx_attribute"), N, 70, 72, "true", "14"),
        row("lang IN (2, 3) AND k % 3 = 0", 71, 70, q("name"), q("property_identifier"),
            "CASE WHEN k % 2 = 0 THEN 'dangerouslySetInnerHTML' ELSE 'className' END", 71, 71, "true", "14"),
        # the function and its name, a use of the import
        row("true", 100, program, N, function_kind, N, 100, 999, "true", "15", "49"),
        row("true", 101, 100, q("name"), q("identifier"), fn_name, 101, 101, "true", "15"),
        row("true", 102, 100, N, q("identifier"), used, 102, 102, "true", "16"),
        # error handling
        row("true", 103, 100, N, q("try_statement"), N, 103, 108, "true", "17"),
        row("true", 104, 103, q("body"), q("statement_block"), N, 104, 104, "true", "17", "17 + c % 20"),
        row("true", 105, 103, q("handler"), q("catch_clause"), N, 105, 108, "true", "18 + c % 20"),
        row("true", 106, 105, q("body"), q("statement_block"), N, 106, 107, "true", "18 + c % 20", "18 + c % 20 + k % 60"),
    ]
    return rows


def _node_rows_of_lineitems() -> list[tuple]:
    chain = [
        "if_statement", "for_statement", "while_statement", "else_clause", "catch_clause", "binary_expression",
        "call_expression", "assignment_expression", "as_expression", "non_null_expression", "template_string", "regex",
    ]
    kind = pick("p % 12", chain)
    is_ = lambda name: f"p % 12 = {chain.index(name)}"
    sql_plus = "CASE WHEN s % 3 = 0 THEN 'SELECT a FROM t WHERE x' ELSE 'a + b' END"
    template = pick("s % 3", ["SELECT a FROM t", "please update this", "insert  into t values"])
    regexes = pick("s % 5", ["/(a+)+$/", "/([a-z]+)*x/", "/(_[a-z0-9]+)*/", "/(\\d+){2,}/", "/plain+/"])
    text = (
        f"CASE WHEN {is_('binary_expression')} THEN {sql_plus} WHEN {is_('template_string')} THEN {template} "
        f"WHEN {is_('regex')} THEN {regexes} WHEN {is_('call_expression')} THEN 'eval(x)' ELSE 'stmt' END"
    )
    base, line = "(b + 120 + 20 * j)", "k * 50 + 20 + j"
    leaf = lambda cond, n, field, leaf_kind, leaf_text, named="true", parent=None: (
        cond, f"b + 200 + 10 * j + {n}", parent or "b + 200 + 10 * j", field, leaf_kind, leaf_text,
        f"{base} + {n}", f"{base} + {n}", named, line, line,
    )
    q = lambda s: f"'{s}'"
    parent = "CASE WHEN j = 1 THEN b + 100 ELSE b + 200 + 10 * (j - 1) END"
    member = "b + 200 + 10 * j + 1"
    return [
        ("true", "b + 200 + 10 * j", parent, "NULL", kind, text, base, "b + 990 - 10 * j", "true", line, line),
        leaf(is_("binary_expression"), 1, q("operator"), q("operator"), pick("s % 4", ["&&", "||", "??", "+"]), "false"),
        leaf(f"{is_('binary_expression')} AND s % 2 = 1", 2, q("left"), q("identifier"), q("a")),
        leaf(is_("call_expression"), 1, q("function"), q("identifier"),
             pick("s % 6", ["eval", "Function", "document.write", "query", "log", "exec"])),
        leaf(is_("call_expression"), 2, q("arguments"), q("arguments"), q("(x)")),
        (is_("assignment_expression"), member, "b + 200 + 10 * j", q("left"), q("member_expression"), q("a.b"),
         f"{base} + 1", f"{base} + 2", "true", line, line),
        leaf(is_("assignment_expression"), 2, q("property"), q("property_identifier"),
             pick("s % 3", ["innerHTML", "outerHTML", "value"]), parent=member),
        leaf(is_("as_expression"), 1, q("type"), q("predefined_type"), pick("s % 3", ["any", "unknown", "string"])),
        leaf(f"{is_('template_string')} AND ln % 2 = 0", 1, "NULL", q("template_substitution"), quote("${a}")),
    ]


def _node_view(source: str, rows: list[tuple]) -> str:
    names = ["node_id", "parent_id", "field", "kind", "text", "pre", "post", "named", "start_line", "end_line"]
    types = ["BIGINT", "BIGINT", "{{string}}", "{{string}}", "{{string}}", "BIGINT", "BIGINT", "BOOLEAN", "BIGINT", "BIGINT"]
    items = []
    for cond, *values in rows:
        fields = [(n, f"CAST({v} AS {t})") for n, v, t in zip(names, values, types)]
        items.append((cond, fields))
    tokens = ";;".join(
        cond + "??" + "&&&".join(f"{n}=={v}" for n, v in fields) for cond, fields in items
    )
    return "{{nodes:" + source + "##" + tokens + "}}"


_PATH = f"'src/f' || {div('k', 8)} || {pick(div('k', 8) + ' % 8', ['.ts', '.js', '.tsx', '.jsx', '.py', '.go', '.rs', '.java'])}"
VIEWS["v_order_base"] = f"""
SELECT o_orderkey AS k, o_custkey AS c, 1000 * o_orderkey AS b, {div('o_orderkey', 8)} % 8 AS lang FROM @orders"""
VIEWS["v_item_base"] = f"""
SELECT l_orderkey AS k, 1000 * l_orderkey AS b, {div('l_orderkey', 8)} % 8 AS lang, l_partkey AS p, l_suppkey AS s, l_linenumber AS ln,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS j
FROM @lineitem"""
VIEWS["v_order_nodes"] = _node_view("v_order_base", _node_rows_of_orders())
VIEWS["v_item_nodes"] = _node_view("v_item_base", _node_rows_of_lineitems())
VIEWS["v_nodes"] = f"""
SELECT {_PATH} AS path, {pick(div('k', 8) + ' % 8', LANGUAGES)} AS language, node_id, parent_id, field, kind, text, pre, post, named, start_line, end_line
FROM (SELECT * FROM v_order_nodes UNION ALL SELECT * FROM v_item_nodes) n"""

# --- dialects -----------------------------------------------------------------------------


def _given(expression: str) -> set[str] | None:
    """The strings that a literal or a CASE of literals may give; None when it is neither."""
    value = expression.removeprefix("CAST(").removesuffix(" AS STRING)")
    literals = set(re.findall(r"'([^']*)'", value))
    if value == "NULL" or re.fullmatch(r"'[^']*'", value):
        return literals
    plain = value.startswith("CASE ") and value.endswith(" END") and not re.search(r"\b(THEN|ELSE) (?!'[^']*' (WHEN|ELSE|END)\b)", value)
    return literals if plain else None


def _nodes(token: str, spark: bool, asked: Asked = ()) -> str:
    source, body = token.split("##", 1)
    items = []
    for item in body.split(";;"):
        cond, rest = item.split("??", 1)
        items.append((cond, [f.split("==", 1) for f in rest.split("&&&")]))
    if spark:
        # One projection for each kind of row, so that a filter on kind or field leaves the others out;
        # those that cannot hold the rows asked for are not even planned.
        held = lambda fields: all((given := _given(dict(fields).get(c, ""))) is None or given & values for c, values in asked)
        items = [item for item in items if held(item[1])] or [("FALSE", items[0][1])]
        return " UNION ALL ".join(
            f"SELECT k, {', '.join(f'{v} AS {n}' for n, v in fields)} FROM {source} WHERE {cond}" for cond, fields in items
        )
    packed = lambda fields: "{" + ", ".join(f"'{n}': {v}" for n, v in fields) + "}"
    structs = [f"CASE WHEN {cond} THEN {packed(fields)} END" for cond, fields in items]
    return (
        f"SELECT k, unnest(n) FROM (SELECT k, unnest([{', '.join(structs)}]) AS n FROM {source}) x WHERE n IS NOT NULL"
    )


def _render(sql: str, spark: bool, asked: Asked = ()) -> str:
    def token(match: re.Match) -> str:
        name, _, arg = match[1].partition(":")
        if name == "string":
            return "STRING" if spark else "VARCHAR"
        if name == "quote":
            return "\\'" if spark else "''"
        if name == "one_two":
            return "explode(array(1L, 2L))" if spark else "unnest([1, 2]::BIGINT[])"
        if name == "quote_char":
            return "chr(39)"
        if name == "camel":
            return f"{arg} RLIKE '^[a-z][a-zA-Z0-9]*$'" if spark else f"regexp_matches({arg}, '^[a-z][a-zA-Z0-9]*$')"
        if name == "lines":
            columns, source = arg.split(":")
            if spark:
                return (
                    f"SELECT {columns}, CAST(pos AS BIGINT) + 1 AS line, content, lang FROM "
                    f"(SELECT {columns}, lang, posexplode(split(content, '\\n', -1)) AS (pos, content) FROM {source}) x"
                )
            return (
                f"SELECT {columns}, CAST(unnest(generate_series(1, len(ls))) AS BIGINT) AS line, unnest(ls) AS content, lang "
                f"FROM (SELECT *, string_split(content, chr(10)) AS ls FROM {source}) x"
            )
        if name == "words":
            array = "split(content, '[^A-Za-z]+')" if spark else "string_split_regex(content, '[^A-Za-z]+')"
            keep = "filter" if spark else "list_filter"
            lam = "w -> w <> ''" if spark else "lambda w: w <> ''"
            return f"SELECT path, doc_id, line, lang, {keep}({array}, {lam}) AS words FROM v_lines"
        if name == "word":
            # Spark's rows carry the word at their place and the next one, see below.
            return {"place": "pair.words", "place + 1": "pair.following"}[arg] if spark else f"words[{arg}]"
        if name == "places":
            if spark:
                # The words of a line are not copied to each of its places: a line may hold a whole text.
                return (
                    f"SELECT {arg}, pos + 1 AS place, pair FROM (SELECT {arg}, posexplode(arrays_zip(words, following)) AS (pos, pair) "
                    f"FROM (SELECT *, slice(words, 2, size(words)) AS following FROM v_words WHERE size(words) > 0) w) x"
                )
            return f"SELECT {arg}, words, unnest(range(1, len(words) + 1)::INT[]) AS place FROM v_words WHERE len(words) > 0"
        if name == "div6":
            return "(line - 1) div 6" if spark else "(line - 1) // 6"
        if name == "wordkind":
            return "CASE length(word) % 4 WHEN 0 THEN 'string' WHEN 1 THEN 'identifier' WHEN 2 THEN 'number' ELSE 'keyword' END"
        if name == "blocks":
            if spark:
                words = "filter(split(lower(content), '[^a-z]+'), w -> w <> '')"
                shape = "regexp_replace(regexp_replace(content, '[A-Za-z]+', '@'), '[0-9]+', '#')"
            else:
                words = "list_filter(string_split_regex(lower(content), '[^a-z]+'), lambda w: w <> '')"
                shape = "regexp_replace(regexp_replace(content, '[A-Za-z]+', '@', 'g'), '[0-9]+', '#', 'g')"
            n = f"(length(content) - length(replace(content, chr(10), '')) + 1)"
            return (
                f"SELECT doc_id AS block_id, path, CAST(1 AS BIGINT) AS start_line, CAST({n} AS BIGINT) AS end_line, "
                f"{words} AS tokens, {shape} AS shape FROM v_files WHERE {n} >= 5"
            )
        if name == "nodes":
            return _nodes(arg, spark, asked)
        raise KeyError(name)

    previous = None
    while previous != sql:
        previous = sql
        sql = re.sub(r"\{\{((?:(?!\{\{|\}\}).)*)\}\}", token, sql, flags=re.S)
    return sql


# Views that tokens name.
_HIDDEN = {"v_words": " v_lines", "v_blocks": " v_files", "v_names": " v_words", "v_spoken": " v_words"}


def _needs(names: list[str], stored: Iterable[str] = ()) -> list[str]:
    """The views in dependency order; what a stored one was made of is not needed."""
    done: list[str] = []

    def add(name: str) -> None:
        if name in done:
            return
        for other in VIEWS if name not in stored else ():
            if other != name and re.search(rf"\b{other}\b", VIEWS[name] + _HIDDEN.get(name, "")):
                add(other)
        done.append(name)

    for name in names:
        add(name)
    return done


def _scan(spark: SparkSession, folder: str, table: str) -> str:
    """The table in SQL, spread over all cores when its files are fewer."""
    source = f"parquet.`{folder}/{table}.parquet`"
    cores = scan_partitions(spark.table(source))
    return f"(SELECT /*+ REPARTITION({cores}) */ * FROM {source})" if cores else source


def spark_view(
    spark: SparkSession, folder: str, name: str, stored: Callable[[str], str] | None = None, among: Iterable[str] = (), asked: Asked = ()
) -> DataFrame:
    """The view over the driver tables; views `among` those that are stored are read from the
    temporary view that `stored` names. Rows of nodes that are not `asked` for may be left out."""
    among = [view for view in among if view != name]
    parts = []
    for view in _needs([name], among):
        if view in among:
            parts.append(f"{view} AS (SELECT * FROM {stored(view)})")
            continue
        sql = _render(VIEWS[view], True, asked)
        sql = re.sub(r"@(\w+)", lambda m: _scan(spark, folder, m[1]) if m[1] in TABLES else m[0], sql)
        parts.append(f"{view} AS ({sql})")
    return spark.sql(f"WITH {', '.join(parts)} SELECT * FROM {name}")


def duck_views(body: str) -> str:
    """CTEs of the views that an oracle query names, followed by the query."""
    names = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    parts = []
    for view in _needs(names):
        sql = re.sub(r"@(\w+)", lambda m: m[1] if m[1] in TABLES else m[0], _render(VIEWS[view], False))
        parts.append(f"{view} AS ({sql})")
    recursive = "RECURSIVE " if re.match(r"\s*RECURSIVE\b", body) else ""
    body = re.sub(r"^\s*RECURSIVE\b", "", body)
    more = re.match(r"\s*WITH\b(.*)", body, flags=re.S)
    if not parts:
        return body if not recursive else f"WITH RECURSIVE {more[1]}"
    if more:
        return f"WITH {recursive}{', '.join(parts)}, {more[1]}"
    return f"WITH {recursive}{', '.join(parts)} {body}"
