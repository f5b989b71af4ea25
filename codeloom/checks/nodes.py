"""Queries over the syntax-node table."""

from pyspark.sql import functions as F

from codeloom import catalog
from codeloom.checks.base import FINDING, fixed, hit, in_list, lit, query
from codeloom.checks.lines import UNSAFE, shape_test
from codeloom.operators import graph, nodes
from codeloom.sources import reports

SCRIPT = "language IN ('typescript', 'javascript', 'tsx', 'jsx')"


def head(rule, severity, message, line="start_line"):
    return f"SELECT '{rule}' AS rule_id, '{severity}' AS severity, {message} AS message, n.path AS file, n.{line} AS line"


def child(alias, field):
    return f"JOIN v_nodes {alias} ON {alias}.path = n.path AND {alias}.parent_id = n.node_id AND {alias}.field = '{field}'"


_SQL_LIKE = f"{hit('n.text', catalog.SQL_VERB, True)} AND {hit('n.text', catalog.SQL_SHAPE, True)}"


@query(
    "sql_injection",
    f"""{head('security/sql-injection', 'error', lit('Potential SQL injection: SQL keywords in template literal with interpolation'))}, substr(n.text, 1, 100) AS code_snippet
    FROM v_nodes n WHERE kind = 'template_string' AND {_SQL_LIKE} AND EXISTS (SELECT 1 FROM v_nodes c WHERE c.path = n.path AND c.parent_id = n.node_id AND c.named)
    UNION ALL {head('security/sql-injection', 'error', lit('Potential SQL injection: SQL keywords in string concatenation'))}, NULL
    FROM v_nodes n {child('o', 'operator')} WHERE n.kind = 'binary_expression' AND o.text = '+' AND {_SQL_LIKE}
      AND EXISTS (SELECT 1 FROM v_nodes i WHERE i.path = n.path AND i.kind = 'identifier' AND i.pre > n.pre AND i.pre <= n.post)""",
)
def _(v):
    return nodes.sql_injection(v.projected("v_nodes")).select(*FINDING, "code_snippet")


@query(
    "xss_sinks",
    f"""{head('security/xss', 'error', "'XSS risk: direct assignment to ' || p.text")} FROM v_nodes n {child('l', 'left')}
      JOIN v_nodes p ON p.path = l.path AND p.parent_id = l.node_id AND p.field = 'property'
      WHERE n.kind = 'assignment_expression' AND l.kind = 'member_expression' AND p.text IN ('innerHTML', 'outerHTML')
    UNION ALL {head('security/xss', 'error', "'XSS risk: ' || f.text || '() usage'")} FROM v_nodes n {child('f', 'function')}
      WHERE n.kind = 'call_expression' AND f.text IN ('document.write', 'document.writeln')
    UNION ALL {head('security/xss', 'warning', lit('XSS risk: dangerouslySetInnerHTML usage'))} FROM v_nodes n {child('a', 'name')}
      WHERE n.kind = 'jsx_attribute' AND a.text = 'dangerouslySetInnerHTML'""",
)
def _(v):
    return nodes.xss_sinks(v("v_nodes")).select(*FINDING)


@query(
    "eval_calls",
    f"""{head('security/eval', 'error', "'Dangerous ' || f.text || '() usage detected'")}, 'Avoid ' || f.text || '(); use safer alternatives' AS suggestion
    FROM v_nodes n {child('f', 'function')} WHERE n.kind = 'call_expression' AND f.text IN ('eval', 'Function')""",
)
def _(v):
    return nodes.eval_calls(v.projected("v_nodes")).select(*FINDING, "suggestion")


@query(
    "unsafe_regex",
    f"{head('security/unsafe-regex', 'warning', lit('Potential ReDoS: regex with nested quantifiers'))}, n.text AS code_snippet FROM v_nodes n WHERE n.kind = 'regex' AND {UNSAFE.format(c='n.text')}",
)
def _(v):
    return nodes.unsafe_regex(v.projected("v_nodes")).select(*FINDING, "code_snippet")


@query(
    "type_assertion_any",
    f"""{head('ai-smell/unnecessary-type-assertion', 'warning', lit('Type assertion to "any" — may indicate AI-generated type workaround'))}
    FROM v_nodes n {child('t', 'type')} WHERE n.kind = 'as_expression' AND t.text = 'any'""",
)
def _(v):
    return nodes.type_assertion_any(v.projected("v_nodes")).select(*FINDING)


@query(
    "verbose_error_handling",
    f"""WITH s AS (SELECT n.path, h.start_line AS line, b.end_line - b.start_line AS t, c.end_line - c.start_line AS k
      FROM v_nodes n {child('b', 'body')} {child('h', 'handler')} JOIN v_nodes c ON c.path = h.path AND c.parent_id = h.node_id AND c.field = 'body' WHERE n.kind = 'try_statement')
    SELECT 'ai-smell/verbose-error-handling' AS rule_id, 'warning' AS severity,
      'Catch block (' || k || ' lines) is ' || ({fixed('k', 't', 1)}) || 'x larger than try block (' || t || ' lines)' AS message, path AS file, line
    FROM s WHERE k > t * 3 AND k > 15""",
)
def _(v):
    return nodes.verbose_error_handling(v("v_nodes")).select(*FINDING)


@query(
    "proximity_cluster",
    """WITH l AS (SELECT path, start_line AS line, count(*) AS n FROM v_nodes WHERE kind = 'non_null_expression' GROUP BY ALL),
    w AS (SELECT a.path, a.line, sum(b.n) AS near, min(b.line) AS first FROM l a JOIN l b ON a.path = b.path AND abs(a.line - b.line) < 10 GROUP BY a.path, a.line)
    SELECT 'ai-smell/excessive-non-null-assertions' AS rule_id, 'warning' AS severity, near || ' non-null assertions (!) in close proximity' AS message, path AS file, line
    FROM w WHERE near >= 3 AND first = line""",
)
def _(v):
    return nodes.proximity_cluster(v.projected("v_nodes")).select(*FINDING)


# --- naming -----------------------------------------------------------------------------------

_FREE = in_list(catalog.IGNORED_NAMES)


def naming(label, rule, shape, source):
    return f"""SELECT '{rule}' AS rule_id, 'warning' AS severity, '{label} ''' || name || ''' should use ' || shape || ' naming' AS message, path AS file, line
    FROM (SELECT *, {shape} AS shape FROM ({source}) a) b WHERE name NOT IN {_FREE} AND NOT ({shape_test('name', 'shape')})"""


_SCRIPT_FUNCTIONS = f"""
SELECT n.path, n.language, m.text AS name, m.start_line AS line FROM v_nodes n {child('m', 'name')} LEFT JOIN v_nodes u ON u.path = n.path AND u.parent_id = n.node_id AND u.field = 'value'
WHERE n.{SCRIPT} AND (n.kind IN ('function_declaration', 'method_definition') OR n.kind = 'variable_declarator' AND u.kind IN ('arrow_function', 'function'))
  AND NOT starts_with(m.text, '_') AND m.text <> 'constructor' AND NOT (regexp_matches(n.path, '\\.[jt]sx$') AND regexp_matches(m.text, '^[A-Z]'))
  AND NOT (n.kind = 'method_definition' AND EXISTS (SELECT 1 FROM v_nodes g WHERE g.path = n.path AND g.parent_id = n.node_id AND g.kind IN ('get', 'set')))"""


@query("function_naming", naming("Function", "convention/function-naming", "'camelCase'", _SCRIPT_FUNCTIONS))
def _(v):
    return nodes.function_naming(v("v_nodes")).select(*FINDING)


def kinds(index, languages=catalog.LANGUAGES):
    return "(" + " OR ".join(f"n.language = '{l}' AND n.kind IN {in_list(catalog.LANGUAGE_KINDS[l][index])}" for l in languages) + ")"


_OTHERS = ["python", "go", "rust", "java"]
_OTHER_FUNCTIONS = f"""
SELECT n.path, n.language, m.text AS name, m.start_line AS line FROM v_nodes n {child('m', 'name')}
WHERE {kinds(0, _OTHERS)} AND NOT starts_with(m.text, '_') AND NOT (n.language = 'go' AND regexp_matches(m.text, '^[A-Z]')) AND m.text NOT IN ('constructor', '__init__', 'main')"""


@query(
    "function_naming_multilang",
    naming("Function", "convention/function-naming", "CASE WHEN language IN ('python', 'rust') THEN 'snake_case' ELSE 'camelCase' END", _OTHER_FUNCTIONS),
)
def _(v):
    return nodes.function_naming_multilang(v.projected("v_nodes")).select(*FINDING)


_TYPES = f"SELECT n.path, n.language, m.text AS name, m.start_line AS line FROM v_nodes n {child('m', 'name')} WHERE {kinds(1)}"


@query("class_naming", naming("Type", "convention/class-naming", "'PascalCase'", _TYPES))
def _(v):
    return nodes.class_naming(v.projected("v_nodes")).select(*FINDING)


_CONSTANTS = f"""
SELECT n.path, n.language, m.text AS name, m.start_line AS line FROM v_nodes n {child('m', 'name')} {child('u', 'value')}
  JOIN v_nodes d ON d.path = n.path AND d.node_id = n.parent_id JOIN v_nodes p ON p.path = d.path AND p.node_id = d.parent_id
WHERE n.{SCRIPT} AND n.kind = 'variable_declarator' AND d.kind = 'lexical_declaration' AND p.kind IN ('program', 'export_statement')
  AND m.kind = 'identifier' AND u.kind IN ('string', 'number', 'true', 'false')
  AND EXISTS (SELECT 1 FROM v_nodes c WHERE c.path = d.path AND c.parent_id = d.node_id AND c.text = 'const')"""


@query("constant_naming", naming("Constant", "convention/constant-naming", "'UPPER_SNAKE'", _CONSTANTS))
def _(v):
    return nodes.constant_naming(v("v_nodes")).select(*FINDING)


_HARVEST = f"""
SELECT 'functions' AS category, m.text AS name, n.path FROM v_nodes n {child('m', 'name')}
  WHERE n.kind = 'function_declaration' OR n.kind = 'method_definition' AND m.text <> 'constructor'
UNION ALL SELECT 'functions', m.text, n.path FROM v_nodes n {child('m', 'name')} {child('u', 'value')}
  WHERE n.kind = 'variable_declarator' AND u.kind IN ('arrow_function', 'function', 'function_expression')
UNION ALL SELECT 'classes', m.text, n.path FROM v_nodes n {child('m', 'name')} WHERE n.kind = 'class_declaration'
UNION ALL SELECT 'classes', m.text, n.path FROM v_nodes n {child('m', 'name')} JOIN v_nodes p ON p.path = n.path AND p.node_id = n.parent_id
  WHERE n.kind = 'class_declaration' AND p.kind = 'export_statement'
UNION ALL SELECT 'constants', m.text, n.path FROM v_nodes n {child('m', 'name')} {child('u', 'value')} JOIN v_nodes p ON p.path = n.path AND p.node_id = n.parent_id
  WHERE n.kind = 'variable_declarator' AND u.kind NOT IN ('arrow_function', 'function', 'function_expression') AND p.kind = 'lexical_declaration'
    AND regexp_matches(m.text, '^[A-Z_][A-Z0-9_]*$')
UNION ALL SELECT DISTINCT 'files', split_part(regexp_extract(path, '([^/]*)$', 1), '.', 1), path FROM v_nodes"""


def harvest(v):
    n = v.projected("v_nodes")
    return nodes.name_harvest(n, n.select("path").distinct())


@query("name_harvest", _HARVEST)
def _(v):
    return harvest(v)


def inference(source, order):
    cases = "CASE " + " ".join(f"WHEN regexp_matches(name, '{p}') THEN '{s}'" for s, p in catalog.NAME_SHAPES.items()) + " END"
    ordinal = "CASE shape " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(catalog.NAME_SHAPES)) + " END"
    return f"""
    WITH h AS ({source}), s AS (SELECT *, {cases} AS shape FROM h),
    c AS (SELECT category, shape, count(*) AS n FROM s WHERE shape IS NOT NULL GROUP BY ALL),
    b AS (SELECT *, sum(n) OVER (PARTITION BY category) AS total, row_number() OVER (PARTITION BY category ORDER BY n DESC, {ordinal}) AS i FROM c),
    f AS (SELECT *, row_number() OVER (PARTITION BY category, shape ORDER BY {order}) AS i FROM s)
    SELECT b.category, b.shape AS convention, b.n / b.total * 100 AS confidence, CAST(b.total AS BIGINT) AS total,
      (SELECT string_agg(name, ',' ORDER BY i) FROM f WHERE f.category = b.category AND f.shape = b.shape AND f.i <= 5) AS samples
    FROM b WHERE b.i = 1"""


@query("convention_inference", inference("SELECT category, name, doc_id, line, place FROM v_names", "doc_id, line, place"))
def _(v):
    return nodes.convention_inference(v("v_names"), ["doc_id", "line", "place"])


@query("harvested_convention", inference(_HARVEST, "path, name"))
def _(v):
    return nodes.convention_inference(harvest(v), ["path", "name"])


@query(
    "node_rule_match",
    """WITH r AS (SELECT *, CASE WHEN lower(severity) IN ('error', 'info') THEN lower(severity) ELSE 'warning' END AS sev FROM v_rule_rows
      WHERE language IS NOT NULL AND rule <> '')
    SELECT 'custom/' || r.id AS rule_id, r.sev AS severity, r.message, n.path AS file, n.start_line AS line, substr(n.text, 1, 100) AS code_snippet, r.fix AS suggestion
    FROM v_nodes n JOIN r ON r.kind = n.kind AND (r.language = n.language OR r.language = 'typescript' AND n.language = 'tsx' OR r.language = 'javascript' AND n.language = 'jsx')
    WHERE regexp_matches(n.text, r.rule)""",
)
def _(v):
    return nodes.node_rule_match(v.projected("v_nodes"), reports.rule_table(v("v_rule_rows"))).select(*FINDING, "code_snippet", "suggestion")


# --- complexity -------------------------------------------------------------------------------

_FUNCTIONS = f"""
f AS (SELECT n.path, n.node_id, n.pre, n.post, n.start_line AS line, coalesce(m.text, w.text, '<anonymous>') AS function_name
  FROM v_nodes n LEFT JOIN v_nodes m ON m.path = n.path AND m.parent_id = n.node_id AND m.field = 'name'
  LEFT JOIN v_nodes p ON p.path = n.path AND p.node_id = n.parent_id AND p.kind = 'variable_declarator'
  LEFT JOIN v_nodes w ON w.path = p.path AND w.parent_id = p.node_id AND w.field = 'name'
  WHERE {kinds(0)}),
g AS (SELECT n.path, n.pre FROM v_nodes n {child('o', 'operator')} WHERE n.kind = 'binary_expression' AND o.text IN ('&&', '||', '??'))"""
_BRANCH, _NEST = in_list(catalog.BRANCH_KINDS), in_list(catalog.NESTING_KINDS)

_CYCLOMATIC = f"""
WITH {_FUNCTIONS}, b AS (SELECT path, pre FROM v_nodes WHERE kind IN {_BRANCH} UNION ALL SELECT path, pre FROM g),
s AS (SELECT f.path, f.node_id, f.function_name, f.line, 1 + count(b.pre) AS cyclomatic FROM f LEFT JOIN b ON b.path = f.path AND b.pre > f.pre AND b.pre <= f.post GROUP BY ALL)"""

_COGNITIVE = f"""
WITH {_FUNCTIONS}, t AS (SELECT path, node_id, pre, post FROM v_nodes WHERE kind IN {_NEST}),
i AS (SELECT f.path, f.node_id, t.node_id AS inner_id, t.pre, 1 + count(a.pre) AS w FROM f JOIN t ON t.path = f.path AND t.pre > f.pre AND t.pre <= f.post
  LEFT JOIN t a ON a.path = f.path AND a.pre > f.pre AND a.pre < t.pre AND a.post >= t.pre GROUP BY ALL),
e AS (SELECT path, pre FROM v_nodes WHERE kind = 'else_clause' UNION ALL SELECT path, pre FROM g),
j AS (SELECT path, node_id, w FROM i UNION ALL SELECT f.path, f.node_id, 1 FROM f JOIN e ON e.path = f.path AND e.pre > f.pre AND e.pre <= f.post),
s AS (SELECT f.path, f.node_id, f.function_name, f.line, CAST(coalesce(sum(j.w), 0) AS BIGINT) AS cognitive FROM f LEFT JOIN j ON j.path = f.path AND j.node_id = f.node_id GROUP BY ALL)"""


def scores(df, measure):
    return df.select("path", "node_id", "function_name", F.col("start_line").alias("line"), measure)


@query("cyclomatic_complexity", _CYCLOMATIC + " SELECT path, node_id, function_name, line, cyclomatic FROM s")
def _(v):
    return scores(nodes.cyclomatic_complexity(v.projected("v_nodes")), "cyclomatic")


@query("cognitive_complexity", _COGNITIVE + " SELECT path, node_id, function_name, line, cognitive FROM s")
def _(v):
    return scores(nodes.cognitive_complexity(v.projected("v_nodes")), "cognitive")


def _too_high(measure, limit):
    return f""" SELECT 'complexity/{measure}-too-high' AS rule_id, 'warning' AS severity,
      'Function ''' || function_name || ''' has {measure} complexity ' || {measure} || ' (max: {limit})' AS message, path AS file, line FROM s WHERE {measure} > {limit}"""


@query("complexity_findings", f"SELECT * FROM ({_CYCLOMATIC} {_too_high('cyclomatic', 5)}) a UNION ALL SELECT * FROM ({_COGNITIVE} {_too_high('cognitive', 10)}) b")
def _(v):
    n = v.projected("v_nodes")
    return (
        nodes.complexity_findings(nodes.cyclomatic_complexity(n), "cyclomatic", 5)
        .unionByName(nodes.complexity_findings(nodes.cognitive_complexity(n), "cognitive", 10))
        .select(*FINDING)
    )


@query(
    "nesting_depth",
    """WITH t AS (SELECT page_id, unnest(tags) AS tag, unnest(generate_series(1, len(tags))) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '</?[a-z][a-z0-9]*') AS tags FROM pages) p),
    k AS (SELECT page_id, pos, regexp_replace(tag, '^</?', '') AS kind, starts_with(tag, '</') AS is_close FROM t),
    d AS (SELECT *, CASE WHEN kind IN ('br', 'meta', 'img', 'link', 'hr', 'input') THEN 0 WHEN is_close THEN -1 ELSE 1 END AS delta FROM k)
    SELECT page_id, pos, kind, is_close, CAST(sum(delta) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS depth FROM d""",
)
def _(v):
    marks = nodes.html_nodes(v.table("pages"))
    return nodes.nesting_depth(marks, "page_id", "pos").select("page_id", "pos", "kind", "is_close", "depth")


# --- imports and exports of nodes -----------------------------------------------------------------


def under(kind, names):
    """Rows of `names` joined to the enclosing node of a kind."""
    return f"SELECT i.path, i.node_id, x.name FROM v_nodes i JOIN ({names}) x ON x.path = i.path AND x.pre > i.pre AND x.pre <= i.post WHERE i.kind = '{kind}'"


_SPECIFIERS = f"""
SELECT n.path, n.pre, coalesce(a.text, m.text) AS name, coalesce(a.kind, m.kind) AS name_kind FROM v_nodes n
  LEFT JOIN v_nodes a ON a.path = n.path AND a.parent_id = n.node_id AND a.field = 'alias'
  LEFT JOIN v_nodes m ON m.path = n.path AND m.parent_id = n.node_id AND m.field = 'name' WHERE n.kind = 'import_specifier'
UNION ALL SELECT n.path, n.pre, n.text, 'identifier' FROM v_nodes n JOIN v_nodes p ON p.path = n.path AND p.node_id = n.parent_id
  WHERE n.kind = 'identifier' AND p.kind IN ('import_clause', 'namespace_import')"""

_PY_NAMES = """
SELECT path, pre, text AS name FROM v_nodes WHERE kind = 'dotted_name' AND coalesce(field, '') <> 'module_name'
UNION ALL SELECT n.path, n.pre, coalesce(a.text, m.text, n.text) FROM v_nodes n
  LEFT JOIN v_nodes a ON a.path = n.path AND a.parent_id = n.node_id AND a.field = 'alias'
  LEFT JOIN v_nodes m ON m.path = n.path AND m.parent_id = n.node_id AND m.field = 'name' WHERE n.kind = 'aliased_import'"""

_RUST_NAMES = """
SELECT n.path, n.pre, n.text AS name FROM v_nodes n JOIN v_nodes p ON p.path = n.path AND p.node_id = n.parent_id WHERE n.kind = 'identifier' AND p.kind <> 'scoped_identifier'
UNION ALL SELECT n.path, n.pre, a.text FROM v_nodes n JOIN v_nodes a ON a.path = n.path AND a.parent_id = n.node_id AND a.field = 'alias' WHERE n.kind = 'use_as_clause'"""

_LAST = "regexp_extract({}, '([^/]*)$', 1)"

_IMPORT_EDGES = f"""
WITH sp AS ({_SPECIFIERS}), pn AS ({_PY_NAMES}), rn AS ({_RUST_NAMES}),
e AS (
  SELECT i.path, i.start_line AS line, replace(replace(coalesce(s.text, ''), '"', ''), '''', '') AS source, x.name
  FROM v_nodes i LEFT JOIN v_nodes s ON s.path = i.path AND s.parent_id = i.node_id AND s.field = 'source'
    LEFT JOIN sp x ON x.path = i.path AND x.pre > i.pre AND x.pre <= i.post WHERE i.{SCRIPT} AND i.kind = 'import_statement'
  UNION ALL SELECT i.path, i.start_line, coalesce(s.text, ''), x.name
  FROM v_nodes i LEFT JOIN v_nodes s ON s.path = i.path AND s.parent_id = i.node_id AND s.field = 'module_name'
    LEFT JOIN pn x ON x.path = i.path AND x.pre > i.pre AND x.pre <= i.post WHERE i.language = 'python' AND i.kind IN ('import_statement', 'import_from_statement')
  UNION ALL SELECT i.path, i.start_line, replace(p.text, '"', ''), coalesce(a.text, {_LAST.format("replace(p.text, '\"', '')")})
  FROM v_nodes i JOIN v_nodes p ON p.path = i.path AND p.parent_id = i.node_id AND p.field = 'path'
    LEFT JOIN v_nodes a ON a.path = i.path AND a.parent_id = i.node_id AND a.field = 'name' WHERE i.kind = 'import_spec'
  UNION ALL SELECT i.path, i.start_line, replace(i.text, '"', ''), {_LAST.format("replace(i.text, '\"', '')")}
  FROM v_nodes i JOIN v_nodes d ON d.path = i.path AND d.node_id = i.parent_id AND d.kind = 'import_declaration' WHERE i.language = 'go' AND i.kind = 'interpreted_string_literal'
  UNION ALL SELECT i.path, i.start_line, regexp_replace(regexp_replace(i.text, '^use\\s+', ''), ';$', ''), x.name
  FROM v_nodes i LEFT JOIN rn x ON x.path = i.path AND x.pre > i.pre AND x.pre <= i.post WHERE i.kind = 'use_declaration'
  UNION ALL SELECT path, start_line, regexp_replace(regexp_replace(text, '^import\\s+(static\\s+)?', ''), ';$', ''),
    regexp_extract(regexp_replace(text, ';$', ''), '([^.]*)$', 1) FROM v_nodes WHERE language = 'java' AND kind = 'import_declaration')
SELECT DISTINCT * FROM e"""


@query("import_edges", _IMPORT_EDGES)
def _(v):
    return graph.import_edges(v("v_nodes"))


_EXPORTS = f"""
SELECT i.path, i.text AS name FROM v_nodes i JOIN v_nodes e ON e.path = i.path AND i.pre > e.pre AND i.pre <= e.post
  WHERE e.kind = 'export_statement' AND e.{SCRIPT} AND i.kind IN ('identifier', 'type_identifier')
UNION ALL SELECT n.path, m.text FROM v_nodes n {child('m', 'name')} WHERE n.language = 'go' AND n.kind IN ('function_declaration', 'type_declaration') AND regexp_matches(m.text, '^[A-Z]')
UNION ALL SELECT n.path, m.text FROM v_nodes n {child('m', 'name')} WHERE n.language = 'java' AND n.kind IN ('class_declaration', 'interface_declaration')
UNION ALL SELECT n.path, m.text FROM v_nodes n {child('m', 'name')} JOIN v_nodes p ON p.path = n.path AND p.parent_id = n.node_id AND p.kind = 'visibility_modifier' AND p.text = 'pub'"""


@query("export_names", _EXPORTS)
def _(v):
    return graph.export_names(v.projected("v_nodes"))


@query(
    "unused_imports",
    f"""WITH sp AS ({_SPECIFIERS}), m AS (SELECT i.path, i.start_line AS line, x.name FROM v_nodes i JOIN sp x ON x.path = i.path AND x.pre > i.pre AND x.pre <= i.post
      WHERE i.kind = 'import_statement' AND x.name_kind = 'identifier'),
    u AS (SELECT DISTINCT path, text FROM v_nodes n WHERE kind IN ('identifier', 'type_identifier', 'shorthand_property_identifier')
      AND NOT EXISTS (SELECT 1 FROM v_nodes i WHERE i.kind = 'import_statement' AND i.path = n.path AND n.pre > i.pre AND n.pre <= i.post))
    SELECT 'ai-smell/unused-import' AS rule_id, 'warning' AS severity, 'Unused import: ''' || name || '''' AS message, path AS file, line FROM m
    WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.path = m.path AND u.text = m.name)""",
)
def _(v):
    return graph.unused_imports(v.projected("v_nodes")).select(*FINDING)
