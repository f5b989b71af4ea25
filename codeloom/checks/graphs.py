"""Queries over the import graph, duplicates and taint."""

from pyspark.sql import functions as F

from codeloom import catalog
from codeloom.checks.base import FINDING, lit, query
from codeloom.functions import identity
from codeloom.operators import duplicates, graph, taint

_SUFFIXES = ", ".join(lit(s) for s in catalog.IMPORT_SUFFIXES)
EDGES = f"""
raw AS (SELECT path, line, source, regexp_replace(regexp_extract(path, '^(.*)/', 1) || '/' || source, '[^/]+/\\.\\./', '') AS target FROM v_imports),
cand AS (SELECT path, line, target AS c, 0 AS i FROM raw UNION ALL
  SELECT path, line, regexp_replace(target, '\\.(js|jsx)$', '') || unnest([{_SUFFIXES}]), unnest(generate_series(1, {len(catalog.IMPORT_SUFFIXES)})) FROM raw),
edges AS (SELECT cand.path AS src, arg_min(f.path, i) AS dst, line FROM cand JOIN v_files f ON f.path = cand.c GROUP BY cand.path, line HAVING arg_min(f.path, i) <> cand.path)"""


def edges(v):
    return graph.import_resolve(v("v_imports"), v("v_files"))


@query("import_resolve", f"WITH {EDGES} SELECT src, dst, line FROM edges")
def _(v):
    return edges(v)


@query("distinct_edges", f"WITH {EDGES} SELECT DISTINCT src, dst FROM edges WHERE contains(src, 'src1') AND contains(dst, 'src1')")
def _(v):
    return graph.distinct_edges(edges(v), "src1")


@query(
    "graph_adjacency",
    f"""WITH {EDGES} SELECT src AS path, 'imports' AS relation, dst AS name FROM edges UNION ALL SELECT dst, 'imported_by', src FROM edges
    UNION ALL SELECT path, 'exports', 'exp' || doc_id FROM v_files""",
)
def _(v):
    return graph.graph_adjacency(edges(v), exports(v))


def exports(v):
    return v("v_files").select("path", F.concat(F.lit("exp"), F.col("doc_id").cast("string")).alias("name"))


@query("directory_groups", "SELECT regexp_extract(path, '^(.*)/', 1) AS directory, count(*) AS files, min(path) AS first_file FROM v_files WHERE contains(path, 'src1') GROUP BY 1")
def _(v):
    return graph.directory_groups(v("v_files"), "src1")


def reach(depth):
    return f"""{EDGES}, link AS (SELECT DISTINCT src, dst FROM edges),
    walk AS (SELECT DISTINCT path AS start, path AS node, 0 AS level FROM v_files UNION SELECT w.start, l.src, w.level + 1 FROM walk w JOIN link l ON l.dst = w.node WHERE w.level < {depth}),
    hops AS (SELECT start, node AS consumer, CAST(min(level) AS INT) AS level FROM walk GROUP BY start, node HAVING min(level) > 0)"""


@query("downstream_consumers", f"RECURSIVE WITH {reach(3)} SELECT start, consumer, level FROM hops")
def _(v):
    return graph.consumers(edges(v), v("v_files"), 3)


@query("impacted_files", f"RECURSIVE WITH {reach(2)} SELECT start, consumer FROM hops")
def _(v):
    return graph.impacted_files(edges(v), v("v_files"))


@query(
    "impact_findings",
    f"""RECURSIVE WITH {reach(2)}, o AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY level, consumer) AS i, count(*) OVER (PARTITION BY start) AS n FROM hops)
    SELECT 'impact/downstream-consumers' AS rule_id, 'info' AS severity, 'Changes to this file impact ' || any_value(n) || ' downstream file' || CASE WHEN any_value(n) > 1 THEN 's' ELSE '' END || ': ' ||
      string_agg(consumer, ', ' ORDER BY i) FILTER (i <= 5) || CASE WHEN any_value(n) > 5 THEN ' (+' || (any_value(n) - 5) || ' more)' ELSE '' END AS message,
      start AS file, CAST(1 AS BIGINT) AS line FROM o GROUP BY start""",
)
def _(v):
    return graph.impact_findings(edges(v), v("v_files")).select(*FINDING)


@query(
    "impact_edges",
    f"RECURSIVE WITH {reach(2)}, ch AS (SELECT DISTINCT path FROM v_changes WHERE change_type = 'added' AND length(content) > 60) "
    "SELECT h.start, h.consumer, h.consumer IN (SELECT path FROM ch) AS consumer_changed FROM hops h WHERE h.start IN (SELECT path FROM ch)",
)
def _(v):
    changed = v("v_changes").filter("change_type = 'added' AND length(content) > 60").select("path").distinct()
    return graph.impact_edges(edges(v), changed)


LAYERS = [
    ("api", ["src/src0/**", "src/src1/*", "src/src2/*.go"]),
    ("core", ["src/src[2-9]/**"]),
    ("data", ["src/{src10,src11,src12,src13}/**"]),
]
RULES = [("api", ["core"], []), ("core", [], ["api"]), ("core", ["data"], []), ("data", ["core"], ["core"])]


def layer(path):
    return (
        f"CASE WHEN regexp_matches({path}, '^src/src[01]/') OR regexp_matches({path}, '^src/src2/[^/]*\\.go$') THEN 'api' "
        f"WHEN regexp_matches({path}, '^src/src[2-9]/') THEN 'core' WHEN regexp_matches({path}, '^src/src1[0-3]/') THEN 'data' END"
    )


@query("layer_assign", f"SELECT path, {layer('path')} AS layer FROM v_files")
def _(v):
    return graph.layer_assign(v("v_files"), LAYERS).select("path", "layer")


@query(
    "layer_violation",
    f"""WITH l AS (SELECT path, line, {layer('path')} AS a, {layer("regexp_replace(regexp_extract(path, '^(.*)/', 1) || '/' || source, '[^/]+/[.][.]/', '')")} AS b FROM v_imports)
    SELECT 'architecture/layer-violation' AS rule_id, 'error' AS severity, 'Layer violation: ''' || a || ''' cannot import from ''' || b || '''' AS message, path AS file, line,
      'Refactor to avoid importing from the ''' || b || ''' layer. Allowed layers: ' || CASE a WHEN 'core' THEN 'none' ELSE 'core' END AS suggestion
    FROM l WHERE a <> b AND (a = 'api' AND b <> 'core' OR a = 'core' AND b = 'api' OR a = 'data')""",
)
def _(v):
    return graph.layer_violation(v("v_imports"), LAYERS, RULES).select(*FINDING, "suggestion")


@query(
    "unused_exports",
    f"""WITH {EDGES} SELECT 'dead-code/unused-export' AS rule_id, 'warning' AS severity, 'Export ''exp' || doc_id || ''' is never imported by any other file' AS message,
      path AS file, CAST(1 AS BIGINT) AS line FROM v_files WHERE path NOT IN (SELECT dst FROM edges) AND NOT regexp_matches(path, '/doc_1[^/]*\\.ts$')""",
)
def _(v):
    return graph.unused_exports(v("v_files"), exports(v), edges(v), ["**/doc_1*.ts"]).select(*FINDING)


# --- duplicates ---------------------------------------------------------------------------------

_HALVES = "SELECT block_id, path, 2 AS start_line, end_line // 2 + 1 AS end_line FROM v_blocks"


@query(
    "changed_block_semi",
    f"""WITH b AS ({_HALVES}), c AS (SELECT path, line FROM v_lines WHERE length(content) > 200)
    SELECT block_id, path FROM b WHERE EXISTS (SELECT 1 FROM c WHERE c.path = b.path AND c.line BETWEEN b.start_line AND b.end_line)""",
)
def _(v):
    blocks = v("v_blocks").selectExpr("block_id", "path", "cast(2 as bigint) start_line", "end_line div 2 + 1 as end_line")
    changed = v("v_lines").filter("length(content) > 200").select("path", "line")
    return duplicates.changed_block_semi(blocks, changed).select("block_id", "path")


@query(
    "structural_clones",
    """SELECT block_id, path, start_line, end_line, clone_id, clone_path, clone_start, clone_end FROM (
      SELECT block_id, path, start_line, end_line, lead(block_id) OVER w AS clone_id, lead(path) OVER w AS clone_path, lead(start_line) OVER w AS clone_start, lead(end_line) OVER w AS clone_end
      FROM v_blocks WINDOW w AS (PARTITION BY shape ORDER BY block_id)) x WHERE clone_id IS NOT NULL""",
)
def _(v):
    return duplicates.structural_clones(v("v_blocks"))


@query(
    "clone_groups",
    "SELECT sha256(shape) AS shape_id, min(block_id) AS first_block, count(*) AS blocks, count(*) * (count(*) - 1) // 2 AS pairs FROM v_blocks GROUP BY shape HAVING count(*) > 1",
)
def _(v):
    return duplicates.clone_groups(v("v_blocks"))


@query("shape_hash", "SELECT block_id, sha256(shape) AS shape_id FROM v_blocks")
def _(v):
    return v("v_blocks").select("block_id", identity.shape_key(F.col("shape")).alias("shape_id"))


@query("token_bag", "SELECT block_id, token, count(*) AS n FROM (SELECT block_id, unnest(tokens) AS token FROM v_blocks) t GROUP BY ALL")
def _(v):
    return duplicates.token_bag(v("v_blocks"))


_SIMILAR = """
WITH k AS (SELECT block_id, array_to_string(list_sort(tokens), ' ') AS bag, shape, tokens FROM v_blocks),
g AS (SELECT bag, shape, min(block_id) AS head, count(*) AS blocks, any_value(tokens) AS tokens FROM k GROUP BY bag, shape),
e AS (SELECT bag, token, count(*) AS n FROM (SELECT bag, unnest(tokens) AS token FROM (SELECT DISTINCT ON (bag) bag, tokens FROM g) d) t GROUP BY ALL),
z AS (SELECT bag, sum(n) AS n FROM e GROUP BY bag),
o AS (SELECT a.bag AS ba, b.bag AS bb, sum(least(a.n, b.n)) AS shared FROM e a JOIN e b ON a.token = b.token AND a.bag < b.bag GROUP BY ALL),
s AS (SELECT ba, bb, CAST(shared AS DOUBLE) / CAST(x.n + y.n - shared AS DOUBLE) AS similarity FROM o JOIN z x ON x.bag = ba JOIN z y ON y.bag = bb),
p AS (SELECT a.head AS ha, b.head AS hb, similarity, a.blocks AS na, b.blocks AS nb FROM s JOIN g a ON a.bag = ba JOIN g b ON b.bag = bb WHERE similarity >= 0.85 AND a.shape <> b.shape
  UNION ALL SELECT a.head, b.head, 1.0, a.blocks, b.blocks FROM g a JOIN g b ON a.bag = b.bag AND a.head < b.head WHERE a.head = (SELECT min(head) FROM g c WHERE c.bag = a.bag))
SELECT least(ha, hb) AS first_a, greatest(ha, hb) AS first_b, CAST(similarity AS DOUBLE) AS similarity,
  CASE WHEN ha < hb THEN na ELSE nb END AS blocks_a, CASE WHEN ha < hb THEN nb ELSE na END AS blocks_b FROM p"""


@query("similar_blocks", _SIMILAR)
def _(v):
    return duplicates.similar_blocks(v("v_blocks"))


@query(
    "multiset_jaccard",
    """WITH p AS (SELECT a.block_id, a.tokens AS x, b.tokens AS y FROM v_blocks a JOIN v_blocks b ON b.block_id = a.block_id + 1),
    t AS (SELECT block_id, token, count(*) FILTER (s = 1) AS l, count(*) FILTER (s = 2) AS r FROM (
      SELECT block_id, unnest(x) AS token, 1 AS s FROM p UNION ALL SELECT block_id, unnest(y), 2 FROM p) u GROUP BY ALL)
    SELECT p.block_id AS pair_id, coalesce(CAST(sum(least(l, r)) AS DOUBLE) / CAST(sum(greatest(l, r)) AS DOUBLE), 1.0) AS similarity
    FROM p LEFT JOIN t ON t.block_id = p.block_id GROUP BY p.block_id""",
)
def _(v):
    blocks = v("v_blocks")
    following = blocks.select((F.col("block_id") - 1).alias("pair_id"), F.col("tokens").alias("right"))
    pairs = blocks.select(F.col("block_id").alias("pair_id"), F.col("tokens").alias("left")).join(following, "pair_id")
    return duplicates.multiset_jaccard(pairs)


# --- taint ----------------------------------------------------------------------------------------


def any_of(column, words):
    return "(" + " OR ".join(f"contains({column}, {lit(w)})" for w in words) + ")"


_SANE = lambda c: f"NOT {any_of(c, catalog.SANITIZERS)}"
_SOURCE = lambda c: any_of(c, catalog.TAINT_SOURCES)

TAINTED = f"""
tainted AS (SELECT path, pre, var FROM v_assigns WHERE {_SOURCE('value')} AND {_SANE('value')}
  UNION SELECT a.path, a.pre, a.var FROM tainted t JOIN v_assigns a ON a.path = t.path AND a.pre > t.pre AND contains(a.value, t.var) WHERE {_SANE('a.value')})"""


@query("tainted_assignments", f"RECURSIVE WITH {TAINTED} SELECT path, pre, var FROM tainted")
def _(v):
    return taint.tainted_assignments(v("v_assigns"))


_SINKS = "(VALUES " + ", ".join(f"({lit(p)}, {lit(r)}, {lit(m)})" for p, r, m in catalog.TAINT_SINKS) + ") k(pattern, rule_id, message)"


@query(
    "taint_flow",
    f"""RECURSIVE WITH {TAINTED}, since AS (SELECT path, var, min(pre) AS since FROM tainted GROUP BY path, var)
    SELECT k.rule_id, 'error' AS severity, k.message, c.path AS file, c.line FROM v_calls c JOIN {_SINKS} ON contains(c.callee, k.pattern)
      WHERE {_SANE('c.args')} AND ({_SOURCE('c.args')} OR EXISTS (SELECT 1 FROM since s WHERE s.path = c.path AND s.since < c.pre AND contains(c.args, s.var)))
    UNION ALL SELECT 'taint/xss', 'error', 'Tainted data assigned to innerHTML/outerHTML', a.path, a.line FROM v_assigns a
      WHERE (ends_with(a.var, '.innerHTML') OR ends_with(a.var, '.outerHTML')) AND {_SANE('a.value')}
        AND ({_SOURCE('a.value')} OR EXISTS (SELECT 1 FROM since s WHERE s.path = a.path AND s.since < a.pre AND contains(a.value, s.var)))""",
)
def _(v):
    return taint.taint_flow(v("v_assigns"), v("v_calls").drop("arg0", "arg1")).select(*FINDING)


@query(
    "taint_cross_file",
    f"""WITH src AS (SELECT DISTINCT path, var FROM v_assigns WHERE {_SOURCE('value')} AND {_SANE('value')})
    SELECT 'taint/cross-file-flow' AS rule_id, 'error' AS severity, 'Tainted data flows to ''' || c.callee || '()'' (from ' || e.dst || ') via parameter ' || s.idx AS message, c.path AS file, c.line
    FROM v_calls c JOIN v_user_edges e ON e.src = c.path JOIN v_summaries s ON s.path = e.dst AND s.fn = c.callee
    WHERE c.path IN (SELECT path FROM src) AND {_SANE('CASE s.idx WHEN 0 THEN c.arg0 ELSE c.arg1 END')}
      AND ({_SOURCE('CASE s.idx WHEN 0 THEN c.arg0 ELSE c.arg1 END')} OR EXISTS (SELECT 1 FROM src t WHERE t.path = c.path AND contains(CASE s.idx WHEN 0 THEN c.arg0 ELSE c.arg1 END, t.var)))""",
)
def _(v):
    calls = v("v_calls").withColumn("arg_list", F.array("arg0", "arg1"))
    return taint.taint_cross_file(v("v_assigns"), calls, v("v_user_edges"), v("v_summaries")).select(*FINDING)
