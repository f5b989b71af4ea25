import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeloom.operators import duplicates, edits, graph, line_rules, nodes, results, supply, taint
from codeloom.operators.registry import DetectorRegistry
from codeloom.plans import scan

NODE = "path string, language string, node_id long, parent_id long, field string, kind string, text string, pre long, post long, named boolean, start_line long, end_line long"


def tree(spark, *entries, path="a.ts", language="typescript"):
    """Nodes from (depth, kind, text, field, line); positions follow the order."""
    data, stack = [], []
    for i, (depth, kind, text, field, line) in enumerate(entries, 1):
        del stack[depth:]
        parent = stack[-1] if stack else None
        stack.append(i)
        data.append([path, language, i, parent, field, kind, text, i, i, True, line, line])
        for ancestor in stack:
            data[ancestor - 1][8] = i
    return spark.createDataFrame([tuple(d) for d in data], NODE)


def test_complexity_of_nested_code(spark):
    n = tree(
        spark,
        (0, "program", None, None, 1),
        (1, "function_declaration", None, None, 1),
        (2, "identifier", "outer", "name", 1),
        (2, "if_statement", None, None, 2),
        (3, "binary_expression", None, None, 2),
        (4, "&&", "&&", "operator", 2),
        (3, "for_statement", None, None, 3),
        (4, "while_statement", None, None, 4),
        (3, "else_clause", None, None, 5),
        (4, "if_statement", None, None, 6),
        (2, "arrow_function", None, None, 7),
        (3, "if_statement", None, None, 8),
    )
    got = {r.function_name: r.cyclomatic for r in nodes.cyclomatic_complexity(n).collect()}
    assert got == {"outer": 8, "<anonymous>": 2}
    got = {r.function_name: r.cognitive for r in nodes.cognitive_complexity(n).collect()}
    # if 1, && 1, for 2, while 3, else 1, nested if 2, if in the arrow function 1
    assert got == {"outer": 11, "<anonymous>": 1}


def test_containment_over_many_buckets(spark):
    from codeloom.functions import intervals

    outer = spark.createDataFrame([("p", 1, 0, 500), ("p", 2, 100, 120), ("q", 3, 0, 10)], "path string, node_id long, pre long, post long")
    inner = spark.createDataFrame([("p", i, 1) for i in range(0, 600, 7)], "path string, pre long, w long")
    got = {r.node_id: r.w for r in intervals.subtree_sums(outer, inner, ["w"], width=16).collect()}
    assert got == {1: sum(0 < i <= 500 for i in range(0, 600, 7)), 2: sum(100 < i <= 120 for i in range(0, 600, 7)), 3: 0}


def test_naming_rules(spark, rows):
    n = tree(
        spark,
        (0, "program", None, None, 1),
        (1, "function_declaration", None, None, 1), (2, "identifier", "Bad_name", "name", 1),
        (1, "function_declaration", None, None, 2), (2, "identifier", "_private", "name", 2),
        (1, "lexical_declaration", None, None, 3), (2, "const", "const", None, 3),
        (2, "variable_declarator", None, None, 3), (3, "identifier", "maxSize", "name", 3), (3, "number", "1", "value", 3),
        (1, "class_declaration", None, None, 4), (2, "type_identifier", "my_class", "name", 4),
        (2, "method_definition", None, None, 5), (3, "get", "get", None, 5), (3, "property_identifier", "Odd_one", "name", 5),
    )
    assert rows(nodes.function_naming(n), "message", "line") == [("Function 'Bad_name' should use camelCase naming", 1)]
    assert rows(nodes.constant_naming(n), "message") == [("Constant 'maxSize' should use UPPER_SNAKE naming",)]
    assert rows(nodes.class_naming(n), "message") == [("Type 'my_class' should use PascalCase naming",)]


def test_proximity_across_buckets(spark, rows):
    n = tree(spark, (0, "program", None, None, 1), *[(1, "non_null_expression", "x!", None, l) for l in (14, 16, 17, 40, 60, 61)])
    assert rows(nodes.proximity_cluster(n, width=16), "line", "message") == [(14, "3 non-null assertions (!) in close proximity")]


def test_unused_imports(spark, rows):
    n = tree(
        spark,
        (0, "program", None, None, 1),
        (1, "import_statement", None, None, 1),
        (2, "import_clause", None, None, 1),
        (3, "identifier", "React", None, 1),
        (3, "import_specifier", None, None, 1), (4, "identifier", "parse", "name", 1), (4, "identifier", "parseYaml", "alias", 1),
        (2, "string", "'./x.js'", "source", 1),
        (1, "identifier", "React", None, 3),
    )
    assert rows(graph.unused_imports(n), "message", "line") == [("Unused import: 'parseYaml'", 1)]
    assert rows(graph.import_edges(n), "line", "source", "name") == [(1, "./x.js", "React"), (1, "./x.js", "parseYaml")]


def test_import_graph(spark, rows):
    files = spark.createDataFrame([("src/a.ts",), ("src/b.ts",), ("src/c/index.ts",), ("src/d.ts",)], "path string")
    imports = spark.createDataFrame(
        [("src/a.ts", 1, "./b.js"), ("src/b.ts", 1, "./c"), ("src/d.ts", 1, "./a"), ("src/a.ts", 2, "react"), ("src/a.ts", 3, "./a")],
        "path string, line long, source string",
    )
    edges = graph.import_resolve(imports, files)
    assert rows(edges, "src", "dst") == [("src/a.ts", "src/b.ts"), ("src/b.ts", "src/c/index.ts"), ("src/d.ts", "src/a.ts")]
    start = files.filter("path = 'src/c/index.ts'")
    assert rows(graph.consumers(edges, start, 2), "consumer", "level") == [("src/a.ts", 2), ("src/b.ts", 1)]
    assert graph.consumers(edges, start, 10).count() == 3
    cycle = edges.unionByName(spark.createDataFrame([("src/c/index.ts", "src/d.ts", 1)], "src string, dst string, line long"))
    assert rows(graph.consumers(cycle, start, 10), "consumer") == [("src/a.ts",), ("src/b.ts",), ("src/d.ts",)]


def test_reach_of_many_starts(spark, rows):
    """150 files, three blocks of starts: a hub that all import, a long chain, repeated and
    self links, against a search from every file."""
    name = lambda i: f"src/f{i:03d}.ts"
    links = [(name(i), name(0)) for i in range(1, 150)] + [(name(i), name(i + 1)) for i in range(20, 90)]
    links += [(name(7), name(3)), (name(7), name(3)), (name(5), name(5)), (name(3), name(140)), (name(140), name(7))]
    edges = spark.createDataFrame([(a, b, 1) for a, b in links], "src string, dst string, line long").repartition(3)
    files = spark.createDataFrame([(name(i),) for i in range(150)] + [(name(1),), (None,)], "path string")
    want, text = [], {}
    for start in map(name, range(150)):
        level, seen, found = 0, {start}, []
        step = {start}
        while step and level < 4:
            level += 1
            step = {a for a, b in links if b in step} - seen
            seen |= step
            found += [(level, c) for c in sorted(step)]
        want += [(start, c, at) for at, c in found]
        if found:
            more = f" (+{len(found) - 3} more)" if len(found) > 3 else ""
            text[start] = f"Changes to this file impact {len(found)} downstream file{'s' * (len(found) > 1)}: " + ", ".join(c for _, c in found[:3]) + more
    assert rows(graph.consumers(edges, files, 4), "start", "consumer", "level") == sorted(want)
    masks, blocks = graph.reach(edges, files, 4)
    assert masks.filter("level > 0").count() < len(want)
    assert blocks.selectExpr("max(size(starts))").first()[0] <= graph.MASK_BITS
    assert dict(rows(graph.impact_findings(edges, files, 4, named=3), "file", "message")) == text
    assert graph.impact_findings(edges.limit(0), files).count() == graph.impact_findings(edges, files.limit(0)).count() == 0


def test_layers(spark, rows):
    layers = [("ui", ["ui/**"]), ("db", ["db/**"]), ("any", ["**/*"])]
    rules = [("ui", ["any"], []), ("db", [], ["ui"])]
    imports = spark.createDataFrame(
        [("ui/a.ts", 1, "../db/x"), ("ui/a.ts", 2, "./b"), ("ui/a.ts", 3, "../lib/y"), ("db/x.ts", 4, "../ui/a"), ("lib/y.ts", 5, "../ui/a")],
        "path string, line long, source string",
    )
    assert rows(graph.layer_violation(imports, layers, rules), "file", "line") == [("db/x.ts", 4), ("ui/a.ts", 1)]


def test_copy_paste_true_line(spark, rows):
    block = [f"const value{i} = compute the thing {i};" for i in range(6)]
    content = "\n".join(["short"] + block + ["x", "y"] + block)
    lines = [(i, c) for i, c in enumerate(content.split("\n"), 1)]
    df = spark.createDataFrame([("a.ts", lines)], "path string, lines array<struct<line:long,content:string>>")
    assert rows(line_rules.copy_paste_blocks(df), "line", "message") == [(2, "Repeated code block found 2 times in the same diff")]


def blocks_frame(spark, bags, shapes):
    data = [(i, f"f{i}.ts", 1, 9, bag, shape) for i, (bag, shape) in enumerate(zip(bags, shapes))]
    return spark.createDataFrame(data, "block_id long, path string, start_line long, end_line long, tokens array<string>, shape string")


def jaccard(a, b):
    if not a and not b:
        return 1.0
    x, y = Counter(a), Counter(b)
    return sum((x & y).values()) / sum((x | y).values())


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_blocks_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    bags, shapes = [], []
    for _ in range(60):
        if bags and rnd.random() < 0.6:
            bag = list(rnd.choice(bags))
            for _ in range(rnd.randint(0, 3)):
                if bag and rnd.random() < 0.5:
                    bag.pop(rnd.randrange(len(bag)))
                else:
                    bag.append(rnd.choice("abcdefgh"))
        else:
            bag = rnd.choices("abcdefghij", k=rnd.randint(0, 25))
        bags.append(bag)
        shapes.append(f"s{rnd.randint(0, 30)}")
    got = duplicates.similar_blocks(blocks_frame(spark, bags, shapes), 0.7).collect()
    key = lambda i: (tuple(sorted(bags[i])), shapes[i])
    groups = {}
    for i in range(len(bags)):
        groups.setdefault(key(i), []).append(i)
    wanted = {}
    for a, b in itertools.combinations(groups.values(), 2):
        i, j = a[0], b[0]
        if tuple(sorted(bags[i])) == tuple(sorted(bags[j])):
            head = min(g[0] for k, g in groups.items() if k[0] == key(i)[0])
            if head in (i, j):
                wanted[min(i, j), max(i, j)] = (1.0, 0)
        elif shapes[i] != shapes[j] and jaccard(bags[i], bags[j]) >= 0.7:
            wanted[min(i, j), max(i, j)] = (jaccard(bags[i], bags[j]), 0)
    assert {(r.first_a, r.first_b): round(r.similarity, 9) for r in got} == {k: round(v[0], 9) for k, v in wanted.items()}
    for r in got:
        assert r.blocks_a == len(groups[key(r.first_a)]) and r.blocks_b == len(groups[key(r.first_b)])


def test_similar_bags_compares_only_what_shares_enough(spark):
    # 30 near copies, and 30 texts that have two rare words in common with the next one.
    near = [[f"w{k}" for k in range(100)] + [f"own{i}"] for i in range(30)]
    chance = [[f"t{i}_{k}" for k in range(98)] + [f"link{i}", f"link{i + 1}", f"pair{i // 2}"] for i in range(30)]
    keyed = duplicates.keyed_blocks(blocks_frame(spark, near + chance, [f"s{i}" for i in range(60)]))
    bags = duplicates.numbered_bags(keyed)
    numbers = {r.bag_id for r in bags.filter(F.array_contains("tokens", "w0")).collect()}
    candidates = duplicates._candidates(duplicates._elements(bags), 0.85).collect()
    assert {(r.a, r.b) for r in candidates} == set(itertools.combinations(sorted(numbers), 2))
    # Near copies stay together, so a bag is sent once and not once for each of its pairs.
    assert duplicates._homes(spark.createDataFrame(candidates)).select("home").distinct().count() == 1
    assert duplicates.similar_bags(bags, 0.85).count() == 30 * 29 // 2


def test_token_counts_are_taken_inside_the_row(spark):
    bags = spark.createDataFrame([(1, 5, 1, ["b", "a", "b", "", "b"]), (2, 2, 2, ["a"]), (3, 0, 1, [])], "bag_id long, n int, rows int, tokens array<string>")
    got = {(r.bag_id, r.token): r.c for r in duplicates._token_counts(bags).collect()}
    assert got == {(1, "b"): 3, (1, "a"): 1, (1, ""): 1, (2, "a"): 2}


def test_pairwise_jaccard(spark, rows):
    df = spark.createDataFrame([(1, ["a", "a", "b"], ["a", "b", "b"]), (2, [], []), (3, ["a"], [])], "pair_id long, left array<string>, right array<string>")
    assert rows(duplicates.multiset_jaccard(df)) == [(1, 0.5), (2, 1.0), (3, 0.0)]


def test_clone_links_and_groups(spark, rows):
    b = blocks_frame(spark, [["a"]] * 5, ["x", "y", "x", "x", "z"])
    assert rows(duplicates.structural_clones(b), "block_id", "clone_id") == [(0, 2), (2, 3)]
    assert rows(duplicates.clone_groups(b), "first_block", "blocks", "pairs") == [(0, 3, 3)]


def test_taint_order_and_sanitisers(spark, rows):
    assigns = spark.createDataFrame(
        [
            ("f", 1, 1, "early", "name"), ("f", 2, 2, "name", "req.query.x"), ("f", 3, 3, "later", "`${name}!`"),
            ("f", 4, 4, "safe", "escape(name)"), ("f", 5, 5, "el.innerHTML", "later"), ("g", 6, 6, "other", "name"),
        ],
        "path string, pre long, line long, var string, value string",
    )
    calls = spark.createDataFrame(
        [("f", 7, 7, "db.query", "(later)"), ("f", 8, 8, "db.query", "(safe)"), ("f", 9, 9, "eval", "(early)"), ("g", 10, 10, "eval", "(other)"),
         ("g", 11, 11, "fs.readFile", "(process.argv[2])")],
        "path string, pre long, line long, callee string, args string",
    )
    tainted = taint.tainted_assignments(assigns)
    assert rows(tainted, "path", "var") == [("f", "el.innerHTML"), ("f", "later"), ("f", "name")]
    assert rows(taint.taint_flow(assigns, calls), "rule_id", "file", "line") == [
        ("taint/path-traversal", "g", 11), ("taint/sql-injection", "f", 7), ("taint/xss", "f", 5),
    ]


def test_names_taint_as_substrings(spark, rows):
    texts = spark.createDataFrame([("f", 1, "use(this.name2)"), ("f", 2, "thisname")], "path string, text_id long, text string")
    names = spark.createDataFrame([("f", "this.name"), ("f", "name"), ("g", "use")], "path string, var string")
    assert rows(taint.mentions(texts, names), "text_id", "var") == [(1, "name"), (1, "this.name"), (2, "name")]


def test_function_summaries(spark, rows):
    functions = spark.createDataFrame([("lib.ts", "run", 1, 20, ["cmd", "opts"]), ("lib.ts", "hidden", 30, 40, ["x"])], "path string, fn string, pre long, post long, params array<string>")
    exports = spark.createDataFrame([("lib.ts", "run")], "path string, name string")
    calls = spark.createDataFrame([("lib.ts", 5, "child.exec", "(cmd)"), ("lib.ts", 35, "eval", "(x)"), ("lib.ts", 6, "log", "(opts)")], "path string, pre long, callee string, args string")
    assert rows(taint.function_summaries(functions, exports, calls)) == [("lib.ts", "run", 0)]


def test_coverage_match_of_many_paths(spark, rows):
    names = [f"{a}{b}{c}" for a in ("", "src/", "/abs/src/", "pkg/é/") for b in ("", "x/", "lib/") for c in ("a.ts", "ba.ts", "index.py")]
    reports = [("C:/" + n if i % 3 else n[1:], i * 7 % 50) for i, n in enumerate(names)] + [("ts", 60), (None, 0), ("a.ts", 1), ("a.ts", 99)]
    want = []
    for n in names:
        met = [(o, r) for r, o in reports if r is not None and (n.endswith(r) or r.endswith(n))]
        if met:
            want.append((n, min(met)[1]))
    files = spark.createDataFrame([(n,) for n in names + names[:2] + [None]], "path string")
    frame = spark.createDataFrame(reports, "report_path string, ord long")
    assert rows(supply.coverage_path_match(files, frame)) == sorted(want)
    assert supply.coverage_path_match(files, frame.limit(0)).count() == supply.coverage_path_match(files.limit(0), frame).count() == 0


def test_coverage_match_and_new_code(spark, rows):
    files = spark.createDataFrame([("src/a.ts",), ("src/b.ts",)], "path string")
    reports = spark.createDataFrame([("/repo/src/a.ts", 2), ("a.ts", 3), ("none", 1)], "report_path string, ord long")
    assert rows(supply.coverage_path_match(files, reports)) == [("src/a.ts", "/repo/src/a.ts")]
    coverage = spark.createDataFrame([("f", i, 0 if i <= 7 else 1) for i in range(1, 11)], "path string, line long, hits long")
    changes = spark.createDataFrame([("f", i) for i in range(1, 11)] + [("unmeasured", 1)], "path string, line long")
    assert rows(supply.new_code_coverage(changes, coverage), "line") == [(i,) for i in range(1, 6)]


def test_version_ranges(spark, rows):
    schema = "name string, version string, ecosystem string"
    deps = spark.createDataFrame([("a", "1.9.0", "npm"), ("a", "1.10.0", "npm"), ("a", "2.0", "Go")], schema).withColumn("version_key", supply.version_key(F.col("version")))
    advisories = spark.createDataFrame([("A1", "a", "npm", "1.2", "1.10", "bad")], "advisory_id string, name string, ecosystem string, i string, f string, summary string")
    advisories = advisories.withColumns({"introduced": supply.version_key(F.col("i")), "fixed": supply.version_key(F.col("f"))})
    assert rows(supply.vulnerability_join(deps, advisories), "message", "file") == [("a@1.9.0: bad (A1)", "package.json")]


def test_edits(spark, rows):
    files = spark.createDataFrame([("a.ts", "import { x, y } from 'm'\nfunction Do_it() { Do_it2(); Do_it() }\nend")], "path string, content string")
    from codeloom.sources.corpus import line_explode

    found = spark.createDataFrame([("convention/function-naming", "a.ts", 2, "Function 'Do_it' should use camelCase naming")], "rule_id string, file string, line long, message string")
    renames = edits.rename_edits(found, line_explode(files))
    assert rows(renames, "new_text") == [("function doIt() { Do_it2(); Do_it() }",)]
    cleaned = edits.import_edits(line_explode(files).filter("line = 1").withColumn("name", F.lit("x")))
    assert rows(cleaned, "dropped", "new_text") == [(False, "import { y } from 'm'")]
    all_edits = renames.selectExpr("file as path", "line", "false as dropped", "new_text").unionByName(
        spark.createDataFrame([("a.ts", 3, True, None)], "path string, line long, dropped boolean, new_text string")
    )
    assert rows(edits.apply_edits(files, all_edits), "content") == [("import { x, y } from 'm'\nfunction doIt() { Do_it2(); Do_it() }",)]
    assert rows(edits.apply_edits(files, all_edits.limit(0))) == rows(files)


def test_registry_skips_broken_detectors(spark, rows):
    registry = DetectorRegistry()
    lines = spark.createDataFrame([("a", 1, "x" * 9)], "path string, line long, content string")
    with pytest.warns(UserWarning):
        assert not registry.register("", None)
        registry.load([("wrong", lambda t: t["lines"]), ("boom", lambda t: 1 / 0), ("style", lambda t: line_rules.long_lines(t["lines"], 5))])
        found = registry.run({"lines": lines}, "r")
    assert rows(found, "rule_id", "file", "line", "run_id") == [("style/line-length", "a", 1, "r")]
    assert [name for name, _ in registry.failures] == ["wrong", "boom"]
    registry.register("built-in", lambda t: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        registry.run({"lines": lines}, "r")


def test_new_code_coverage_matches_report_paths(spark, rows):
    files = spark.createDataFrame([("src/a.ts", "x\ny", "typescript", "modified")], "path string, content string, language string, status string")
    diffs = spark.createDataFrame([(1, "diff --git a/src/a.ts b/src/a.ts\n@@ -1,0 +1,2 @@\n+x\n+y")], "diff_id long, diff string")
    coverage = spark.createDataFrame([("/repo/src/a.ts", 1, 0), ("/repo/src/a.ts", 2, 0)], "path string, line long, hits long")
    run = scan.check_diff(diffs, files, "r", coverage=coverage)
    assert ("coverage/uncovered-new-code", "src/a.ts") in rows(run.findings, "rule_id", "file")


def test_dedupe_is_idempotent(spark, rows):
    found = spark.createDataFrame([("r", "x", "f", 1, i) for i in range(4)] + [("r", "x", "f", 2, 9)], "run_id string, rule_id string, file string, line long, seq long")
    once = results.dedupe_findings(found, ["seq"])
    assert rows(once, "line", "seq") == [(1, 0), (2, 9)]
    assert rows(results.dedupe_findings(once, ["seq"])) == rows(once)


def test_diff_run_reports_added_lines_only(spark, rows):
    secret = "password = 'hunter2hunter2'"
    content = f"{secret}\nok\n{secret}\n{secret} // scan-ignore-line"
    files = spark.createDataFrame([("src/my-file.ts", content, "typescript", "modified"), ("src/b.ts", secret, "typescript", "modified")], "path string, content string, language string, status string")
    diff = f"diff --git a/src/my-file.ts b/src/my-file.ts\n@@ -1,2 +1,4 @@\n {secret}\n ok\n+{secret}\n+{secret} // scan-ignore-line"
    diffs = spark.createDataFrame([(1, diff)], "diff_id long, diff string")
    run = scan.check_diff(diffs, files, "r1")
    assert rows(run.findings, "rule_id", "file", "line") == [("security/hardcoded-secret", "src/my-file.ts", 3)]
    assert rows(run.summary, "total_findings", "errors", "total_files") == [(1, 1, 1)]
