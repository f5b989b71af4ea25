import re

from codeloom.functions import paths
from codeloom.sources import corpus, reports, stores
from codeloom.operators import results
from codeloom.streaming import incremental

DIFF = """diff --git a/src/a.ts b/src/a.ts
index 1..2 100644
--- a/src/a.ts
+++ b/src/a.ts
@@ -1,3 +1,4 @@ head
 one
-two
+TWO
+extra
 three
@@ -10 +11 @@
-old
+new
\\ No newline at end of file
diff --git a/gone.py b/gone.py
deleted file mode 100644
@@ -1,2 +0,0 @@
-x
-y
diff --git a/old.go b/new.go
similarity index 90%
rename from old.go
rename to new.go
@@ -5,0 +6 @@
+z"""


def test_diff_lines(spark, rows):
    df = corpus.diff_lines(spark.createDataFrame([(1, DIFF)], "diff_id long, diff string"))
    got = [tuple(r) for r in df.orderBy("path", "hunk", "line", "change_type").select("path", "status", "line", "change_type", "content").collect()]
    assert got == [
        ("gone.py", "deleted", 1, "removed", "x"),
        ("gone.py", "deleted", 2, "removed", "y"),
        ("new.go", "renamed", 6, "added", "z"),
        ("src/a.ts", "modified", 1, "context", "one"),
        ("src/a.ts", "modified", 2, "added", "TWO"),
        ("src/a.ts", "modified", 2, "removed", "two"),
        ("src/a.ts", "modified", 3, "added", "extra"),
        ("src/a.ts", "modified", 4, "context", "three"),
        ("src/a.ts", "modified", 10, "removed", "old"),
        ("src/a.ts", "modified", 11, "added", "new"),
    ]


def test_read_tree(spark, rows, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a b.ts").write_text("x\ny\n")
    (tmp_path / "readme.md").write_text("z")
    files = corpus.corpus_scan(corpus.read_tree(spark, str(tmp_path)))
    assert rows(files, "path", "language", "status") == [("src/a b.ts", "typescript", "added")]
    assert rows(corpus.line_explode(files), "line", "content") == [(1, "x"), (2, "y"), (3, "")]


def test_read_tree_strips_the_root_once(spark, rows, tmp_path):
    for folder in ("src/x", "src/lib/src/x"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "a.ts").write_text("x")
    for root in (f"{tmp_path}/src", f"file://{tmp_path}/src/", f"file:{tmp_path}/src"):
        assert rows(corpus.read_tree(spark, root), "path") == [("lib/src/x/a.ts",), ("x/a.ts",)]


def test_manifests(spark, rows):
    npm = '{"dependencies": {"@s/a": "^1.2.0", "b": ">=2"}, "devDependencies": {"c": "3.0.0"}}'
    go = "module m\nrequire (\n\texample.com/x v1.2.3\n)\n"
    cargo = '[dependencies]\nserde = "1.0"\nfancy = { version = "2" }\n'
    pom = "<groupId>g</groupId>\n<artifactId>a</artifactId> <version>4</version>"
    df = spark.createDataFrame(
        [("p/package.json", npm), ("go.mod", go), ("Cargo.toml", cargo), ("pom.xml", pom), ("q/package.json", "{oops")],
        "path string, content string",
    )
    assert rows(reports.manifest_deps(df), "name", "version", "ecosystem") == [
        ("@s/a", "1.2.0", "npm"), ("b", "=2", "npm"), ("c", "3.0.0", "npm"),
        ("example.com/x", "v1.2.3", "Go"), ("g:a", "4", "Maven"), ("serde", "1.0", "crates.io"),
    ]


def test_coverage_reports(spark, rows):
    lcov = spark.createDataFrame([(1, "TN:\nSF:a.ts\nDA:1,2\nDA:2,0\nend_of_record\nSF:b.ts\nend_of_record\n")], "report_id long, report string")
    assert rows(reports.lcov_records(lcov), "path", "line", "hits") == [("a.ts", 1, 2), ("a.ts", 2, 0), ("b.ts", None, None)]
    json = '{"a.ts": {"statementMap": {"0": {"start": {"line": 3}}, "1": {"start": {"line": 5}}}, "s": {"0": 7}}}'
    df = spark.createDataFrame([(1, json), (2, "no json")], "report_id long, report string")
    assert rows(reports.statement_coverage(df), "path", "line", "hits") == [("a.ts", 3, 7), ("a.ts", 5, 0)]


def test_run_store_round_trip(spark, rows, tmp_path):
    path = str(tmp_path / "runs")
    make = lambda run, n: spark.createDataFrame([(run, f"f{i}", i) for i in range(n)], "run_id string, file string, line long")
    stores.write_run_findings(make("r1", 3), path)
    stores.write_run_findings(make("r2", 2), path)
    stores.write_run_findings(make("r1", 1), path)
    assert stores.load_run_findings(spark, path, "r1").count() == 1
    assert stores.load_run_findings(spark, path, "r2").count() == 2
    assert stores.load_run_findings(spark, path, "none").count() == 0


def test_upsert_and_history_cap(spark, rows):
    schema = "rule_id string, pattern string, pattern_type string, count long, dismissed_at string"
    stored = spark.createDataFrame([("r", "p", "file", 2, "2024-01-01")], schema)
    new = spark.createDataFrame([("r", "p", "file", "2024-02-01"), ("s", "q", "message", "2024-02-02")], "rule_id string, pattern string, pattern_type string, dismissed_at string")
    assert rows(stores.dismissal_upsert(stored, new), "rule_id", "count", "dismissed_at") == [("r", 3, "2024-02-01"), ("s", 1, "2024-02-02")]
    runs = spark.createDataFrame([("x", f"{i:03}", f"{i:03}") for i in range(7)], "repo string, run_id string, run_at string")
    assert rows(stores.keep_newest_runs(runs, 2), "run_id") == [("005",), ("006",)]


def test_suppression(spark, rows):
    lines = spark.createDataFrame(
        [
            ("a.ts", "typescript", 1, "// scan-ignore rule/x"),
            ("a.ts", "typescript", 3, "code() // scan-ignore-line"),
            ("a.ts", "typescript", 5, "u = 'http://h' /* scan-ignore */"),
            ("b.py", "python", 1, "# scan-ignore"),
            ("b.py", "python", 4, "// scan-ignore"),
        ],
        "path string, language string, line long, content string",
    )
    directives = results.suppression_directives(lines)
    assert rows(directives) == [("a.ts", 2, "rule/x"), ("a.ts", 3, None), ("a.ts", 6, None), ("b.py", 2, None)]
    found = spark.createDataFrame(
        [("rule/x", "a.ts", 2), ("rule/y", "a.ts", 2), ("rule/y", "a.ts", 3), ("rule/y", "b.py", 2)], "rule_id string, file string, line long"
    )
    assert rows(results.suppress(found, directives)) == [("rule/y", "a.ts", 2)]


def test_baseline_ignores_lines_and_keeps_new(spark, rows):
    schema = "rule_id string, file string, message string, line long, code_snippet string"
    old = spark.createDataFrame([("r", "f", "m1", 1, "a  b"), ("r", "g", "m2", 2, None)], schema)
    new = spark.createDataFrame(
        [("r", "f", "other", 9, " a b "), ("r", "g", "m2", 8, "x"), ("r", "g", "m3", 2, None), ("s", "f", "m1", 1, "a b")], schema
    )
    kept = results.baseline_filter(new, stores.baseline_rows(old))
    assert rows(kept, "rule_id", "message") == [("r", "m3"), ("s", "m1")]
    assert results.baseline_filter(old, stores.baseline_rows(old)).count() == 0


def test_dismissals(spark, rows):
    """Against every pattern on every finding."""
    files = ["src/a.ts", "a.ts", "src/x/a.ts", ".hid/a.ts", "src/[b].ts", "lib/b.tsx", "lib/b.py", "README", "src/äö.ts", None]
    found = [(f"r{i % 4}" if i % 9 else None, f, f"Unused import: 'n{i}'" if i % 5 else None) for i, f in enumerate(files * 8)]
    found += [("r1", "src/a.ts", ""), ("r2", "src/a.ts", "x")]
    entries = [
        ("r0", "'n1", "message"), ("r1", "n2", "message"), ("r1", "", "message"), ("*", "n7'", "message"), ("*", "x", "message"), ("r2", "7", "message"),
        ("r0", "**/a.ts", "file"), ("*", "src/[äb]*.ts", "file"), ("r3", "lib/*.{py,tsx}", "file"), ("r2", "!src/**", "file"), ("r3", "src/\\[b\\].ts", "file"),
        ("r1", "#x", "file"), ("*", "READ??", "file"), (None, "n3", "message"), ("r0", None, "file"), ("r0", "n3", "other"), ("r0", "**/a.ts", "file"),
    ]

    def matches(rule, file, message, entry):
        wanted, pattern, kind = entry
        if wanted is None or pattern is None or wanted not in ("*", rule):
            return False
        if kind == "message":
            return message is not None and pattern in message
        if kind != "file" or file is None:
            return False
        hit = re.search(paths.glob_to_regex(pattern.lstrip("!")).replace("\\z", "\\Z"), file) is not None
        return hit != pattern.startswith("!")

    schema = "rule_id string, file string, message string"
    frame = spark.createDataFrame(found, schema).repartition(3)
    stored = spark.createDataFrame(entries, "rule_id string, pattern string, pattern_type string")
    want = [f for f in found if not any(matches(*f, e) for e in entries)]
    assert 0 < len(want) < len(found)
    assert rows(results.dismissal_filter(frame, stored), "rule_id", "file", "message") == sorted(want, key=repr)
    assert results.dismissal_filter(frame, stored.limit(0)).count() == len(found)
    assert results.dismissal_filter(frame, spark.createDataFrame([("*", "**/*", "file")], stored.schema)).filter("file NOT LIKE '.%'").count() == 0


def test_saved_again_reports_only_new_findings(spark, rows, tmp_path):
    key = lambda c: "const k = '" + "AKIA" + c * 16 + "';"
    out, state, folder = (str(tmp_path / name) for name in ("out", "state", "in"))

    def save(*files):
        spark.createDataFrame(files, "path string, content string").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("path string, content string").parquet(folder)
        incremental.incremental_check(stream, None, out, str(tmp_path / "progress"), state)
        return rows(spark.read.parquet(out), "batch", "file", "line")

    first = save(("a.ts", key("A") + "\n" + key("B")), ("b.ts", key("A")))
    assert first == [(0, "a.ts", 1), (0, "a.ts", 2), (0, "b.ts", 1)]
    # Equal files, and lines that moved: nothing new.
    assert save(("a.ts", key("A") + "\n" + key("B")), ("b.ts", "\n" + key("A"))) == first
    # One finding more, a second one of the same text, and a file that lost its own.
    third = save(("a.ts", key("A") + "\n" + key("C") + "\n" + key("A")), ("b.ts", ""))
    assert third == [*first, (2, "a.ts", 2), (2, "a.ts", 3)]
    # What was taken out and comes back is new.
    fourth = save(("b.ts", key("A")))
    assert fourth == sorted([*third, (3, "b.ts", 1)])
    # No content, no path.
    assert [r for r in save(("c.ts", None), (None, key("A"))) if r[0] < 4] == fourth
