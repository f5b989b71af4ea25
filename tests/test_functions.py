import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.functions import identity, names, ordered, paths, text


def values(spark, texts, build):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    return [r[0] for r in df.orderBy("i").select(build(F.col("t"))).collect()]


@pytest.mark.parametrize(
    "glob,path,expected",
    [
        ("**/*.ts", "a.ts", True),
        ("**/*.ts", "x/y/a.ts", True),
        ("**/*.ts", "x/.y/a.ts", False),
        ("**/*.ts", ".a.ts", False),
        ("*.ts", "x/a.ts", False),
        ("src/**", "src/a/b.c", True),
        ("src/**", "src", False),
        ("src/**/index.ts", "src/index.ts", True),
        ("src/**/index.ts", "src/a/b/index.ts", True),
        ("{a,b}/*.{js,ts}", "b/x.ts", True),
        ("{a,b}/*.{js,ts}", "c/x.ts", False),
        ("f{1..3}.c", "f2.c", True),
        ("a?c", "abc", True),
        ("a?c", "a/c", False),
        ("[ab]*", "bx", True),
        ("[!ab]*", "bx", False),
        ("*", ".hidden", False),
        (".github/workflows/*.yml", ".github/workflows/ci.yml", True),
        ("**/Dockerfile.*", "d/Dockerfile.dev", True),
        ("#x", "#x", False),
        ("*a.ts", "a.ts", True),
        ("GPL-*", "GPL-3.0", True),
    ],
)
def test_globs(glob, path, expected):
    assert bool(re.search(paths.glob_to_regex(glob).replace(r"\z", r"\Z"), path)) is expected


def test_negated_glob(spark):
    assert values(spark, ["a.ts", "a.js"], lambda c: paths.glob_match(c, "!*.ts")) == [False, True]


def test_language_of_extension(spark):
    got = values(spark, ["a.ts", "b/c.py", "x.md", "noext", "d.e/f", "a.test.tsx"], paths.detect_language)
    assert got == ["typescript", "python", None, None, None, "tsx"]


def test_stems(spark):
    files = ["a/foo.test.ts", "index.ts", ".env", "a/b"]
    assert values(spark, files, paths.stem_first_dot) == ["foo", "index", ".env", "b"]
    assert values(spark, files, paths.stem_last_dot) == ["foo.test", "index", "", "b"]


def test_posix_join(spark):
    df = spark.createDataFrame([("src/a", "../b/./c"), ("src", "../../x"), (".", "./y"), ("a\\b", "..\\c")], "d string, r string")
    assert [r[0] for r in df.select(paths.posix_join(F.col("d"), F.col("r"))).collect()] == ["src/b/c", "x", "y", "a/c"]


def test_convert_names(spark):
    given_names = ["getHTTPResponse", "max_size", "MAX_SIZE", "kebab-case-name", "Already", "_x", "--"]
    to = lambda shape: values(spark, given_names, lambda c: names.convert_name(c, shape))
    assert to("camelCase") == ["getHttpResponse", "maxSize", "maxSize", "kebabCaseName", "already", "x", "--"]
    assert to("PascalCase") == ["GetHttpResponse", "MaxSize", "MaxSize", "KebabCaseName", "Already", "X", "--"]
    assert to("snake_case")[0] == "get_http_response"
    assert to("UPPER_SNAKE")[3] == "KEBAB_CASE_NAME"
    assert to("kebab-case")[1] == "max-size"


def test_classify_first_shape(spark):
    got = values(spark, ["foo", "Foo", "foo_bar", "FOO", "FOO_BAR", "foo-bar", "9x"], names.classify_name)
    assert got == ["camelCase", "PascalCase", "snake_case", "PascalCase", "UPPER_SNAKE", "kebab-case", None]


def test_unsafe_regex(spark):
    texts = ["/(a+)+$/", "/(_[a-z]+)*/", "/([a-z]+)*/", "/(abc)+/", "/(\\d+){2,}/", "/(x+y)*/"]
    assert values(spark, texts, text.unsafe_regex) == [True, False, True, False, True, False]


def test_sql_text(spark):
    texts = ["SELECT a FROM t", "please update this", "insert into t", "UPDATE x SET y", "éSELECT a FROM b"]
    assert values(spark, texts, text.looks_like_sql) == [True, False, True, True, True]


def test_trim_knows_wide_spaces(spark):
    wide = chr(0xA0) + " x " + chr(0x3000)
    assert values(spark, [wide], text.trim) == ["x"]


def test_fixed_point(spark):
    df = spark.createDataFrame([(50, 16), (1, 3), (5, 0), (20, 20)], "n long, d long")
    got = [r[0] for r in df.select(text.fixed_point(F.col("n"), F.col("d"), 1)).collect()]
    assert got == ["3.1", "0.3", "Infinity", "1.0"]


def test_package_url(spark):
    df = spark.createDataFrame(
        [("@a/b", "1", "npm"), ("x/y", "v2", "Go"), ("c", "3", "crates.io"), ("g:a", "4", "Maven"), ("z", "5", "?")],
        "n string, v string, e string",
    )
    got = [r[0] for r in df.select(identity.package_url(F.col("n"), F.col("v"), F.col("e"))).collect()]
    assert got == ["pkg:npm/%40a/b@1", "pkg:golang/x/y@v2", "pkg:cargo/c@3", "pkg:maven/g/a@4", "pkg:generic/z@5"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.none(), st.integers(0, 9))), min_size=1, max_size=40))
def test_bucketed_windows_equal_plain_ones(spark, data):
    df = spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(data)], "k string, at long, v long")
    summed = ordered.running_sum(df, ["k"], ["at"], F.coalesce("v", F.lit(0)), "s", width=3)
    last = ordered.last_known(summed, ["k"], "at", F.col("v"), "l", width=3)
    got = ordered.next_row(last, ["k"], "at", F.col("at"), "n", width=3).orderBy("at").collect()
    total, known = {}, {}
    for i, (k, v) in enumerate(data):
        total[k] = total.get(k, 0) + (v or 0)
        known[k] = v if v is not None else known.get(k)
        following = [j for j, (other, _) in enumerate(data) if other == k and j > i]
        assert (got[i].s, got[i].l, got[i].n) == (total[k], known[k], following[0] if following else None)
