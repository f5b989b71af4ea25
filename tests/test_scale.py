"""Work that must not grow faster than its tables: what is searched, joined or hashed once."""

import pytest
from pyspark.sql import functions as F

from codeloom.checks import QUERIES
from codeloom.checks.base import Views
from codeloom.functions import names, ordered
from codeloom.functions.kinds import only
from codeloom.operators import derive
from codeloom.operators import nodes as node_rules


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def folder(spark, tmp_path):
    """Tables that are folders of files, as large ones are."""
    key = "const k = '" + "AKIA" + "A" * 16 + "';"
    docs = [(i, f"one two\n{key}", "en", "web", 10) for i in range(4)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    events = spark.range(20).selectExpr(
        "id AS event_id", "id % 3 AS user_id", "'error' AS event_type", "'p' AS props", "1.5D AS value", "timestamp'2024-01-01' AS ts"
    )
    events.repartition(2).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_streams_read_tables_that_are_folders(spark, folder):
    assert QUERIES["incremental_check"](spark, folder).count() == 4
    assert QUERIES["incremental_runs"](spark, folder).collect()[0]["total_findings"] == 20


def test_a_message_is_searched_once(spark):
    messages = spark.createDataFrame([("Function 'a_b' should use camelCase naming",), ("'a' should use x naming",), (None,)], "m string")
    found = messages.select(names.message_name(F.col("m")).alias("found"))
    assert plan(found).count("regexp_extract") == 1
    assert [r[0] and tuple(r[0]) for r in found.collect()] == [("a_b", "camelCase"), None, None]


def test_views_join_and_copy_once(spark, folder):
    views = Views(spark, folder)
    assert "Join" not in plan(views._view("v_flow_nodes"))
    assert "Window" not in plan(views._view("v_names")) and "try_element_at" not in plan(views._view("v_names"))


def test_shapes_do_not_depend_on_buckets(spark, rows, monkeypatch):
    # Two equal functions of six lines around other words; every row is a bucket of its own or not.
    nodes = []
    for file, start in (("a.ts", 0), ("b.ts", 7)):
        nodes += [(file, "typescript", 900 + i, None, None, "word", f"w{i}", i, i, True, 1, 1) for i in range(start)]
        nodes.append((file, "typescript", 1, None, None, "function_declaration", "f", start, start + 6, True, 2, 7))
        nodes += [(file, "typescript", 2 + i, 1, None, "word", f"x{i}", start + 1 + i, start + 1 + i, True, 2 + i, 2 + i) for i in range(6)]
    frame = spark.createDataFrame(
        nodes, "path string, language string, node_id long, parent_id long, field string, kind string, text string, pre long, post long, named boolean, start_line long, end_line long"
    )
    whole = rows(derive.blocks_of_nodes(frame), "path", "shape")
    monkeypatch.setattr(ordered, "WIDTH", 2)
    assert rows(derive.blocks_of_nodes(frame), "path", "shape") == whole
    assert len(whole) == 2 and whole[0][1] == whole[1][1]


def test_detectors_of_few_kinds_write_no_nodes(spark, tmp_path, monkeypatch):
    # The node table is several times what it is made of; a detector computes the kinds it asks for.
    spark.range(40).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(90).selectExpr(
        "id % 40 AS l_orderkey", "id % 5 AS l_linenumber", "id % 24 AS l_partkey", "id % 6 AS l_suppkey", "id * 1.5D AS l_extendedprice"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    written = []
    monkeypatch.setattr(Views, "_write", lambda views, view, path, by, write=Views._write: (written.append(by), write(views, view, path, by)))
    found = QUERIES["class_naming"](spark, str(tmp_path))
    assert found.count() > 0
    assert written and "kind" not in written
    assert plan(found).count("Relation") < plan(Views(spark, str(tmp_path)).projected("v_nodes")).count("Relation")


def test_readers_of_many_kinds_write_no_nodes(spark, tmp_path, monkeypatch):
    # Each reading plans the projections that can hold the kinds or fields it asks for, no others.
    spark.range(40).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(90).selectExpr(
        "id % 40 AS l_orderkey", "id % 5 AS l_linenumber", "id % 24 AS l_partkey", "id % 6 AS l_suppkey", "id * 1.5D AS l_extendedprice"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    written = []
    monkeypatch.setattr(Views, "_write", lambda views, view, path, by, write=Views._write: (written.append(by), write(views, view, path, by)))
    for name in ("cyclomatic_complexity", "sql_injection"):
        QUERIES[name](spark, str(tmp_path))
    assert written and "kind" not in written
    table = Views(spark, str(tmp_path)).projected("v_nodes")
    nodes = lambda rows: plan(rows).count("Relation")
    size = lambda rows: len(rows._jdf.queryExecution().analyzed().toString().splitlines())
    for column, value in (("kind", "if_statement"), ("field", "operator")):
        found, filtered = only(table, column, value), table.frame.filter(F.col(column) == value)
        assert size(found) < size(filtered) / 2 and nodes(found) == nodes(filtered)
        assert found.count() > 0 and sorted(map(repr, found.collect())) == sorted(map(repr, filtered.collect()))


def test_samples_sort_only_the_first_places(spark):
    # Seven documents of two names each, one without a number: samples are the first five names.
    named = [("en", f"aB{i}{j}", i or None, j) for i in range(7) for j in range(2)] + [("en", "a_b", 0, 0), (None, "aB", 1, 1)]
    found = node_rules.convention_inference(spark.createDataFrame(named, "category string, name string, doc_id long, line long"), ["doc_id", "line"])
    assert "until" in plan(found)
    assert [tuple(r) for r in found.collect()] == [("en", "camelCase", 14 / 15 * 100, 15, "aB00,aB01,aB10,aB11,aB20")]
