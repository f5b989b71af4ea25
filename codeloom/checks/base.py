"""Registration of queries with their oracle SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from codeloom.checks.views import duck_views, spark_view
from codeloom.functions.kinds import Asked, Projected
from codeloom.functions.text import SPACES, regex
from codeloom.session import scratch_path, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FINDING = ["rule_id", "severity", "message", "file", "line"]


# Tables that stand for stored input are written once per session. Nodes are laid out by
# kind, so that a detector reads only the kinds it asks for; what they are made of is joined
# and numbered once, not again for each kind of row.
STORED = {
    "v_order_base": None, "v_item_base": None, "v_flow": None, "v_spoken": None,
    "v_nodes": "kind", "v_tree_nodes": "kind", "v_flow_nodes": "kind",
}
# A task writes rows of few kinds, so their files may be open at once and the rows need no sort.
_WRITERS = ("spark.sql.maxConcurrentOutputFileWriters", "64")
# Positions of nodes grow row by row, which this version of the format stores as differences.
_ENCODING = {"compression": "zstd", "parquet.writer.version": "v2"}
_WRITTEN: dict[tuple[str, str, str], tuple[str, StructType]] = {}


class Views:
    """The check views of one data folder, by name."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        if name not in STORED:
            return self._view(name)
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _WRITTEN:
            view, path = self._view(name), scratch_path(self.spark, name)
            self._write(view, path, STORED[name])
            _WRITTEN[key] = (path, view.schema)
        path, schema = _WRITTEN[key]
        return self.spark.read.schema(schema).parquet(path)

    def projected(self, name: str) -> Projected:
        """The view as one projection for each kind of row, not written out. A reading that asks
        for kinds or fields adds only the projections that can hold them to the plan."""
        return Projected(lambda asked: self._view(name, asked))

    def _write(self, view: DataFrame, path: str, by: str | None) -> None:
        if by is None:
            return view.write.options(**_ENCODING).parquet(path)
        before = self.spark.conf.get(_WRITERS[0])
        self.spark.conf.set(*_WRITERS)
        try:
            view.write.options(**_ENCODING).partitionBy(by).parquet(path)
        finally:
            self.spark.conf.set(_WRITERS[0], before)

    def _view(self, name: str, asked: Asked = ()) -> DataFrame:
        return spark_view(self.spark, self.folder, name, self._named, STORED, asked)

    def _named(self, name: str) -> str:
        """A temporary view of the stored table."""
        label = f"stored_{name}_{hashlib.md5(self.folder.encode()).hexdigest()}"
        self(name).createOrReplaceTempView(label)
        return label

    def table(self, name: str) -> DataFrame:
        return spread(self.spark.read.parquet(f"{self.folder}/{name}.parquet"))

    def stream(self, name: str) -> DataFrame:
        """The table as a stream of its files: a folder of them, or one file beside other tables."""
        file = f"{self.folder}/{name}.parquet"
        table = self.spark.read.parquet(file)
        files = self.spark.readStream.schema(table.schema)
        if all(path.endswith(f"/{name}.parquet") for path in table.inputFiles()):
            return files.option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)
        return files.parquet(file)


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Views(spark, folder))
        if sql is not None:
            ORACLES[name] = duck_views(sql)
        return build

    return register


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: str, ignore_case: bool = False) -> str:
    """The pattern as a DuckDB literal."""
    return lit(regex(pattern, ignore_case, java=False))


def hit(column: str, pattern: str, ignore_case: bool = False) -> str:
    return f"regexp_matches({column}, {rx(pattern, ignore_case)})"


def trim(column: str) -> str:
    return f"trim({column}, {lit(SPACES)})"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def fixed(n: str, d: str, digits: int) -> str:
    """Half-up decimal text of n / d in integer arithmetic."""
    scale = 10**digits
    scaled = f"CAST(floor((({n}) * {2 * scale} + ({d})) / (({d}) * 2)) AS BIGINT)"
    if digits == 0:
        return f"CASE WHEN ({d}) = 0 THEN 'Infinity' ELSE CAST({scaled} AS VARCHAR) END"
    return (
        f"CASE WHEN ({d}) = 0 THEN 'Infinity' ELSE CAST({scaled} // {scale} AS VARCHAR) || '.' || "
        f"lpad(CAST({scaled} % {scale} AS VARCHAR), {digits}, '0') END"
    )
