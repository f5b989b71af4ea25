"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

import shutil
import tempfile
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import cut_lineage

#: White space as the contracts count it.
WS = r"\x20\x09-\x0D"

#: Running sums go through blocks of this many elements, so that a text with very many
#: matches costs time in proportion.
BLOCK = 512


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder: computed once, safe against lost executors."""
    return cut_lineage(df)


#: Bits of a filter for each of its keys, about; bits of one row of it; its most rows. They
#: change how many rows pass without need, but no result.
FILTER_BITS, FILTER_ROW, FILTER_ROWS = 16, 1 << 15, 1 << 14


def passing(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows of `df` whose long `key`, never null, may be among `keys` (one long column),
    and `passes`: false for the other rows. A bit map of the keys is broadcast; rows of other keys
    may pass, those of `keys` always do."""
    (name,) = keys.columns
    rows = min(-(-keys.count() * FILTER_BITS // FILTER_ROW), FILTER_ROWS)
    row = lambda k: F.pmod(F.shiftrightunsigned(k, 15), F.lit(max(rows, 1)))
    bit = lambda k: k.bitwiseAND(F.lit(FILTER_ROW - 1))
    bits = keys.groupBy(row(F.col(name)).alias("_row")).agg(F.bitmap_construct_agg(bit(F.col(name))).alias("_bits"))
    at = bit(F.col("_key"))
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    passes = F.coalesce(F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1, F.lit(False))
    joined = df.withColumn("_key", key).withColumn("_row", row(F.col("_key"))).join(F.broadcast(bits), "_row", "left")
    return joined.withColumn("passes", passes).drop("_row", "_bits", "_key")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the Python workers, which may run without its folder."""
    package = Path(__file__).resolve().parents[1]
    context = spark.sparkContext
    if context.applicationId in _SHIPPED or not package.is_dir():
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def document_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What tells documents apart: id and text. Rows equal in both are one document."""
    return F.struct(
        F.col(doc_id).isNull().alias("no_id"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"),
    )


def _running(values: Column, start: Column) -> Column:
    zero = F.struct(start.cast("long").alias("at"), F.array().cast("array<bigint>").alias("ends"))
    step = lambda acc, x: F.struct(
        (acc["at"] + x).alias("at"), F.concat(acc["ends"], F.array(acc["at"] + x)).alias("ends")
    )
    return F.aggregate(values, zero, step, lambda acc: acc["ends"])


def running_sums(values: Column) -> Column:
    """Inclusive running sums of an array column of longs."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))
    block = lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK))
    totals = F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0).cast("long"), lambda a, x: a + x))
    before = F.concat(F.array(F.lit(0).cast("long")), _running(totals, F.lit(0)))
    pieces = F.zip_with(blocks, before, lambda b, at: F.when(b.isNotNull(), _running(block(b), at)))
    return F.when(F.size(values) <= BLOCK, _running(values, F.lit(0))).otherwise(
        F.flatten(F.filter(pieces, lambda p: p.isNotNull()))
    )


def with_matches(
    df: DataFrame, text: str, patterns: dict[str, str], needles: dict[str, tuple[str, ...]] | None = None
) -> DataFrame:
    """`df` and for each name its pattern's leftmost non-overlapping matches: an array of
    structs of start, end (code points, exclusive), value and the text since the match
    before. Each step is a projection of its own, so that nothing is evaluated twice. A text
    with none of a pattern's needles, if it has any, holds no match and is not searched."""
    none = F.array().cast("array<string>")
    kept = df.columns
    names = list(patterns)

    def found(name: str) -> Column:
        holds = F.col(text).rlike(patterns[name])
        if needle := (needles or {}).get(name):
            holds = reduce(or_, (F.col(text).contains(x) for x in needle)) & holds
        return F.when(holds, F.regexp_extract_all(text, F.lit(patterns[name]), F.lit(0))).otherwise(none)

    hit = [found(n) for n in names]
    df = df.select(*kept, *(h.alias(f"found_{n}") for h, n in zip(hit, names)))
    df = df.select(
        *df.columns,
        *(
            F.when(F.size(f"found_{n}") > 0, F.slice(F.split(text, patterns[n], -1), F.lit(1), F.size(f"found_{n}")))
            .otherwise(none).alias(f"gap_{n}")
            for n in names
        ),
    )
    df = df.select(
        *df.columns,
        *(
            F.zip_with(f"gap_{n}", f"found_{n}", lambda g, v: (F.length(g) + F.length(v)).cast("long")).alias(f"step_{n}")
            for n in names
        ),
    )
    df = df.select(*df.columns, *(running_sums(F.col(f"step_{n}")).alias(f"end_{n}") for n in names))
    rows = lambda n: F.transform(
        F.arrays_zip(f"end_{n}", f"found_{n}", f"gap_{n}"),
        lambda m: F.struct(
            (m[f"end_{n}"] - F.length(m[f"found_{n}"])).alias("start"),
            m[f"end_{n}"].alias("end"),
            m[f"found_{n}"].alias("value"),
            m[f"gap_{n}"].alias("gap"),
        ),
    )
    return df.select(*kept, *(rows(n).alias(n) for n in names))


SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint>"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def spans(found: Column, kind: str, rank: int) -> Column:
    """Matches as spans, which sort by start and then by the rank of their kind."""
    return F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end")
        ),
    )


def span_text(all_spans: Column) -> Column:
    """`kind:start:end` of spans by start and kind, comma-joined."""
    ordered = F.array_sort(all_spans)
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def overlaps_any(start: Column, end: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < end) & (start < o["end"]))
