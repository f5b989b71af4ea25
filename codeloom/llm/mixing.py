"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens (words) to the power of an exponent. The
exponent is bisected until the mixture has a target entropy, or until no source is repeated
more often than a limit. Weights become token budgets, and a budget becomes blocks: whole
passes over the source, each in a permutation of its own, and a last pass cut where the
budget ends.

Defined results: a null source is a source of its own; documents without words weigh
nothing and go with each pass of their source (once, where the whole source has no words);
rows equal in id and text are taken or left together; an empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codeloom.llm.common import WS, text_of, written

#: Points tried at once in one round of the search for the exponent, and rounds: each round
#: narrows the interval by POINTS - 1.
POINTS, ROUNDS = 33, 6
#: Rows of a source in one bucket of its order, about.
BUCKET = 4096
#: How often the most repeated source may be passed where the least repeated is passed once.
MAX_REPETITION = 2.0


def n_tokens(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(f"[^{WS}]+")).cast("long")


def order(seed: int, block: Column, doc_id: str = "doc_id", text: str = "text") -> Column:
    """A document's place in the permutation of a block."""
    return F.xxhash64(F.col(doc_id), F.col(text), F.lit(seed), block.cast("long"))


def exponent(shares: DataFrame, entropy: float | None, repetition: float | None) -> float:
    """The largest exponent in 0..1 at which the entropy (nats) is still reached, or the
    smallest at which no source is repeated beyond the limit. Only sums over the sources
    come to the driver, one row per point tried."""
    share, a = F.col("share"), F.col("a")
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / (POINTS - 1) for i in range(POINTS)]
        rows = (
            shares.select("share", F.explode(F.array(*map(F.lit, points))).alias("a"))
            .groupBy("a")
            .agg(
                F.sum(F.pow(share, a)).alias("z"), F.sum(F.pow(share, a) * F.log(share)).alias("s"),
                F.max(F.pow(share, a - 1)).alias("most"), F.min(F.pow(share, a - 1)).alias("least"),
            )
            .collect()
        )
        if not rows:
            return 1.0
        if entropy is not None:
            good = [r.a for r in rows if math.log(r.z) - r.a * r.s / r.z >= entropy]
            low = max(good, default=low)
            high = min([p for p in points if p > low], default=low)
            found = low
        else:
            good = [r.a for r in rows if r.most / r.least <= repetition]
            high = min(good, default=high)
            low = max([p for p in points if p < high], default=high)
            found = high
        if high <= low:
            break
    return found


def weights(tokens: DataFrame, entropy: float | None = None, repetition: float | None = MAX_REPETITION) -> DataFrame:
    """Per source, of rows (source, tokens): share, weight, passes (at least 1) and budget in
    tokens. The least repeated source is passed once, so no document is lost."""
    total = tokens.agg(F.sum("tokens").alias("all")).first()["all"] or 0
    filled = tokens.where(F.col("tokens") > 0)
    shares = filled.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    # Rounded, so that sums added up in another order give the same mixture.
    a = round(exponent(shares, entropy, repetition), 6)
    powers = shares.agg(F.sum(F.pow("share", F.lit(a))).alias("z"), F.min(F.pow("share", F.lit(a - 1))).alias("least")).first()
    z, least = powers["z"] or 1.0, powers["least"] or 1.0
    passes = F.when(F.col("tokens") > 0, F.round(F.pow("share", F.lit(a - 1)) / F.lit(least), 6)).otherwise(1.0)
    return tokens.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1)))).select(
        "source", "tokens", "share",
        F.when(F.col("tokens") > 0, F.pow("share", F.lit(a)) / F.lit(z)).otherwise(0.0).alias("weight"),
        passes.alias("passes"), F.round(passes * F.col("tokens")).cast("long").alias("budget"),
    )


def plan(documents: DataFrame, entropy: float | None, repetition: float | None, seed: int) -> DataFrame:
    """Per source: whole passes and the place in the last pass's permutation at which the
    budget ends (null: no last pass)."""
    rows = written(documents.select(
        F.col("source").cast("string").alias("source"), n_tokens().alias("tokens"), order(seed, F.lit(0)).alias("at")
    ))
    counted = written(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")))
    budget = weights(counted.select("source", "tokens"), entropy, repetition).withColumn(
        "whole", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1)
    ).withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("whole") * F.col("tokens")).otherwise(0))
    budget = written(budget)
    # The order is a hash, so its upper bits make even buckets, whatever a source's size.
    largest = counted.agg(F.max("rows")).first()[0] or 1
    bits = max(0, math.ceil(math.log2(max(largest / BUCKET, 1))))
    bucket = F.shiftrightunsigned(F.col("at"), 63 - bits).cast("long") if bits else F.lit(0).cast("long")
    # Unsigned order of the hash: the sign bit goes first.
    rows = rows.withColumn("at", F.shiftrightunsigned(F.col("at"), 1)).withColumn("bucket", bucket)
    sums = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    cut = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))
    cut = cut.join(budget.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s"))).where(
        (F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("in_bucket"))
    ).select("s", F.col("bucket").alias("b"), (F.col("rest") - F.col("before")).alias("left"))
    # Only the bucket in which the budget ends is summed document by document.
    inside = rows.join(cut, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    earlier = W.partitionBy("s").orderBy("at").rangeBetween(W.unboundedPreceding, -1)
    end = (
        inside.withColumn("before", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))
        .where(F.col("before") < F.col("left"))
        .groupBy("s")
        .agg(F.max("at").alias("end"))
    )
    return written(
        budget.join(end, F.col("source").eqNullSafe(F.col("s")), "left")
        .select("source", "tokens", "share", "weight", "passes", "budget", F.col("whole").cast("int").alias("whole"), "end")
    )


def mix(
    documents: DataFrame, entropy: float | None = None, repetition: float | None = MAX_REPETITION, seed: int = 0
) -> DataFrame:
    """`documents` (doc_id, text, source and any other columns, kept as struct `row`), each as
    often as its source's passes say: block (from 1), place (order inside the block), weight."""
    budgets = plan(documents, entropy, repetition, seed).select(F.col("source").alias("_s"), "weight", "whole", "end")
    rows = documents.select(
        F.struct("*").alias("row"), F.col("source").cast("string").alias("_source"),
        F.shiftrightunsigned(order(seed, F.lit(0)), 1).alias("_at"),
    )
    # Spark broadcasts the budgets where their written size allows it, else splits hot sources.
    joined = rows.join(budgets, F.col("_source").eqNullSafe(F.col("_s")))
    last = F.coalesce((F.col("_at") <= F.col("end")).cast("int"), F.lit(0))
    blocks = F.sequence(F.lit(1), F.col("whole") + last)
    return joined.select("row", "weight", F.explode(F.when(F.col("whole") + last > 0, blocks)).alias("block")).select(
        "row", "weight", "block",
        F.xxhash64(F.col("row.doc_id"), F.col("row.text"), F.lit(seed), F.col("block").cast("long")).alias("place"),
    )


def mixing_query(spark: SparkSession, folder: str) -> DataFrame:
    """All of `documents`: the least repeated source once, the most repeated twice at most."""
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source")
    return mix(documents).select(
        F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "weight", "block", "place"
    )
