"""Exact top-k search by inner product through a pivot-distance index.

Vectors of integers are lifted by one component so that all have the same length; the largest
inner product is then the smallest distance. Each vector is filed under its nearest pivot in
an annulus of distances to it. A query first visits the annuli with the best bounds until they
hold enough vectors, and then, with its k-th score known, every further annulus whose bound by
the triangle inequality still reaches that score; it stops at the others. Annuli are compared
in blocks of vectors and queries, as exact integer products.

Pivots and annuli have bounded numbers, so their table fits into every task; large annuli are
split into parts, and all parts are searched.

Defined results: vectors that are null or hold null or non-finite components take no part;
shorter vectors count as filled up with zeros; components are saturated to 40 bits and scores
to a long; a candidate is another row, so rows that repeat an id find each other; with null
ids a row can be found but asks nothing; an empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codeloom.llm.common import ship, written

K, EVERY, SCALE = 20, 20, 64
#: Most pivots and most annuli of one pivot; vectors per annulus aimed at.
PIVOTS, RINGS, RING_SIZE = 64, 64, 4_096
SAMPLE = 8_192
#: Vectors of a part and queries of a block that meet in one task.
PART, QUERIES = 8_192, 8_192
#: Vectors that the first visit covers, at least.
FIRST_VISIT = 2_048
#: Relative slack of floating-point bounds; scores themselves are exact.
SLACK = 1e-9
LARGEST = 1 << 40


def integers(column: str) -> Column:
    """floor(SCALE * x) per component, or null where the vector takes no part."""
    numbers = F.transform(F.col(column), lambda x: x.cast("double"))
    bad = F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = lambda x: F.greatest(F.least(F.floor(x * SCALE).cast("long"), F.lit(LARGEST)), F.lit(-LARGEST))
    return F.when(~bad, F.transform(numbers, scaled))


def _matrix(lists: list, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), dtype=np.float64)
    for i, row in enumerate(lists):
        out[i, : len(row)] = row
    return out


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer inner products as longs."""
    if len(left) == 0 or len(right) == 0:
        return np.zeros((len(left), len(right)), dtype=np.int64)
    if np.abs(left).max() * np.abs(right).max() * left.shape[1] < 2.0**53:
        return (left @ right.T).astype(np.int64)
    exact = left.astype(np.int64).astype(object) @ right.astype(np.int64).astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def distances(rows: np.ndarray, pivots: np.ndarray, length: float) -> np.ndarray:
    """Distances of lifted rows to lifted pivots."""
    lift = lambda m: np.sqrt(np.maximum(length**2 - (m**2).sum(axis=1), 0))
    square = 2 * length**2 - 2 * rows @ pivots.T - 2 * np.outer(lift(rows), lift(pivots))
    return np.sqrt(np.maximum(square, 0))


def query_distances(queries: np.ndarray, pivots: np.ndarray, length: float) -> np.ndarray:
    square = (queries**2).sum(axis=1)[:, None] + length**2 - 2 * queries @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def choose_pivots(sample: np.ndarray, number: int) -> np.ndarray:
    """Pivots far from each other, from the sample."""
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(axis=1)
    for _ in range(min(number, len(sample)) - 1):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def top_k(vectors: DataFrame, asks: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for every row where `asks`."""
    spark = vectors.sparkSession
    ship(spark)
    rows = written(
        vectors.select("vec_id", asks.alias("asks"), integers("embedding").alias("v"))
        .where(F.col("v").isNotNull())
        .withColumn("row", F.monotonically_increasing_id())
    )
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(square).alias("square")).first()
    n, width, length = size["n"], size["width"] or 1, math.sqrt(size["square"] or 0.0)
    cells = max(1, n / RING_SIZE)
    n_pivots = int(np.clip(round(math.sqrt(cells)), 1, PIVOTS))
    n_rings = int(np.clip(round(cells / n_pivots), 1, RINGS))
    share = min(1.0, SAMPLE / max(n, 1))
    place = F.pmod(F.xxhash64("v"), F.lit(1 << 20)) / float(1 << 20)
    sample = [r["v"] for r in rows.where(place < share).select("v").limit(2 * SAMPLE).collect()]
    matrix = _matrix(sample, width)
    pivots = choose_pivots(matrix, n_pivots) if len(matrix) else np.zeros((1, width))
    to_pivot = distances(matrix, pivots, length) if len(matrix) else np.zeros((0, 1))
    # Annuli of about equal numbers, from the sample; every vector is filed in one.
    cuts = [
        np.quantile(own, np.linspace(0, 1, n_rings + 1)[1:-1]) if len(own := to_pivot[to_pivot.argmin(axis=1) == p, p]) else []
        for p in range(len(pivots))
    ]

    def file(batches):
        for batch in batches:
            far = distances(_matrix(batch["v"].to_pylist(), width), pivots, length)
            near = far.argmin(axis=1)
            own = far[np.arange(len(far)), near]
            cell = [int(p) * RINGS + int(np.searchsorted(cuts[p], d)) for p, d in zip(near, own)]
            columns = [batch[c] for c in ("vec_id", "asks", "v", "row")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cell, pa.int32()), pa.array(own, pa.float64())], names=names)

    names = ["vec_id", "asks", "v", "row", "cell", "far"]
    filed = written(rows.mapInArrow(file, "vec_id long, asks boolean, v array<long>, row long, cell int, far double"))
    # At most PIVOTS * RINGS rows.
    table = filed.groupBy("cell").agg(F.min("far").alias("lo"), F.max("far").alias("hi"), F.count("*").alias("n")).orderBy("cell").collect()
    cell_ids = np.array([r["cell"] for r in table], dtype=np.int64)
    lo, hi, held = (np.array([r[c] for r in table], dtype=float) for c in ("lo", "hi", "n"))
    parts = dict(zip(cell_ids.tolist(), np.ceil(held / PART).astype(int).tolist()))

    def bounds(queries: np.ndarray) -> np.ndarray:
        """Highest score that each cell can hold for each query."""
        to = query_distances(queries, pivots, length)[:, cell_ids // RINGS]
        slack = SLACK * (1 + length + np.sqrt((queries**2).sum(axis=1)))[:, None]
        gap = np.maximum(np.maximum(to - hi - slack, lo - to - slack), 0)
        own = (queries**2).sum(axis=1)[:, None]
        return (own + length**2 - gap**2) / 2 + slack * (1 + length)

    def visit(first: bool):
        def run(batches):
            for batch in batches:
                queries = _matrix(batch["v"].to_pylist(), width)
                best = bounds(queries)
                order = np.argsort(-best, axis=1, kind="stable")
                rank = np.empty_like(order)
                np.put_along_axis(rank, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
                before = np.cumsum(held[order], axis=1) - held[order]
                early = np.take_along_axis(before, rank, axis=1) < max(FIRST_VISIT, k + 1)
                reach = batch["reach"].to_numpy(zero_copy_only=False)
                take = early if first else ~early & (best >= reach[:, None])
                q, c = np.nonzero(take)
                at = pa.array(q, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch["row"].take(at), batch["vec_id"].take(at), batch["v"].take(at), batch["reach"].take(at), pa.array(cell_ids[c], pa.int32())],
                    names=["row", "vec_id", "v", "reach", "cell"],
                )

        return run

    schema = "row long, vec_id long, v array<long>, reach double, cell int"
    split = F.create_map(*(F.lit(x) for c, p in parts.items() if p > 1 for x in (c, p))) if any(p > 1 for p in parts.values()) else None
    n_parts = F.lit(1) if split is None else F.coalesce(F.try_element_at(split, F.col("cell")), F.lit(1))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({c: pa.array([], pa.int64()) for c in ("query", "query_id", "vec_id", "row", "score")})
        if not len(left) or not len(right):
            return empty
        ids, own = left["vec_id"].to_numpy(zero_copy_only=False), left["row"].to_numpy()
        members = _matrix(left["v"].to_pylist(), width)
        null = np.asarray(left["vec_id"].is_null())
        sort_id = np.where(null, np.iinfo(np.int64).max, np.nan_to_num(ids, nan=0)).astype(np.int64) if null.any() else ids
        reach, out = right["reach"].to_numpy(), []
        q_rows, q_ids = right["row"].to_numpy(), right["vec_id"].to_numpy()
        queries = _matrix(right["v"].to_pylist(), width)
        for at in range(0, len(queries), 512):
            scores = products(queries[at : at + 512], members)
            for i, line in enumerate(scores):
                good = np.flatnonzero((line >= reach[at + i]) & (own != q_rows[at + i]))
                if len(good) > k:
                    least = np.partition(line[good], len(good) - k)[len(good) - k]
                    good = good[line[good] >= least]
                    good = good[np.lexsort((sort_id[good], -line[good]))[:k]]
                if len(good):
                    out.append((np.full(len(good), q_rows[at + i]), np.full(len(good), q_ids[at + i]), good, line[good]))
        if not out:
            return empty
        q, qi, g, s = (np.concatenate(x) for x in zip(*out))
        return pa.table(
            {"query": q, "query_id": qi.astype(np.int64), "vec_id": left["vec_id"].combine_chunks().take(pa.array(g)), "row": own[g], "score": s}
        )

    def found(queries: DataFrame, first: bool) -> DataFrame:
        asked = queries.select("row", "vec_id", "v", "reach").mapInArrow(visit(first), schema)
        asked = written(asked)
        blocks = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
        members = (
            filed.select("vec_id", "v", "row", "cell").join(F.broadcast(blocks), "cell")
            .withColumn("part", F.pmod(F.xxhash64("row"), n_parts).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        )
        asking = (
            asked.join(F.broadcast(blocks), "cell")
            .withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
            .withColumn("part", F.explode(F.sequence(F.lit(0), n_parts - 1)))
        )
        members = members.select(*(F.col(c).alias(c) for c in ("cell", "part", "block", "vec_id", "v", "row")))
        asking = asking.select(*(F.col(c).alias(c) for c in ("cell", "part", "block", "row", "vec_id", "v", "reach")))
        keys = ["cell", "part", "block"]
        return members.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(
            search, "query long, query_id long, vec_id long, row long, score long"
        )

    ranked = W.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    best = lambda df: df.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    queries = filed.where(F.col("asks")).withColumn("reach", F.lit(float("-inf")))
    early = written(best(found(queries, True)))
    reached = early.where(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").cast("double").alias("reach"))
    queries = queries.drop("reach").join(reached, "row", "left").withColumn("reach", F.coalesce("reach", F.lit(float("-inf"))))
    both = early.drop("rank").unionByName(found(queries, False))
    return best(both).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def topk_query(spark: SparkSession, folder: str) -> DataFrame:
    """All of `embeddings`; the queries are the rows whose id is divisible by EVERY."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return top_k(vectors, F.coalesce(F.col("vec_id") % EVERY == 0, F.lit(False)))
