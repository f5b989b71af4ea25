"""Centroid clustering with PCA-rotated filtering.

Vectors become integers. A rotation by principal components (from sums over all vectors) gives
each vector its `LEAD` leading coordinates and the norm of the rest, which are stored beside
it. For a vector and a centroid the squared distance of the leading coordinates plus the
squared difference of the norms is a lower bound of their squared distance, so only centroids
whose bound is not above the best distance found are compared in full, in integers.

Each round is one pass: tasks assign their vectors and emit exact sums of each cluster and
component, which Spark adds up; only `k` centroids come to the driver.

Defined results: vectors that are null, of another width, or with a component that is null, not
finite, or not finite times `SCALE` are left out; every row is a vector, so repeated rows and
equal or null ids count each (a null id has no digits); ties of the first centroids go by the
components, ties of distances to the smaller number; fewer vectors than `k` give fewer
centroids; a distance or sum beyond a long is null, the assignment still exact; other columns,
whatever their names, are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import ship, written

WIDTH, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Leading coordinates kept.
LEAD = 16
#: Squared distances of components up to this fit a long; wider rows are computed in Python's integers.
NARROW = 1 << 27
#: Integers are added up in limbs of so many bits, which stay exact in Spark's sums.
LIMB = 40
#: What rounding may do to a bound, in parts of the squared norms.
SLACK = 1e-9
#: Vectors that are compared at once.
ROWS = 1 << 14
LONGEST = 2**63 - 1


def limbs(value: int) -> Iterator[int]:
    """Signed digits of base 2^LIMB, the lowest first."""
    sign, value = (1, value) if value >= 0 else (-1, -value)
    while value:
        yield sign * (value & ((1 << LIMB) - 1))
        value >>= LIMB


def distance(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b))


class Filter:
    """Centroids with their bounds."""

    def __init__(self, centroids: list[list[int]], mean: np.ndarray, turn: np.ndarray) -> None:
        self.whole = centroids
        self.narrow = [max(map(abs, c), default=0) <= NARROW for c in centroids]
        self.exact = np.array([c if ok else [0] * len(c) for c, ok in zip(centroids, self.narrow)], dtype=np.int64)
        self.lead, self.rest, self.square = rotated(np.array([[float(x) for x in c] for c in centroids]), mean, turn)

    def bounds(self, lead: np.ndarray, rest: np.ndarray, square: np.ndarray) -> np.ndarray:
        """Lower bounds of squared distances, less what rounding may add."""
        with np.errstate(over="ignore", invalid="ignore"):
            cross = lead @ self.lead.T
            norms = (lead**2).sum(axis=1)[:, None] + (self.lead**2).sum(axis=1)[None, :]
            low = norms - 2 * cross + (rest[:, None] - self.rest[None, :]) ** 2
            low -= SLACK * (square[:, None] + self.square[None, :]) + 1
        return np.where(np.isfinite(low), low, -np.inf)

    def nearest(self, vectors: np.ndarray, lead: np.ndarray, rest: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid, for narrow vectors."""
        if not all(self.narrow):
            pairs = [min((distance(v, c), i) for i, c in enumerate(self.whole)) for v in vectors.tolist()]
            return np.array([i for _, i in pairs], dtype=np.int64), np.array([d for d, _ in pairs], dtype=object)
        low = self.bounds(lead, rest, square)
        number = low.argmin(axis=1)
        best = ((vectors - self.exact[number]) ** 2).sum(axis=1)
        # Centroids that the bound leaves, column by column: the smaller number wins a tie.
        for other in range(len(self.whole)):
            rows = np.flatnonzero((low[:, other] <= best) & (number != other))
            if len(rows):
                found = ((vectors[rows] - self.exact[other]) ** 2).sum(axis=1)
                won = (found < best[rows]) | ((found == best[rows]) & (other < number[rows]))
                best[rows[won]], number[rows[won]] = found[won], other
        return number, best


def rotated(vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading coordinates, norm of the rest, and the squared norm that rounding grows with."""
    with np.errstate(over="ignore", invalid="ignore"):
        whole = (vectors - mean) @ turn
        lead = whole[:, :LEAD]
        return lead, np.sqrt((whole[:, LEAD:] ** 2).sum(axis=1)), (vectors**2).sum(axis=1) + (mean**2).sum()


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy().astype(kind, copy=False).reshape(len(column), width)


def kept_vectors(embeddings: DataFrame, width: int, scale: int) -> DataFrame:
    """vec_id, whole (integers as text where they are wide) and narrow (integers)."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore"):
                scaled = np.floor(scale * _matrix(batch["vector"], width, np.float64))
            rows = np.flatnonzero(np.isfinite(scaled).all(axis=1))
            scaled = scaled[rows]
            fits = (np.abs(scaled) <= NARROW).all(axis=1)
            offsets = np.concatenate([[0], np.cumsum(np.where(fits, width, 0))]).astype(np.int32)
            narrow = pa.ListArray.from_arrays(pa.array(offsets), pa.array(scaled[fits].astype(np.int32).ravel()), mask=pa.array(~fits))
            wide = [None if ok else [str(int(x)) for x in v] for ok, v in zip(fits, scaled)]
            columns = [batch["vec_id"].take(pa.array(rows)), narrow, pa.array(wide, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "narrow", "wide"])

    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.where((F.size("embedding") == width) & finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).mapInArrow(
        whole, "vec_id long, narrow array<int>, wide array<string>"
    )


def rotation(vectors: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal axes of all narrow vectors, the widest spread first."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            if len(batch):
                data = np.hstack([_matrix(batch["narrow"], width, np.float64), np.ones((len(batch), 1))])
                total += data.T @ data
        cells = pa.array(range(total.size), pa.int32())
        yield pa.RecordBatch.from_arrays([cells, pa.array(total.ravel())], names=["cell", "value"])

    added = vectors.where("narrow IS NOT NULL").select("narrow").mapInArrow(sums, "cell int, value double")
    total = np.zeros((width + 1) ** 2)
    for cell, value in added.groupBy("cell").agg(F.sum("value")).collect():
        total[cell] = value
    total = total.reshape(width + 1, width + 1)
    count = max(total[-1, -1], 1.0)
    mean = total[-1, :-1] / count
    spread, axes = np.linalg.eigh(total[:-1, :-1] / count - np.outer(mean, mean))
    return mean, axes[:, np.argsort(-spread, kind="stable")]


def stored(vectors: DataFrame, mean: np.ndarray, turn: np.ndarray, width: int) -> DataFrame:
    """Adds the leading coordinates, the norm of the rest and the squared norm."""

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = batch["narrow"].is_valid()
            data = np.zeros((len(batch), width))
            data[fits.to_numpy(zero_copy_only=False)] = _matrix(batch["narrow"].filter(fits), width, np.float64)
            lead, rest, square = rotated(data, mean, turn)
            size = lead.shape[1]
            offsets = pa.array(np.arange(len(batch) + 1) * size, pa.int32())
            columns = [pa.ListArray.from_arrays(offsets, pa.array(lead.ravel())), pa.array(rest), pa.array(square)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "lead", "rest", "square"])

    return vectors.mapInArrow(turned, "vec_id long, narrow array<int>, wide array<string>, lead array<double>, rest double, square double")


def _assigned(batch: pa.RecordBatch, bounds: Filter, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, list, np.ndarray]]:
    """Rows, numbers, vectors (integers) and distances, the narrow rows together."""
    fits = batch["narrow"].is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(fits)
    for at in range(0, len(rows), ROWS):
        part = rows[at : at + ROWS]
        own = batch.take(pa.array(part))
        data = _matrix(own["narrow"], width, np.int64)
        number, best = bounds.nearest(data, _matrix(own["lead"], min(LEAD, width), np.float64), own["rest"].to_numpy(), own["square"].to_numpy())
        yield part, number, data, best
    for i in np.flatnonzero(~fits):
        vector = [int(x) for x in batch["wide"][int(i)].as_py()]
        best, number = min((distance(vector, c), n) for n, c in enumerate(bounds.whole))
        yield np.array([i]), np.array([number]), np.array([vector], dtype=object), np.array([best], dtype=object)


def new_centroids(vectors: DataFrame, bounds: Filter, width: int) -> list[list[int]]:
    """Floors of the means of each cluster; an empty cluster keeps its centroid."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clusters = len(bounds.whole)
        total = np.zeros((clusters, width + 1), dtype=object)  # the last column counts
        for batch in batches:
            for _, number, data, _ in _assigned(batch, bounds, width):
                for cluster in np.unique(number):
                    mine = data[number == cluster]
                    total[cluster, :-1] += mine.sum(axis=0).astype(object)
                    total[cluster, -1] += len(mine)
        cells = [(i, j, level, Decimal(x)) for (i, j), v in np.ndenumerate(total) for level, x in enumerate(limbs(int(v)))]
        columns = list(zip(*cells)) or [[]] * 4
        types = [pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["cluster", "component", "limb", "value"])

    total = [[0] * (width + 1) for _ in bounds.whole]
    cells = vectors.mapInArrow(sums, "cluster int, component int, limb int, value decimal(38, 0)")
    for cluster, component, limb, value in cells.groupBy("cluster", "component", "limb").agg(F.sum("value")).collect():
        total[cluster][component] += int(value) << (LIMB * limb)
    return [[x // t[-1] for x in t[:-1]] if t[-1] else c for t, c in zip(total, bounds.whole)]


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(digest.alias("digest"), "narrow", "wide").orderBy("digest", "narrow", "wide").limit(clusters).collect()
    return [[int(x) for x in (r.narrow if r.narrow is not None else r.wide)] for r in sorted(rows, key=lambda r: (r.digest, r.narrow is not None, r.narrow or [], r.wide or []))]


def cluster(
    embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED
) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster and distance of every vector, and the final centroids."""
    ship(embeddings.sparkSession)
    kept = kept_vectors(embeddings, width, scale)
    mean, turn = rotation(kept, width)
    vectors = written(stored(kept, mean, turn, width))
    centroids = first_centroids(vectors, clusters, seed)
    for _ in range(rounds if centroids else 0):
        centroids = new_centroids(vectors, Filter(centroids, mean, turn), width)
    bounds = Filter(centroids, mean, turn) if centroids else None

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            numbers, distances = [0] * len(batch), [None] * len(batch)
            for rows, number, _, best in _assigned(batch, bounds, width):
                for i, n, d in zip(rows.tolist(), number.tolist(), best.tolist()):
                    numbers[i], distances[i] = n, d if d <= LONGEST else None
            columns = [batch["vec_id"], pa.array(numbers, pa.int32()), pa.array(distances, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(assign, "vec_id long, cluster int, distance long"), centroids


def centroids_query(spark: SparkSession, folder: str) -> DataFrame:
    """All of `embeddings`, with the sums of each cluster and digests of the centroids."""
    found, centroids = cluster(spark.read.parquet(f"{folder}/embeddings.parquet"))
    found = written(found)
    # A sum over a distance beyond a long, or beyond one itself, is null.
    total = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    of_cluster = found.groupBy("cluster").agg(total.alias("sum"))
    known = of_cluster.collect()  # one row per cluster
    whole = None if any(r["sum"] is None for r in known) else sum(int(r["sum"]) for r in known)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fits = lambda x: None if x is None or x > LONGEST else int(x)
    stats = spark.createDataFrame(
        [(r["cluster"], fits(r["sum"]), fits(whole), digest[r["cluster"]]) for r in known],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.join(F.broadcast(stats), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
