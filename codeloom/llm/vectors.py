"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Rotations that balance the bits of binary codes are learnt on a bounded sample. Every vector
gets codes from each rotation; parts of a code are the keys of a table, so that vectors that
agree in one part meet in a bucket. Vectors that meet are compared by the cosine of their
original components in double precision. The bits of a key follow from the number of vectors,
so buckets stay small, and the number of tables from the wanted recall: it is measured, with the
learnt rotations, on pairs of the sample and on partners made at the threshold's cosine. Where a
common mean or a skewed spread leaves too little agreement for MOST_TABLES, keys get shorter,
down to none, when all vectors are compared with all, block by block.

Buckets are split into blocks when they are large, and all blocks are compared. A pair counts
in the first table in which it meets, so no pairs leave a task: only each vector's number of
links and edges that keep the links' components. Equal vectors are folded before.

Defined results: vectors that are null, zero, or hold null or non-finite components link with
nothing; shorter vectors count as filled up with zeros; rows that repeat a vector link with
each other, also if they repeat an id; an empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import ship, written
from codeloom.llm.graphs import components

THRESHOLD = 0.9
#: Recall aimed at, as measured on pairs at the threshold.
RECALL = 0.97
#: Tables at most, and vectors of the sample that partners are made for.
MOST_TABLES, PAIRED = 160, 2_048
#: Pairs at the threshold in the sample from which on they are measured, too.
LEAST_PAIRS = 32
#: Vectors of the sample that rotations are learnt on, and rounds of learning.
SAMPLE, LEARNING = 8_192, 30
CODE_BITS = 64
#: Vectors in a bucket, about, and in a block of one that is larger.
BUCKET, BLOCK = 64, 4_096
#: Rows of a block that are compared at once.
SLICE = 256


def usable(column: str) -> Column:
    """The vector as doubles, or null where it takes no part."""
    numbers = F.transform(F.col(column), lambda x: x.cast("double"))
    bad = F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists(numbers, lambda x: x != 0)
    return F.when(~bad & ~zero, numbers)


class Rotations:
    """The mean, and projections to at most CODE_BITS balanced directions each, learnt one by
    one as tables ask for them."""

    def __init__(self, sample: np.ndarray, seed: int = 7) -> None:
        self.seed, self.turns = seed, []
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        self.width = min(CODE_BITS, sample.shape[1])
        _, _, axes = np.linalg.svd(centred, full_matrices=False)
        axes = axes[: self.width]
        if len(axes) < self.width:
            # Fewer samples than directions: the rest is filled up at random.
            extra = np.random.default_rng(seed).normal(size=(sample.shape[1], self.width - len(axes))).T
            axes = np.vstack([axes, extra / np.linalg.norm(extra, axis=1, keepdims=True)])
        self.axes, self.low = axes, centred @ axes.T

    def learn(self) -> None:
        turn, _ = np.linalg.qr(np.random.default_rng([self.seed, len(self.turns)]).normal(size=(self.width, self.width)))
        for _ in range(LEARNING):
            codes = np.where(self.low @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(codes.T @ self.low)
            turn = (left @ right).T
        self.turns.append(self.axes.T @ turn)

    def keys(self, unit: np.ndarray, bits: int, tables: range) -> np.ndarray:
        """The vectors' keys in some tables, one column each."""
        keys = np.zeros((len(unit), len(tables)), dtype=np.int32)
        per_code, weight = max(1, self.width // max(bits, 1)), 1 << np.arange(bits)
        for column, table in enumerate(tables):
            turn, part = divmod(table, per_code)
            while bits and turn >= len(self.turns):
                self.learn()
            if bits:
                keys[:, column] = ((unit - self.mean) @ self.turns[turn][:, part * bits : (part + 1) * bits] >= 0) @ weight
        return keys


def made_partners(unit: np.ndarray, threshold: float, seed: int = 11) -> list[np.ndarray]:
    """Two partners of each vector at the threshold's cosine: off in any direction, and off
    along the difference of two other vectors, as the data spread."""
    rng = np.random.default_rng(seed)
    out = []
    for away in (rng.normal(size=unit.shape), unit[rng.permutation(len(unit))] - unit[rng.permutation(len(unit))]):
        away = away + 1e-9 * rng.normal(size=unit.shape)
        away -= (away * unit).sum(axis=1, keepdims=True) * unit
        size = np.linalg.norm(away, axis=1, keepdims=True)
        out.append(threshold * unit + math.sqrt(1 - threshold**2) * away / np.where(size > 0, size, 1))
    return out


def choose(sample: np.ndarray, bits: int, threshold: float, recall: float) -> tuple[Rotations, int, int]:
    """The rotations, bits of a key and number of tables by which the wanted share of pairs
    meets in a table: of made partners of either kind, and of the pairs that the sample holds.
    Fewer bits are tried until MOST_TABLES suffice; with none, every pair is compared."""
    rotations = Rotations(sample)
    some = sample[:PAIRED]
    partners = made_partners(some, threshold)
    first, second = np.nonzero(np.triu(some @ some.T >= threshold, 1))
    if len(first) > PAIRED:
        chosen = np.random.default_rng(rotations.seed).choice(len(first), PAIRED, replace=False)
        first, second = first[chosen], second[chosen]
    while bits:
        met = [np.zeros(len(some), dtype=bool) for _ in partners]
        if len(first) >= LEAST_PAIRS:
            met.append(np.zeros(len(first), dtype=bool))
        # With as many tables as half the buckets of one, all against all is no dearer.
        for table in range(min(MOST_TABLES, 2**bits // 2)):
            here = range(table, table + 1)
            own = rotations.keys(some, bits, here)[:, 0]
            same = [own == rotations.keys(other, bits, here)[:, 0] for other in partners] + [own[first] == own[second]]
            for seen, now in zip(met, same):
                seen |= now
            worst = min(seen.mean() for seen in met)
            if worst >= recall:
                return rotations, bits, table + 1
            # Far from the aim after half of the tables: no need to try the others.
            if table == MOST_TABLES // 2 and worst < recall / 2:
                break
        bits -= 1
    return rotations, 0, 1


def block_links(ids: np.ndarray, copies: np.ndarray, unit: np.ndarray, keys: np.ndarray, table: int, left: np.ndarray, threshold: float):
    """Links inside one block pair: per vector its number of linked rows, and edges. `left`
    marks the vectors of the first block; where all are, the block meets itself."""
    label = np.arange(len(ids))
    links = np.zeros(len(ids), dtype=np.int64)
    first = np.flatnonzero(left)
    second = first if left.all() else np.flatnonzero(~left)
    for at in range(0, len(first), SLICE):
        some = first[at : at + SLICE]
        near = unit[some] @ unit[second].T >= threshold
        a, b = np.nonzero(near)
        a, b = some[a], second[b]
        new = a < b if left.all() else np.ones(len(a), dtype=bool)
        for t in range(table):
            new &= keys[a, t] != keys[b, t]
        a, b = a[new], b[new]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        for i in np.unique(a):
            among = np.unique(label[np.append(b[a == i], i)])
            if len(among) > 1:
                label[np.isin(label, among[1:])] = among[0]
    return links, label


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET, block: int = BLOCK
) -> DataFrame:
    """One row per vector row: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    ship(spark)
    rows = written(vectors.select("vec_id", usable("embedding").alias("v")))
    classes = written(
        rows.where(F.col("v").isNotNull()).groupBy("v")
        .agg(F.min("vec_id").alias("smallest"), F.count("*").alias("copies"))
        .withColumn("class_id", F.monotonically_increasing_id())
    )
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = size["n"], size["width"] or 1
    bits = int(np.clip(math.ceil(math.log2(max(n, 2) / bucket)), min(6, width), min(24, CODE_BITS, width)))
    # A sample of bounded size, taken by a hash of the vector.
    share = min(1.0, SAMPLE / max(n, 1))
    place = F.pmod(F.xxhash64("v"), F.lit(1 << 20)) / float(1 << 20)
    sample = [r["v"] for r in classes.where(place < share).select("v").limit(2 * SAMPLE).collect()]
    rotations, bits, tables = choose(_matrix(sample, width), bits, threshold, recall) if sample else (None, 0, 1)
    if rotations:
        rotations.low = None
    model = spark.sparkContext.broadcast(rotations)

    def keyed(batches):
        for batch in batches:
            keys = model.value.keys(_matrix(batch["v"].to_pylist(), width), bits, range(tables))
            yield pa.RecordBatch.from_arrays(
                [batch["class_id"], batch["copies"], batch["v"], pa.array(list(keys), pa.list_(pa.int32()))],
                names=["class_id", "copies", "v", "keys"],
            )

    coded = written(
        classes.select("class_id", "copies", "v").mapInArrow(keyed, "class_id long, copies long, v array<double>, keys array<int>")
    )
    meeting = coded.select("class_id", F.posexplode("keys").alias("table", "key"))
    sizes = meeting.groupBy("table", "key").count().where(F.col("count") > 1).select(
        "table", "key", F.ceil(F.col("count") / block).cast("int").alias("parts")
    )
    dealt = (
        coded.select("class_id", "copies", "v", "keys", F.posexplode("keys").alias("table", "key"))
        .join(sizes, ["table", "key"])
        .withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "table", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            (F.col("own") <= F.col("other")).alias("first"), "class_id", "copies", "v", "keys",
        )
    )

    def compare(block_rows: pa.Table) -> pa.Table:
        block_rows = block_rows.sort_by("class_id")
        ids, copies = block_rows["class_id"].to_numpy(), block_rows["copies"].to_numpy()
        keys = _matrix(block_rows["keys"].to_pylist(), tables, np.int32, False)
        links, label = block_links(
            ids, copies, _matrix(block_rows["v"].to_pylist(), width), keys,
            block_rows["table"][0].as_py(), np.asarray(block_rows["first"]), threshold,
        )
        out = np.flatnonzero((links > 0) | (label != np.arange(len(ids))))
        return pa.table({"class_id": ids[out], "links": links[out], "root": ids[label[out]]})

    found = written(
        dealt.groupBy("table", "key", "i", "j").applyInArrow(compare, "class_id long, links long, root long")
    )
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    judged = (
        classes.join(links, "class_id", "left").join(roots.withColumnRenamed("node", "class_id"), "class_id", "left")
        .withColumn("root", F.coalesce("root", "class_id"))
    )
    named = judged.groupBy("root").agg(F.min("smallest").alias("component_id"))
    judged = judged.join(named, "root").select(
        "v", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    linked = rows.where(F.col("v").isNotNull()).join(judged, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where(F.col("v").isNull()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _matrix(lists: list, width: int, kind: type = np.float64, unit: bool = True) -> np.ndarray:
    out = np.zeros((len(lists), width), dtype=kind)
    for i, row in enumerate(lists):
        out[i, : len(row)] = row
    if unit and len(out):
        # Scaled by the largest component first, so that no square over- or underflows.
        out /= np.abs(out).max(axis=1, keepdims=True)
        out /= np.linalg.norm(out, axis=1, keepdims=True)
    return out


def vectors_query(spark: SparkSession, folder: str) -> DataFrame:
    """All of `embeddings`, whatever their labels."""
    return near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding"))
