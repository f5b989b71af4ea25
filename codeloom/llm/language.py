"""Language identification: multinomial naive Bayes over hashed character n-grams.

Lower-cased texts become n-grams of one to three code points, hashed into buckets. Counts per
language give a matrix of log-probabilities, which is broadcast; batches of texts are scored
as sparse rows against it in numpy. The matrix is kept below MODEL_BYTES by taking fewer
buckets for more languages, whatever the corpus.

Defined results: null texts and texts without a letter are `und` with score 0, and so is
everything where no labelled row exists; a null id counts as the empty text and is never held
out; repeated rows give repeated results; an empty table gives none. Language, source and id
never enter a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import ship

#: Labelled rows per language that the model is fitted on, about, and languages it can hold.
TRAIN_ROWS = 5_000
LANGUAGES = 1_024
#: Partitions of the training sample.
TRAIN_PARTITIONS = 16
MODEL_BYTES = 64 << 20
BUCKETS = 1 << 16
SMOOTHING = 0.5
ORDERS = 3
#: N-grams scored together.
BATCH = 1 << 20
UNKNOWN = "und"
#: Texts below this score are rejected by the pipeline.
LEAST_SCORE = 0.5

#: Odd multipliers of the n-gram hash.
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def n_grams(text: str, buckets: int) -> np.ndarray:
    """Bucket of every n-gram of every order."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    out, rolled = [], np.zeros(len(points), dtype=np.uint32)
    for order in range(min(ORDERS, len(points))):
        rolled = rolled[: len(points) - order] * np.uint32(31) + points[order:] * MULTIPLIERS[order]
        mixed = (rolled ^ (rolled >> np.uint32(15))) * MULTIPLIERS[(order + 1) % ORDERS]
        out.append(mixed >> shift)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_likelihood: np.ndarray  # (buckets, languages)

    def scores(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, values = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, values
        rows, grams, held = [], [], 0
        for i, text in enumerate(texts):
            if has_letter(text):
                g = n_grams(text, len(self.log_likelihood))
                rows.append(i)
                grams.append(g)
                held += len(g)
            if rows and (held >= BATCH or i == len(texts) - 1):
                self._flush(rows, grams, names, values)
                rows, grams, held = [], [], 0
        if rows:
            self._flush(rows, grams, names, values)
        return names, values

    def _flush(self, rows: list[int], grams: list[np.ndarray], names: list[str], values: list[float]) -> None:
        starts = np.cumsum([0, *map(len, grams[:-1])])
        joint = np.add.reduceat(self.log_likelihood[np.concatenate(grams)], starts, axis=0, dtype=np.float64)
        joint += self.log_prior
        best = joint.argmax(axis=1)
        chance = 1.0 / np.exp(joint - joint.max(axis=1, keepdims=True)).sum(axis=1)
        for i, b, c in zip(rows, best, chance):
            names[i], values[i] = self.languages[b], float(c)


def fit(documents: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model of all languages among labelled rows that are not held out. Language counts
    come from every such row, n-gram counts from a sample of about `train_rows` each."""
    ship(documents.sparkSession)
    known = documents.where(F.col("lang").isNotNull() & ~held_out())
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return Model([], np.zeros(0), np.zeros((0, 0)))
    number = {r["lang"]: r["count"] for r in counts}
    buckets = BUCKETS
    while buckets > 256 and buckets * len(languages) * 8 > MODEL_BYTES:
        buckets //= 2
    # Sampled by a hash of the id, so the same rows are taken however the table is split.
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, train_rows / number[lang]))))
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    sample = known.where(place < F.try_element_at(share, F.col("lang"))).select("lang", "text").repartition(TRAIN_PARTITIONS)
    index = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                if has_letter(text):
                    own = seen.setdefault(index[lang], np.zeros(buckets, dtype=np.int64))
                    own += np.bincount(n_grams(text, buckets), minlength=buckets)
        if seen:
            yield pa.RecordBatch.from_pydict(
                {"language": pa.array(list(seen), pa.int32()), "counts": pa.array([c.tobytes() for c in seen.values()], pa.binary())}
            )

    total = np.zeros((len(languages), buckets), dtype=np.int64)
    # At most one row per language and partition, each of a fixed size.
    for row in sample.mapInArrow(count, "language int, counts binary").toLocalIterator():
        total[row["language"]] += np.frombuffer(row["counts"], dtype=np.int64)
    smooth = total + SMOOTHING
    prior = np.array([number[lang] for lang in languages], dtype=float)
    likelihood = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    return Model(languages, np.log(prior / prior.sum()), np.ascontiguousarray(likelihood.T))


def predict(rows: DataFrame, model: Model) -> DataFrame:
    """`rows` (a column `text` and any others) and its `lang_pred` and `score`. No shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, values = shared.value.scores(batch["text"].to_pylist())
            columns = [batch[c] for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(values, pa.float64())], names=out)

    kept = [c for c in rows.columns if c != "text"]
    out = [*kept, "lang_pred", "score"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(score, f"{fields}, lang_pred string, score double")


def identify(documents: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = fit(documents, train_rows)
    return predict(documents.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text")), model)


def keep_known(documents: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """`documents` without those that have no language or a score below the least."""
    model = fit(documents)
    rows = documents.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    known = predict(rows, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score))
    return known.select("row.*")


def language_query(spark: SparkSession, folder: str) -> DataFrame:
    """All of `documents`, learnt from the rows that are not held out."""
    return identify(spark.read.parquet(f"{folder}/documents.parquet"))
