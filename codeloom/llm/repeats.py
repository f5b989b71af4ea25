"""Substring de-duplication by sliding sentence spans.

Texts are cut into sentences, at the marks of many scripts, and long sentences into pieces at
words that only the words around them choose, so that equal passages are cut alike whatever
stands before them. From every sentence, and up to every sentence, the shortest run of several
sentences with enough words is hashed. Hashes are counted over the whole corpus; of every
repeated run the first occurrence, by smallest id and place, stays, and the sentences that any
other occurrence covers are removed. In scripts without spaces each character is a word.

Defined results: a null text stays null and an empty one empty; texts with too few sentences
or words have no run and stay whole; rows equal in id and text are one document and are
treated alike; a null id counts as the smallest; an empty table gives none.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.common import ship, written

#: Sentences and words of a run, at least.
SENTENCES, WORDS = 2, 20
#: A sentence of this many words is cut: each LONG words in a row hold a cut.
LONG = 20
#: Runs with more than this part of all occurrences skip the shuffle.
HOT = 1024
#: Frequent runs that are asked for, and hashes tracked to find them.
LIMIT, TRACKED = 2048, 1 << 16

# A sentence's end with closing marks and the white space behind it. Marks of scripts that
# write no space after a sentence end it anywhere.
END = re.compile(
    "(?:[.!?\u2026\u061f\u06d4\u1362]+[\"')\\]\u2019\u201d\u00bb]*(?=\\s)"
    "|[\u3002\uff01\uff1f\uff0e\uff61\u0964\u0965\u104a\u104b\u17d4\u17d5]+[\u300d\u300f\u201d\u2019\uff09]*|\n)\\s*"
)
# Characters of scripts without spaces: Thai, Lao, Tibetan, Myanmar, Khmer, kana, ideographs.
DENSE = "\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
IS_DENSE = re.compile(f"[{DENSE}]")
WORD, DENSE_WORD = re.compile(r"\S+"), re.compile(rf"[{DENSE}]|[^\s{DENSE}]+")


def cuts(words: list[str]) -> list[int]:
    """Indexes of the words that end a piece: the least hash, the last of equal ones, of every
    LONG words in a row. The last word is none of them."""
    keys = [zlib.crc32(w.encode("utf-8", "replace")) for w in words[:-1]]
    window = min(LONG, len(keys))
    out, least = [], -1
    for i, key in enumerate(keys):
        if least <= i - window:
            least = min(range(max(0, i - window + 1), i + 1), key=lambda j: (keys[j], -j))
        elif key <= keys[least]:
            least = i
        if i >= window - 1 and (not out or out[-1] != least):
            out.append(least)
    return out


def sentences(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, normal form, words) of every sentence; together they are the text."""
    out, start = [], 0
    dense = not text.isascii() and IS_DENSE.search(text) is not None
    for end in [*(m.end() for m in END.finditer(text)), len(text)]:
        part = text[start:end]
        # Lower case word by word: of a whole text it may move the places.
        words = DENSE_WORD.findall(part) if dense else part.split()
        if not words:
            continue
        words = [w.lower() for w in words]
        if len(words) >= LONG:
            places = [m.start() for m in (DENSE_WORD if dense else WORD).finditer(part)]
            at = first = 0
            for cut in cuts(words):
                to = places[cut + 1]
                out.append((start + at, start + to, " ".join(words[first : cut + 1]), cut + 1 - first))
                at, first = to, cut + 1
            out.append((start + at, end, " ".join(words[first:]), len(words) - first))
        else:
            out.append((start, end, " ".join(words), len(words)))
        start = end
    return out


def runs(text: str, least_sentences: int = SENTENCES, least_words: int = WORDS) -> Iterator[tuple[int, int, int]]:
    """(hash, start, end) of the shortest sufficient runs from and up to every sentence."""
    parts = sentences(text)
    places = set()
    stop, words = 0, 0
    for i, part in enumerate(parts):
        while stop < len(parts) and (stop - i < least_sentences or words < least_words):
            words += parts[stop][3]
            stop += 1
        if stop - i < least_sentences or words < least_words:
            break
        places.add((i, stop))
        words -= part[3]
    i, words = 0, 0
    for stop, part in enumerate(parts, 1):
        words += part[3]
        while stop - i > least_sentences and words - parts[i][3] >= least_words:
            words -= parts[i][3]
            i += 1
        if stop - i >= least_sentences and words >= least_words:
            places.add((i, stop))
    for i, stop in sorted(places):
        digest = xxhash.xxh3_64_intdigest(" ".join(p[2] for p in parts[i:stop]))
        yield digest - (1 << 63), parts[i][0], parts[stop - 1][1]


def spans_of(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, hash, span): every run of every document, its start in the upper
    half of `span` and its end in the lower one, so that a run is four numbers in a shuffle."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes, spans = [], [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                for digest, start, end in runs(text or ""):
                    rows.append(i)
                    hashes.append(digest)
                    spans.append(start << 32 | end)
            at = pa.array(rows, pa.int64())
            columns = [batch["doc_id"].take(at), batch["text_hash"].take(at), pa.array(hashes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.int64())], names=["doc_id", "text_hash", "hash", "span"])

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(cut, "doc_id long, text_hash long, hash long, span long")


def repeated_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, end) of every non-first occurrence of a repeated run."""
    ship(documents.sparkSession)
    spans = written(spans_of(documents))
    place = F.struct("doc_id", "text_hash", "span")
    start, end = F.shiftright("span", 32).cast("int"), F.col("span").bitwiseAND(0xFFFFFFFF).cast("int")
    gone = ("doc_id", "text_hash", start.alias("start"), end.alias("end"))
    # About the runs that have more than 1 / HOT of all occurrences; which ones exactly does
    # not matter. Their first places are combined in each task: a passage of a third of all
    # documents is a row per task here.
    total, top = spans.agg(F.count("*"), F.expr(f"approx_top_k(hash, {LIMIT}, {TRACKED})")).first()
    hot = [x["item"] for x in top or () if x["count"] * HOT > total]
    hot_first = spans.where(F.col("hash").isin(hot)).groupBy("hash").agg(F.min(place).alias("hot_first"))
    # One row per occurrence whatever the groups. Those of a frequent run know its first place
    # already and are dealt by themselves. The place is a column before the window, which else
    # would shuffle it beside its parts.
    marked = spans.select("hash", place.alias("place")).join(F.broadcast(hot_first), "hash", "left")
    deal = F.when(F.col("hot_first").isNotNull(), F.xxhash64("place"))
    marked = marked.withColumn("deal", F.coalesce(deal, F.lit(0)))
    first = F.coalesce("hot_first", F.min("place").over(Window.partitionBy("hash", "deal")))
    found = marked.withColumn("first", first).where(~F.col("place").eqNullSafe(F.col("first")))
    return found.select("place.*").select(*gone)


def remove_repeats(documents: DataFrame) -> DataFrame:
    """One row per document row: `row` (the input row), `text` without the covered sentences,
    and `removed`, the disjoint spans taken out, as code points."""
    found = repeated_spans(documents).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "spans")
    rows = documents.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
    )
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    merged = F.aggregate(
        F.array_sort(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))),
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]),
            F.concat(
                F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        F.element_at(acc, -1)["start"].alias("start"),
                        F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    # The text goes through the exchange once, inside its row.
    joined = joined.select("row", F.col("row.text").cast("string").alias("text"), merged.alias("removed"))
    starts = F.concat(F.array(F.lit(0)), F.transform("removed", lambda s: s["end"]))
    ends = F.concat(F.transform("removed", lambda s: s["start"]), F.array(F.length("text")))
    kept = F.array_join(
        F.zip_with(starts, ends, lambda a, b: F.substring(F.col("text"), a + 1, b - a)), ""
    )
    return joined.select("row", F.when(F.size("removed") > 0, kept).otherwise(F.col("text")).alias("text"), "removed")


def repeats_query(spark: SparkSession, folder: str) -> DataFrame:
    """All of `documents`: what is left of each text and the spans that were removed."""
    result = remove_repeats(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return result.select(F.col("row.doc_id").alias("doc_id"), "text", spans.alias("removed"))
