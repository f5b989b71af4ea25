"""Packing by best-fit decreasing.

Each document becomes token ids with an end id. Overlong documents are first cut into full
windows; what is left of each goes, longest first, into the open window with the least room
that still holds it, found by a segment tree indexed by remaining capacity. The rest pieces
are dealt into shards of bounded size, which Spark packs side by side; only a shard's last
windows stay partly empty, so the loss does not grow with the corpus.

Defined results: a null text is an empty text, whose only token is the end id; every row is a
document, so repeated rows are packed once each; an empty table gives none.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import ship, written

WINDOW = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Tokens and pieces of one shard, at most about; a shard is packed in one task.
SHARD_TOKENS, SHARD_PIECES = 1 << 23, 1 << 18
#: Words whose ids a Python worker remembers.
REMEMBERED = 400_000

# One pretoken of letters that every normal form leaves alone, and a run of marks.
SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]*)")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of words, as packed little-endian 32-bit numbers. The tokenizer's words end
    at white space, so a text's ids are those of its parts between ASCII white space."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        # Added tokens are taken out of a text first, as the library does by default.
        added = {t.content.encode(): i for i, t in self.whole.get_added_tokens_decoder().items()}
        self.added = {literal: self.packed([i]) for literal, i in added.items()}
        self.split = re.compile(b"(" + b"|".join(map(re.escape, sorted(added, key=len, reverse=True))) + b")").split
        self.bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.parts: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        """Ids of one pretoken in lower case."""
        if (found := self.words.get(word)) is None:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            symbols = word if word.isascii() else self.bytes_of(word)[0][0]
            found = self.words[word] = self.packed([t.id for t in self.model.tokenize(symbols)])
        return found

    def part(self, part: bytes) -> bytes:
        text = part.decode("utf-8", "replace")
        if simple := SIMPLE.fullmatch(text):
            found = self.word(simple[1].lower())
            found = found + self.word(simple[2]) if simple[2] else found
        else:
            found = self.packed(self.whole.encode(text, add_special_tokens=False).ids)
        if len(self.parts) >= REMEMBERED:
            self.parts.clear()
        if len(part) <= 64:
            self.parts[part] = found
        return found

    def plain(self, text: bytes) -> bytes:
        known, part = self.parts.get, self.part
        return b"".join([known(p) or part(p) for p in text.split()])

    def text(self, text: bytes) -> bytes:
        if not any(literal in text for literal in self.added):
            return self.plain(text)
        return b"".join([self.added.get(p) or self.plain(p) for p in self.split(text)])


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(documents: DataFrame, path: str, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids. Full windows first."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).text
        end = Encoder.packed([END_ID])
        for batch in batches:
            rows, starts, lengths, sums, totals, ids = [], [], [], [], [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                data = encode(text or b"") + end
                total = len(data) // 4
                for start in range(0, total, window):
                    own = data[4 * start : 4 * (start + window)]
                    rows.append(i)
                    starts.append(start)
                    lengths.append(len(own) // 4)
                    sums.append(zlib.crc32(own))
                    totals.append(total)
                    if with_ids:
                        ids.append(np.frombuffer(own, dtype="<u4").astype(np.int32))
            columns = [batch["doc_id"].take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(pieces, schema)


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of every length, packed longest first."""
    leaves = 1 << (window + 1).bit_length()
    tree = bytearray(2 * leaves)  # 1: an open window has a capacity in this node's range
    open_windows: list[list[int]] = [[] for _ in range(window + 1)]
    number, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    used = 0

    def mark(capacity: int, value: int) -> None:
        node = leaves + capacity
        tree[node] = value
        while node > 1:
            node >>= 1
            value = tree[2 * node] | tree[2 * node + 1]
            if tree[node] == value:
                break
            tree[node] = value

    def tightest(least: int) -> int:
        node = leaves + least
        if tree[node]:
            return least
        while node > 1 and (node & 1 or not tree[node + 1]):
            node >>= 1
        if node <= 1:
            return -1
        node += 1
        while node < leaves:
            node = 2 * node + (not tree[2 * node])
        return node - leaves

    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        room = tightest(length)
        if room < 0:
            room, at = window, used
            used += 1
        else:
            at = open_windows[room].pop()
            if not open_windows[room]:
                mark(room, 0)
        number[i], offset[i] = at, window - room
        if left := room - length:
            if not open_windows[left]:
                mark(left, 1)
            open_windows[left].append(at)
    return number, offset


def pack(
    documents: DataFrame, path: str | None = None, window: int = WINDOW, with_ids: bool = True
) -> DataFrame:
    """Pieces with `sequence_id` and `offset`. Sequence ids of full windows are even, those of
    shared windows odd."""
    ship(documents.sparkSession)
    path = vocabulary_path() if path is None else path
    pieces = written(cut(documents, path, window, with_ids).withColumn("row", F.monotonically_increasing_id()))
    full = pieces.where(F.col("length") == window).withColumn("sequence_id", F.col("row") * 2).withColumn(
        "offset", F.lit(0).cast("long")
    )
    rest = pieces.where(F.col("length") < window)
    size = rest.agg(F.sum("length").alias("tokens"), F.count("*").alias("pieces")).first()
    shards = max(1, math.ceil((size["tokens"] or 0) / SHARD_TOKENS), math.ceil(size["pieces"] / SHARD_PIECES))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        number, offset = best_fit(table["length"].to_numpy(), window)
        shard = table["shard"][0].as_py()
        table = table.drop_columns(["shard"])
        table = table.append_column("sequence_id", pa.array(((shard << 32) + number) * 2 + 1, pa.int64()))
        return table.append_column("offset", pa.array(offset, pa.int64()))

    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("long"))
    packed = dealt.groupBy("shard").applyInArrow(place, full.schema)
    return full.unionByName(packed).drop("row")


def packing_query(spark: SparkSession, folder: str) -> DataFrame:
    """All of `documents`; the digest of a piece's ids stands for the ids."""
    return pack(spark.read.parquet(f"{folder}/documents.parquet"), with_ids=False)
