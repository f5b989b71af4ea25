"""Fill-in-middle documents by secondary sort.

Each text is split at two units of `UNIT` into prefix, middle and suffix, by numbers from a
hash of its id, and put in another order between markers. Texts are emitted as unit-chunk
pieces (at most `CHUNK` characters, ended at a unit's end) keyed by document and place in the
output; one exchange by document with a sort by place hands them to a stream that digests the
output as it passes and never holds a document. The stream finds the markers in the output
itself and emits the pieces again with their place in the restored text; a second sort within
the same partitions feeds a second digest, so restoring needs no exchange.

Defined results: a null text is an empty text, which stays plain; a null id has no digits; bytes
that are not UTF-8 become replacement characters; every row is a document of its own, so
repeated rows and equal ids give a result each; very long texts flow through in pieces, one
document being one task's stream, because a digest is sequential; there are no ties; other
columns, whatever their names, are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import ship

#: A unit of text: `[A-Za-z]+|[^A-Za-z]`. Characters of a piece, and of a block that is scanned at once.
CHUNK, SCAN = 1 << 15, 1 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The order of the sections in each form, and in the text.
ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
RANK = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
SEED, RATE, SPM_RATE = 1, 90, 20

PIECE = "row long, place long, doc_id long, n long, form string, prefix_chars long, middle_chars long, piece string"
RESTORED = "row long, rank int, place long, doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, piece string"


def draws(doc_id: Column, seed: int = SEED) -> Column:
    """Four numbers: 32 bits each of the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)))


def unit_starts(text: str, start: int, end: int) -> np.ndarray:
    """Places in `text[start:end]` where a unit starts, counted from `start`."""
    part = text[max(0, start - 1) : end]
    points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = ((points | 32) - np.uint32(97)) < 26
    starts = ~letter
    starts[1:] |= ~letter[:-1]
    starts[:1] = True
    return np.flatnonzero(starts[start > 0 :])


def count_units(text: str) -> int:
    return sum(len(unit_starts(text, at, at + SCAN)) for at in range(0, len(text), SCAN))


def unit_places(text: str, units: list[int]) -> list[int]:
    """Characters before each of the given ascending numbers of units."""
    found, seen = [], 0
    for at in range(0, len(text), SCAN):
        starts = unit_starts(text, at, at + SCAN)
        while len(found) < len(units) and units[len(found)] < seen + len(starts):
            found.append(at + int(starts[units[len(found)] - seen]))
        seen += len(starts)
        if len(found) == len(units):
            break
    return found + [len(text)] * (len(units) - len(found))


def unit_end(text: str, start: int, end: int, size: int) -> int:
    """Where a piece from `start` ends: at a unit's end, or after `size` letters of a longer one."""
    stop = start + size
    if stop >= end:
        return end
    starts = unit_starts(text, start + 1, stop + 1)
    return start + 1 + int(starts[-1]) if len(starts) else stop


def chunked(text: str, start: int, end: int, size: int) -> Iterator[str]:
    while start < end:
        stop = unit_end(text, start, end, size)
        yield text[start:stop]
        start = stop


def plan(text: str, drawn: list[int], rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None]:
    """Units, form, and characters of prefix and middle."""
    n = count_units(text)
    if not text or any(marker in text for marker in RANK) or drawn[2] % 100 >= rate:
        return n, "plain", None, None
    before, after = unit_places(text, sorted((drawn[0] % (n + 1), drawn[1] % (n + 1))))
    return n, "spm" if drawn[3] % 100 < spm_rate else "psm", before, after - before


def output(text: str, form: str, prefix: int | None, middle: int | None, size: int) -> Iterator[str]:
    """The output's pieces in order, markers with what follows them."""
    if form == "plain":
        yield from chunked(text, 0, len(text), size)
        return
    spans = {PREFIX: (0, prefix), MIDDLE: (prefix, prefix + middle), SUFFIX: (prefix + middle, len(text))}
    for marker in ORDER[form]:
        first, *others = [*chunked(text, *spans[marker], size)] or [""]
        yield marker + first
        yield from others


def pieces(
    documents: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, chunk: int = CHUNK
) -> DataFrame:
    """The output of every document as pieces: row, place, doc_id, n, form, prefix_chars,
    middle_chars and piece; the first of a document always, empty or not."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, held = [[] for _ in names], 0
            for row, doc_id, data, drawn in zip(*(batch[c].to_pylist() for c in ("row", "doc_id", "text", "drawn"))):
                text = (data or b"").decode("utf-8", "replace")
                about = plan(text, drawn, rate, spm_rate)
                wrote = False
                for place, piece in enumerate(output(text, *about[1:], chunk)):
                    put(columns, (row, place, doc_id, *about, piece))
                    wrote, held = True, held + len(piece)
                    if held >= SCAN:
                        yield filled(columns)
                        columns, held = [[] for _ in names], 0
                if not wrote:
                    put(columns, (row, 0, doc_id, *about, ""))
            yield filled(columns)

    names = [field.split()[0] for field in PIECE.split(", ")]
    types = [pa.string() if field.endswith("string") else pa.int64() for field in PIECE.split(", ")]
    filled = lambda columns: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("binary").alias("text"),
        draws(F.col("doc_id").cast("long"), seed).alias("drawn"),
    )
    return rows.mapInArrow(emit, PIECE)


def put(columns: list[list], values: tuple) -> None:
    for column, value in zip(columns, values):
        column.append(value)


class Sections:
    """Finds the markers of an output that passes piece by piece, in their known order."""

    def __init__(self, form: str) -> None:
        self.ahead = list(ORDER.get(form, ()))
        self.rank, self.held = 0, ""

    def read(self, piece: str, last: bool = False) -> Iterator[tuple[int, str]]:
        """Parts of sections, each with its section's rank in the text."""
        text = self.held + piece
        self.held = ""
        while self.ahead and (at := text.find(self.ahead[0])) >= 0:
            if at:
                yield self.rank, text[:at]
            self.rank = RANK[marker := self.ahead.pop(0)]
            text = text[at + len(marker) :]
        if self.ahead and not last:
            # The next marker may have begun.
            text, self.held = text[:-2], text[-2:]
        if text:
            yield self.rank, text


def assembled(made: DataFrame) -> DataFrame:
    """Streams the pieces of each output in order: its digest, and the pieces in the order of
    the restored text, the digest's row last."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = about = digest = sections = None
        place, held = 0, 0
        columns = [[] for _ in names]

        def restored(piece: str, last: bool) -> int:
            nonlocal place
            for rank, part in sections.read(piece, last):
                put(columns, (row, rank, place, *[None] * 6, part))
                place += 1
            return len(piece)

        def done() -> None:
            if row is not None:
                restored("", True)
                put(columns, (row, len(RANK), 0, *about, digest.hexdigest(), None))

        for batch in batches:
            for own, piece, *fields in zip(*(batch[c].to_pylist() for c in ("row", "piece", *names[3:8]))):
                if own != row:
                    done()
                    row, about, digest, sections, place = own, fields, hashlib.sha256(), Sections(fields[2]), 0
                digest.update(piece.encode("utf-8"))
                held += restored(piece, False)
                if held >= SCAN:
                    yield filled(columns)
                    columns[:], held = [[] for _ in names], 0
        done()
        yield filled(columns)

    names = [field.split()[0] for field in RESTORED.split(", ")]
    types = [{"int": pa.int32(), "long": pa.int64()}.get(field.split()[1], pa.string()) for field in RESTORED.split(", ")]
    filled = lambda columns: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
    return made.repartition("row").sortWithinPartitions("row", "place").mapInArrow(stream, RESTORED)


def digests(restored: DataFrame) -> DataFrame:
    """One row per document: what `assembled` says of it and the digest of the restored text."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = hashlib.sha256()
        for batch in batches:
            columns = [[] for _ in names]
            for rank, piece, *fields in zip(*(batch[c].to_pylist() for c in ("rank", "piece", *names[:-1]))):
                if rank < len(RANK):
                    digest.update(piece.encode("utf-8"))
                else:
                    put(columns, (*fields, digest.hexdigest()))
                    digest = hashlib.sha256()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return restored.sortWithinPartitions("row", "rank", "place").mapInArrow(stream, schema)


def fill_in_middle(documents: DataFrame, **options: int) -> DataFrame:
    """Outputs as text, one row per document: doc_id, n, form, prefix_chars, middle_chars,
    output. For documents that fit a cell; `pieces` has them in any size."""
    ship(documents.sparkSession)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, about, parts = None, None, []

        def done() -> Iterator[pa.RecordBatch]:
            if row is not None:
                values = (*about, "".join(parts))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

        for batch in batches:
            for own, piece, *fields in zip(*(batch[c].to_pylist() for c in ("row", "piece", *names[:-1]))):
                if own != row:
                    yield from done()
                    row, about, parts = own, fields, []
                parts.append(piece)
        yield from done()

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    made = pieces(documents, **options).repartition("row").sortWithinPartitions("row", "place")
    return made.mapInArrow(join, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def infilling_query(spark: SparkSession, folder: str) -> DataFrame:
    """All of `documents`; digests stand for the texts."""
    ship(spark)
    return digests(assembled(pieces(spark.read.parquet(f"{folder}/documents.parquet"))))
