"""Token counts by a compiled finite-state tokenizer.

A byte-level BPE tokenizer is compiled, state by state as texts need them, into a
deterministic transducer over characters. Each transition says by how many tokens the encoding
of the text read so far changes, so a text's count is the sum along its path.

- Merging: the encoding of a prefix ends with the one token that ends there and may follow the
  last token of what lies before it (two tokens may be neighbours if encoding their joined
  bytes gives these two). A state of this machine is the places from which a token may still
  reach further, each with the last token before it and its relative count.
- Splitting: character classes, contractions and the rule that the last white space of a run
  goes with the next word. Classes of characters are asked of the tokenizer library.

Texts of more than `CHUNK` characters are cut into chunks that Spark deals over all tasks. A
chunk's state map sends the state before it to the state after it and a count: where the chunk
has a boundary that no left context can move, only its head depends on that state; in a chunk
without any, the map is a table over the states that its left context allows. Maps compose
associatively, by blocks of chunks and then by text, like a prefix scan; a text whose state no
table holds is read through in one stream instead, with the same count.

Defined results: a null text is an empty text, with no bytes and no tokens; bytes that are not
UTF-8 count as replacement characters; every row is a document, so repeated rows and null ids
are counted each; very long texts are cut as above; there are no ties; other columns, whatever
their names, are ignored; an empty table gives none.
"""

from __future__ import annotations

import gc
import json
import os
import pickle
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import ship, written
from codeloom.session import scratch_path

VOCABULARY = "byte_bpe_50k.json"
#: Characters of a chunk, of the left context it keeps, and chunks whose maps one task composes.
CHUNK, CONTEXT, BLOCK = 1 << 16, 256, 64
#: Chunks of one file, so that a long text's chunks are read by several tasks.
FILE_CHUNKS = 256
#: Compiled transitions with neighbour checks, and counts of stretches of at most `STRETCH`
#: characters, that a Python worker keeps before it starts anew.
COMPILED, STRETCHES, STRETCH = 800_000, 800_000, 32
LIMIT = 512

SPACE, LETTER, NUMBER, OTHER = "space", "letter", "number", "other"
# The contractions of the split rule, after the apostrophe.
SHORT, LONG = "stmd", {"r": "e", "v": "e", "l": "l"}

START = ("start",)
NEVER = 1 << 60
#: The merging machine's state is the places where a token may begin that has not ended: the
#: bytes read since, the last token before and its count against now's. Before any byte:
NOTHING = ((b"", None, 0),)
BYTES = [bytes([value]) for value in range(256)]

Key = tuple
Head = list  # of texts and of tables {state: (count, state after)}
Map = tuple  # (head, count after the head, state after or None where the head is all)


class State(dict):
    """Transitions of one state by character: (next state, change of the count)."""

    __slots__ = ("key", "machine")

    def __init__(self, key: Key, machine: Machine) -> None:
        self.key, self.machine = key, machine

    def __missing__(self, char: str) -> tuple[State, int]:
        found = self[char] = self.machine.compile(self.key, char)
        return found


class Stretches(dict):
    """Counts of stretches of text that begin and end where a piece must: composed
    transitions, kept for stretches that may come again."""

    def __init__(self, machine: Machine) -> None:
        self.machine = machine

    def __missing__(self, stretch: str) -> int:
        count = self.machine.run(START, stretch)[1]
        if len(stretch) <= STRETCH:
            self[stretch] = count
        return count


class Machine:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and model["type"] == "BPE" and not model.get("ignore_merges")
        plain &= split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
        plain &= not model.get("dropout") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        if not plain:
            raise ValueError(f"not a plain byte-level BPE tokenizer: {path}")
        self.added = [t["content"] for t in spec["added_tokens"]]
        if any(a != b and b[0] in a for a in self.added for b in self.added) or any(a[0] in a[1:] for a in self.added):
            raise ValueError("added tokens may overlap each other")
        self.pieces = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        byte = self.bytes_by_sign()
        raw = lambda token: bytes(byte[c] for c in token)
        legal = lambda token: byte.keys() >= set(token)  # not so for bytes that UTF-8 never has
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in reversed(list(enumerate(merges))) if legal(a + b)}
        # Only a token that its own bytes are encoded to can be in an encoding. Its last merge:
        self.made: dict[bytes, tuple[int, bytes, bytes]] = {}
        for token in map(raw, filter(legal, model["vocab"])):
            *_, before, last = [[]] * 2 + list(self.merges(token))
            if len(last) == 1:
                self.made[token] = (self.rank[tuple(before)], *before) if before else (-1, token, token)
        self.begins = {t[:i] for t in self.made for i in range(len(t))}
        self.kinds: dict[str, str] = {}
        blank = re.escape("".join(c for c in map(chr, (*range(0xD800), *range(0xE000, 0x10000))) if self.kind(c) == SPACE))
        # A piece begins at white space after anything else, and after ASCII letters at any ASCII sign.
        self.stretch = re.compile(f"[{blank}]*[A-Za-z]++(?![^\\0-\x7f])|[{blank}]*[^{blank}]+|[{blank}]+").findall
        self.kinds.clear()
        self.clear()

    def bytes_by_sign(self) -> dict[str, int]:
        """The printable sign that stands for each byte in the file, asked of the library."""
        signs = {}
        for point in [*range(128), *range(0x80, 0x800, 0x40), *range(0x80, 0xC0), *range(0x1000, 0x10000, 0x1000), 0x800, 0xD7FF, *range(0x10000, 0x110000, 0x40000), 0x10FFFF]:
            data = chr(point).encode()
            for sign, value in zip("".join(p for p, _ in self.pieces(chr(point))), data):
                signs[sign] = value
        return signs

    def clear(self) -> None:
        self.size = 0
        self.states: dict[Key, State] = {}
        self.counts = Stretches(self)
        self.may: dict[tuple[bytes, bytes], bool] = {}

    def tidy(self) -> None:
        """Between texts: start anew where too much has been compiled."""
        if len(self.counts) > STRETCHES:
            self.counts.clear()
        if self.size + len(self.may) > COMPILED:
            self.clear()

    def state(self, key: Key) -> State:
        if (found := self.states.get(key)) is None:
            found = self.states[key] = State(key, self)
        return found

    # Merging, by bytes.

    def merges(self, data: bytes) -> Iterator[list[bytes]]:
        """The steps to the encoding of a few bytes: the merge of lowest rank first, from the left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        yield parts
        while len(parts) > 1:
            ranks = [self.rank.get(pair, NEVER) for pair in zip(parts, parts[1:])]
            if (least := min(ranks)) == NEVER:
                break
            at = ranks.index(least)
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
            yield parts

    def length(self, data: bytes) -> int:
        return len([*self.merges(data)][-1])

    def neighbours(self, left: bytes | None, right: bytes) -> bool:
        """Whether the encoding of both is these two. Their merges are undone, the latest first:
        at no time may the two parts that meet have merged before one of them went into
        another part. Of equal merges the left one comes first."""
        if left is None:
            return True
        if (found := self.may.get((left, right))) is None:
            pair, until, found = (left, right), NEVER, True
            while True:
                if self.rank.get((left, right), NEVER) < until:
                    found = False
                    break
                (a, _, tail), (b, head, _) = self.made[left], self.made[right]
                if a < 0 and b < 0:
                    break
                if a > b:
                    until, left = a, tail
                else:
                    until, right = b + 1, head
            self.may[pair] = found
        return found

    def read_bytes(self, bpe: tuple, data: bytes) -> tuple[tuple, int]:
        """The merging machine after more bytes, and the change of the count."""
        change, made, begins = 0, self.made, self.begins
        for value in data:
            byte, token, places = BYTES[value], None, []
            for tail, last, count in bpe:
                tail += byte
                if token is None and tail in made and (last is None or self.neighbours(last, tail)):
                    token, now = tail, count + 1
                if tail in begins:
                    places.append((tail, last, count))
            if now:
                places = [(tail, last, count - now) for tail, last, count in places]
                change += now
            bpe = (*places, (b"", token, 0))
        return bpe, change

    # Splitting, by characters.

    def kind(self, char: str) -> str:
        if (found := self.kinds.get(char)) is None:
            joined = lambda other: len(self.pieces(other + char)) == 1
            found = LETTER if joined("x") else NUMBER if joined("1") else OTHER if joined("!") else SPACE
            self.kinds[char] = found
        return found

    def begin(self, char: str) -> tuple[Key, int]:
        """A piece that begins with `char`."""
        bpe, count = self.read_bytes(NOTHING, char.encode("utf-8", "replace"))
        if (kind := self.kind(char)) == SPACE:
            # White space: the run, its tokens beyond those without the last character, that one.
            return ("space", bpe, None, char, count), count
        return (("quote", bpe) if char == "'" else ("run", kind, bpe)), count

    def step(self, key: Key, char: str) -> tuple[Key, int]:
        mode, data = key[0], char.encode("utf-8", "replace")
        if mode == "run" and self.kind(char) == key[1]:
            bpe, change = self.read_bytes(key[2], data)
            return ("run", key[1], bpe), change
        if mode == "space":
            _, bpe, beyond, last, alone = key
            if self.kind(char) == SPACE:
                own = self.begin(char)[1]
                bpe, change = self.read_bytes(bpe, data)
                return ("space", bpe, change, char, own), change
            # The last character leaves the run and, if a plain space, goes with this one.
            back = 0 if beyond is None else alone - beyond
            if last != " ":
                found, change = self.begin(char)
                return found, back + change
            bpe, change = self.read_bytes(self.read_bytes(NOTHING, b" ")[0], data)
            return ("run", self.kind(char), bpe), back + change
        if mode == "quote":
            if char in SHORT or char in LONG:
                together = self.length(f"'{char}".encode())
                return (START, together - 1) if char in SHORT else (("quoted", char, self.begin(char)[0][2]), 1)
            return self.step(("run", OTHER, key[1]), char)
        if mode == "quoted":
            if char == LONG[key[1]]:
                return START, self.length(f"'{key[1]}{char}".encode()) - 2
            return self.step(("run", LETTER, key[2]), char)
        return self.begin(char)

    def compile(self, key: Key, char: str) -> tuple[State, int]:
        after, change = self.step(key, char)
        self.size += 1
        return self.state(after), change

    # Reading.

    def segments(self, text: str) -> list[str]:
        """The parts of a text between added tokens, which count one each."""
        parts = [text]
        for literal in self.added:
            parts = [p for part in parts for p in part.split(literal)]
        return parts

    def run(self, key: Key, text: str) -> tuple[Key, int]:
        """State and change of the count after a text without added tokens."""
        state, count = self.state(key), 0
        for char in text:
            state, change = state[char]
            count += change
        return state.key, count

    def fresh(self, text: str) -> tuple[Key, int]:
        """State and count after a text without added tokens that begins anew."""
        *stretches, last = self.stretch(text) or [""]
        key, count = self.run(START, last)
        return key, count + sum(map(self.counts.__getitem__, stretches))

    def read(self, text: str) -> tuple[Key, int]:
        """State and count after any text that begins anew."""
        parts = self.segments(text)
        count = len(parts) - 1
        for part in parts:
            key, change = self.fresh(part)
            count += change
        return key, count

    def count(self, text: str) -> int:
        parts = self.segments(text)
        return len(parts) - 1 + sum(sum(map(self.counts.__getitem__, self.stretch(p))) for p in parts)

    def read_on(self, key: Key, text: str) -> tuple[Key, int]:
        """State and change of the count after any text."""
        head, *others = self.segments(text)
        if (at := self.fixed(head)) is None:
            key, count = self.run(key, head)
            if not others:
                return key, count
            at = len(head)
        else:
            count = self.run(key, head[:at])[1]
        key, change = self.read(text[at:])
        return key, count + change

    def fixed(self, text: str) -> int | None:
        """The first place where a piece begins whatever lies before the text."""
        before = None
        for at, char in enumerate(text):
            kind = self.kind(char)
            if before not in (None, SPACE) and kind != before and text[at - 1] != "'":
                return at
            before = kind
        return None

    def state_map(self, chunk: str, context: str, first: bool) -> Map:
        if first:
            after, count = self.read(chunk)
            return [], count, after
        head, *others = self.segments(chunk)
        if (at := self.fixed(head)) is not None:
            after, count = self.read(chunk[at:])
            return [head[:at]], count, after
        if others:
            # The head ends at the added token, which the rest counts.
            after, count = self.read(chunk[len(head) :])
            return [head], count, after
        context = self.segments(context)[-1]
        states = {self.run(START, context[at:])[0] for at in range(len(context) + 1)}
        return [{s: self.run(s, chunk)[::-1] for s in states}], 0, None

    def through(self, key: Key, head: Head) -> tuple[Key, int] | None:
        """State and count after a head, None where a table lacks the state."""
        count = 0
        for part in head:
            if isinstance(part, str):
                key, change = self.run(key, part)
            elif key in part:
                change, key = part[key]
            else:
                return None
            count += change
        return key, count

    def composed(self, left: Map | None, right: Map | None) -> Map | None:
        """One map for both; None where the count cannot be told from the maps."""
        if left is None or right is None:
            return None
        if left[2] is not None:
            if (found := self.through(left[2], right[0])) is None:
                return None
            count = left[1] + found[1] + right[1]
            return left[0], count, found[0] if right[2] is None else right[2]
        table, rest = left[0][0], right[0]
        if rest and isinstance(rest[0], dict):
            both = {s: (n + rest[0][t][0], rest[0][t][1]) for s, (n, t) in table.items() if t in rest[0]}
            return [both, *rest[1:]], right[1], right[2]
        return [table, *rest], right[1], right[2]


@cache
def machine(path: str) -> Machine:
    return Machine(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _decoded(column: pa.Array) -> Iterator[str]:
    for value in column:
        yield (value.as_py() or b"").decode("utf-8", "replace")


def _short(documents: DataFrame, path: str) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = machine(path)
        for batch in batches:
            counts = []
            gc.disable()  # states are many and point at each other, but none is garbage here
            for text in _decoded(batch["text"]):
                counts.append(compiled.count(text))
                compiled.tidy()
            gc.enable()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(counts, pa.int64())], names=names)

    names = ["doc_id", "n_bytes", "n_tokens"]
    return documents.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")


def cuts(text: str, added: list[str], size: int) -> Iterator[tuple[int, int]]:
    """Chunks of about `size` characters, never within an added token."""
    start = 0
    while start < len(text):
        end = start + size
        for literal in added:
            at = text.find(literal, max(start, end - len(literal) + 1), end + len(literal) - 1)
            end = at + len(literal) if 0 <= at < end else end
        yield start, min(end, len(text))
        start = end


def _chunks(documents: DataFrame, path: str, size: int) -> DataFrame:
    """Chunks of long texts with what lies before them, as a table of many files."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added = machine(path).added
        for batch in batches:
            for i, text in enumerate(_decoded(batch["text"])):
                for part, (start, end) in enumerate(cuts(text, added, size)):
                    row = batch.slice(i, 1)
                    yield pa.RecordBatch.from_arrays(
                        [row["row"], row["doc_id"], row["n_bytes"], pa.array([part], pa.int32()),
                         pa.array([text[max(0, start - CONTEXT) : start]]), pa.array([text[start:end]])],
                        names=["row", "doc_id", "n_bytes", "part", "context", "chunk"],
                    )

    spark, folder = documents.sparkSession, scratch_path(documents.sparkSession, "chunks")
    found = documents.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        chunks, "row long, doc_id long, n_bytes long, part int, context string, chunk string"
    )
    found.write.option("maxRecordsPerFile", FILE_CHUNKS).parquet(folder)
    return spark.read.schema(found.schema).parquet(folder)


def _mapped(chunks: DataFrame, path: str) -> DataFrame:
    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = machine(path)
        for batch in batches:
            found = []
            for part, context, chunk in zip(*(batch[c].to_pylist() for c in ("part", "context", "chunk"))):
                found.append(pickle.dumps(compiled.state_map(chunk, context, part == 0)))
                compiled.tidy()
            kept = [batch[c] for c in names[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.binary())], names=names)

    names = ["row", "doc_id", "n_bytes", "part", "map"]
    return chunks.mapInArrow(maps, "row long, doc_id long, n_bytes long, part int, map binary")


def _composed(maps: DataFrame, path: str, block: int) -> DataFrame:
    """One map per block of consecutive maps of a text."""

    def compose(table: pa.Table) -> pa.Table:
        compiled = machine(path)
        table = table.sort_by("part")
        whole, *others = map(pickle.loads, table["map"].to_pylist())
        for other in others:
            whole = compiled.composed(whole, other)
            compiled.tidy()
        first = table.slice(0, 1)
        part = pa.array([first["part"][0].as_py() // block], pa.int32())
        columns = [first["row"], first["doc_id"], first["n_bytes"], part, pa.array([pickle.dumps(whole)], pa.binary())]
        return pa.table(columns, names=names)

    names = maps.columns
    at = F.floor(F.col("part") / block).alias("block")
    return maps.groupBy("row", at).applyInArrow(compose, maps.schema)


def _streamed(chunks: DataFrame, path: str) -> DataFrame:
    """Counts by reading a text's chunks one after the other."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = machine(path)
        own: list | None = None

        def done() -> Iterator[pa.RecordBatch]:
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*own[1:3], own[4])], names=names)

        for batch in batches:
            for row, doc_id, n_bytes, chunk in zip(*(batch[c].to_pylist() for c in ("row", "doc_id", "n_bytes", "chunk"))):
                if own is None or own[0] != row:
                    yield from done()
                    own = [row, doc_id, n_bytes, START, 0]
                own[3], change = compiled.read_on(own[3], chunk)
                own[4] += change
                compiled.tidy()
        yield from done()

    names = ["doc_id", "n_bytes", "n_tokens"]
    ordered = chunks.repartition("row").sortWithinPartitions("row", "part")
    return ordered.mapInArrow(stream, "doc_id long, n_bytes long, n_tokens long")


def _long(documents: DataFrame, path: str, size: int, block: int) -> DataFrame:
    chunks = _chunks(documents, path, size)
    parts = (chunks.agg(F.max("part")).first()[0] or 0) + 1
    maps = _mapped(chunks, path)
    while True:
        maps, parts = _composed(maps, path, block), -(-parts // block)
        if parts == 1:
            break

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pickle.loads(m) for m in batch["map"].to_pylist()]
            counts = pa.array([None if m is None else m[1] for m in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], batch["n_bytes"], counts], names=["row", "doc_id", "n_bytes", "n_tokens"])

    told = written(maps.mapInArrow(total, "row long, doc_id long, n_bytes long, n_tokens long"))
    untold = told.where("n_tokens IS NULL").select("row")
    known = told.where("n_tokens IS NOT NULL").drop("row")
    if untold.isEmpty():
        return known
    return known.unionByName(_streamed(chunks.join(untold, "row", "left_semi"), path))


def count_tokens(documents: DataFrame, path: str | None = None, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every document."""
    ship(documents.sparkSession)
    path = vocabulary_path() if path is None else path
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")
    )
    # A text has at most as many characters as bytes.
    short = _short(rows.where(F.col("n_bytes") <= chunk), path)
    long = rows.where(F.col("n_bytes") > chunk)
    return short if long.isEmpty() else short.unionByName(_long(long, path, chunk, block))


def tokens_query(spark: SparkSession, folder: str) -> DataFrame:
    """All of `documents`."""
    counted = count_tokens(spark.read.parquet(f"{folder}/documents.parquet"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
