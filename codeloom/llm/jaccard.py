"""Similarity join of documents by the Jaccard similarity of their word n-grams, through a
token-group matrix.

Documents with one set of shingles are one class. Classes that are alike (similar size, and
of their least hashes by several orders the one that most classes share) form groups of
bounded size, and each group keeps the union of its tokens. The matrix has a row per token and
group. A class can only have a partner in groups whose union holds enough of its tokens: the
rows of its few rarest tokens name the groups to consider, and the overlap with the whole
union, as bits of a few per token, decides which are opened. Sets of tokens are sent to opened
groups only, where members are compared by exact counts of common tokens.

Nothing is capped: groups and their queries are split into blocks when they are large, all
blocks are compared, and copies stay folded. Tokens in a large share of documents go last in
the common order of tokens, which changes cost but no result.

Defined results: null texts and texts without words have no shingles and no links; rows with
equal sets are linked to each other, also if they repeat an id; a component is named by its
smallest id that is not null (null, if all are); an empty table gives none. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codeloom.llm.common import passing, ship, written
from codeloom.llm.graphs import components

#: Tokens counted together when frequent ones are looked for, the share of a count's documents
#: that makes a token frequent, and how many are remembered (they only set an order).
CHUNK = 1 << 21
FREQUENT_SHARE, FREQUENT_LEAST = 0.0005, 3
FREQUENT_KEPT = 1 << 16
#: Classes of a group, and queries compared with a group in one task, at most about.
GROUP, QUERIES = 2048, 2048
#: Odd multipliers, each of which orders the tokens in another way for a least hash.
ORDERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)

#: Bits of a union for each token of a set, at least, and in all, at least: powers of two.
BITS, LEAST_BITS = 2, 64

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
FINISH = np.uint64(0xD6E8FEB86659FD93)
#: Words whose hashes a worker remembers, which lives on through the stages that follow.
WORDS_KEPT = 1 << 16
_WORDS: dict[bytes, int] = {}


def _words(text: bytes) -> np.ndarray:
    """Hashes of the words between ASCII white space, A-Z lower-cased."""
    if len(_WORDS) > WORDS_KEPT:
        _WORDS.clear()
    out = []
    for word in text.lower().split():
        if (h := _WORDS.get(word)) is None:
            h = xxhash.xxh3_64_intdigest(word)
            if len(word) <= 64:
                _WORDS[word] = h
        out.append(h)
    return np.array(out, dtype=np.uint64)


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; of all words, if they are fewer."""
    words = _words(text or b"")
    if len(words) == 0:
        return words.view(np.int64)
    width = min(size, len(words))
    rolled = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        rolled = rolled * MULTIPLIER + words[i : len(words) - width + 1 + i]
    rolled = (rolled ^ (rolled >> np.uint64(32))) * FINISH
    return np.unique((rolled ^ (rolled >> np.uint64(29))).view(np.int64))


def needed(n: int, percent: int) -> int:
    """Common tokens that a set of n has with any partner, at least."""
    return -(-percent * n // 100)


def bits_of(tokens: np.ndarray) -> np.ndarray:
    """A set as bits: each token sets one, at its hash modulo a power of two that grows with
    the set. Bits of a larger set fold into those of a smaller one."""
    size = max(LEAST_BITS, 1 << (BITS * max(len(tokens), 1) - 1).bit_length())
    bits = np.zeros(size, dtype=np.uint8)
    bits[tokens.view(np.uint64) & np.uint64(size - 1)] = 1
    return np.packbits(bits, bitorder="little")


def frequent_tokens(documents: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of large shares of documents, sorted, and their counts: at most FREQUENT_KEPT."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= max(FREQUENT_LEAST, FREQUENT_SHARE * len(held))
            return pa.RecordBatch.from_arrays([pa.array(tokens[often]), pa.array(n[often], pa.int64())], names=["token", "n"])

        for batch in batches:
            for text in batch["text"].to_pylist():
                held.append(shingles(text, size))
                total += len(held[-1])
                if total >= CHUNK:
                    yield flush()
                    held, total = [], 0
        if held:
            yield flush()

    counted = documents.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "token long, n long")
    top = counted.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT_KEPT).toPandas()
    top = top.sort_values("token")
    return top["token"].to_numpy(np.int64), top["n"].to_numpy(np.int64)


def signatures(
    documents: DataFrame, size: int, percent: int, tokens: np.ndarray, counts: np.ndarray
) -> DataFrame:
    """Per row: id, text hash, set size, set digest, least hashes, the set as bits, and the
    rarest tokens of which every partner must have at least one. Whole sets stay behind."""
    shared = documents.sparkSession.sparkContext.broadcast((tokens, counts))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, often = shared.value
        for batch in batches:
            n, one, two, least, bits, rare = [], [], [], [], [], []
            for text in batch["text"].to_pylist():
                own = shingles(text, size)
                digest = np.frombuffer(blake2b(own.tobytes(), digest_size=16).digest(), dtype=np.int64)
                n.append(len(own))
                one.append(int(digest[0]))
                two.append(int(digest[1]))
                least.append([int((own.view(np.uint64) * o).view(np.int64).min()) for o in ORDERS] if len(own) else [])
                bits.append(bits_of(own).tobytes())
                if len(own) and len(frequent):
                    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                    rank = np.where(frequent[at] == own, often[at], 0)
                    own = own[np.lexsort((own, rank))]
                rare.append(own[: len(own) - needed(len(own), percent) + 1] if len(own) else own)
            columns = [batch["doc_id"], batch["text_hash"], pa.array(n, pa.int64()), pa.array(one, pa.int64())]
            columns += [pa.array(two, pa.int64()), pa.array(least, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
            columns.append(pa.array(rare, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n", "one", "two", "least", "bits", "rare"])

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        F.col("text").cast("binary").alias("text"),
    )
    schema = "doc_id long, text_hash long, n long, one long, two long, least array<long>, bits binary, rare array<long>"
    return rows.mapInArrow(sign, schema)


def row_key(doc_id: Column, text_hash: Column) -> list[Column]:
    """(no_id, id, hash), equal for rows of one id and text; none is null."""
    return [doc_id.isNull().alias("no_id"), F.coalesce(doc_id, F.lit(0)).alias("id"), text_hash.alias("hash")]


def mixed(doc_id: str, text_hash: str) -> Column:
    """A hash of id and text, never null."""
    return F.xxhash64(doc_id, text_hash)


def classes_of(signed: DataFrame, percent: int) -> DataFrame:
    """One row per distinct set: class_id, n, copies, smallest id, one row to read the text
    from, bits, rare tokens and group. A class joins the largest set of classes that share one of its
    least hashes, so near copies seldom scatter. Groups above GROUP classes are split."""
    found = written(
        signed.where(F.col("n") > 0)
        .groupBy("one", "two", "n")
        .agg(
            F.min("doc_id").alias("smallest"), F.count("*").alias("copies"),
            F.min(F.struct("doc_id", "text_hash")).alias("source"), F.first("least").alias("least"),
        )
        .withColumn("class_id", F.monotonically_increasing_id())
        .withColumn("band", F.floor(F.log("n") / F.log(F.lit(100 / percent))))
        .withColumn("alike", F.transform("least", lambda x: F.xxhash64(x, F.col("band"))))
        .drop("least", "band")
    )
    keys = found.select("class_id", F.explode("alike").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    best = written(
        keys.join(shared, "key").groupBy("class_id").agg(F.max(F.struct("size", "key"))["key"].alias("key"))
    )
    large = best.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > GROUP)
    parts = best.join(large, "key", "left").select(
        "class_id", "key", F.coalesce(F.ceil(F.col("size") / GROUP), F.lit(1)).alias("parts")
    )
    grouped = found.join(parts, "class_id", "left").withColumn("key", F.coalesce("key", F.col("alike")[0]))
    part = F.pmod(F.xxhash64("class_id"), F.coalesce("parts", F.lit(1)))
    grouped = grouped.withColumn("group", F.xxhash64("key", part)).drop("alike", "key", "parts")
    # Bits and rare tokens are most of a row; they are dealt once, to the class of their row.
    at = ["one", "two", "n", "no_id", "id", "hash"]
    wide = signed.where(F.col("n") > 0).select("one", "two", "n", *row_key(F.col("doc_id"), F.col("text_hash")), "bits", "rare")
    grouped = grouped.select("*", *row_key(F.col("source.doc_id"), F.col("source.text_hash")))
    return written(wide.join(grouped, at).dropDuplicates(at).drop("no_id", "id", "hash"))


def _meeting(shared: DataFrame, percent: int) -> DataFrame:
    """Per class, group and token of both: the sizes of the group's classes with the token.
    Another class than the asking one must have it, of a size that fits."""
    matrix = shared.groupBy("token", "group").agg(
        F.min("n").alias("from"), F.max("n").alias("to"), F.min("class_id").alias("lo"), F.max("class_id").alias("hi")
    )
    fits = (F.col("n") * 100 >= F.col("from") * percent) & (F.col("to") * 100 >= F.col("n") * percent)
    # A foreign group holds others. As the own group is read, too, both sides of the join have
    # the same columns and one exchange serves both.
    other = (F.col("own") != F.col("group")) | (F.col("lo") != F.col("class_id")) | (F.col("hi") != F.col("class_id"))
    pairs = shared.withColumnRenamed("group", "own").join(matrix, "token").where(fits & other)
    return pairs.select("class_id", "group", "n", "from", "to")


def candidates(classes: DataFrame, frequent: np.ndarray, percent: int) -> DataFrame:
    """(class_id, group) to consider: the group's union has enough of the class's rare
    tokens, and its sizes fit."""
    rows = classes.select(F.explode("rare").alias("token"), "class_id", "group", "n")
    is_frequent = F.lit(False)
    if len(frequent):
        # A broadcast of at most FREQUENT_KEPT numbers.
        often = classes.sparkSession.createDataFrame([(int(t),) for t in frequent], "often long")
        rows = rows.join(F.broadcast(often), F.col("token") == F.col("often"), "left")
        is_frequent = F.col("often").isNotNull()
    # Most rare tokens belong to one class only. They are dealt by token once, and what is
    # done with the others stays in the same partitions. Frequent tokens skip this, so that
    # no partition is hot, and are combined before they are dealt.
    own = W.partitionBy("token")
    usual = (
        rows.where(~is_frequent).select("token", "class_id", "group", "n")
        .withColumn("lo", F.min("class_id").over(own)).withColumn("hi", F.max("class_id").over(own))
        .where(F.col("lo") < F.col("hi")).drop("lo", "hi")
    )
    often_met = rows.where(is_frequent).select("token", "class_id", "group", "n")
    pairs = _meeting(usual, percent).unionByName(_meeting(written(often_met), percent))
    # Of two partners, the one whose rare tokens end first has all its common rare tokens among
    # the other's; beyond them it has room for `needed - 1` more. So the number of rare tokens
    # that meet bounds the overlap with any member, and it must reach what partners share.
    n, found = F.col("n"), F.col("found")
    least = lambda size: (n + size) * percent / (100 + percent)
    by_query = found + F.ceil(n * percent / 100) - 1 >= least(F.col("from"))
    by_member = found + F.ceil(F.col("to") * percent / 100) >= least(F.col("to"))
    return written(
        pairs.groupBy("class_id", "group", "n")
        .agg(F.count("*").alias("found"), F.min("from").alias("from"), F.max("to").alias("to"))
        .where(by_query | by_member)
        .select("class_id", "group")
    )


def roles_of(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(class_id, group, part, member, asks, copies): what each class does where. It is a member
    of its own group, in every part, if a class asks there, and asks in one part of each group
    that it is paired with."""
    asked = written(
        pairs.groupBy("group").agg(F.count("*").alias("asking")).select(
            "group", F.ceil(F.col("asking") / QUERIES).cast("int").alias("parts")
        )
    )
    members = classes.select("class_id", "group", "copies").join(asked, "group").select(
        "class_id", "group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.lit(True).alias("member"), F.lit(False).alias("asks"), "copies",
    )
    asking = pairs.join(asked, "group").select(
        "class_id", "group", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int").alias("part"),
        F.lit(False).alias("member"), F.lit(True).alias("asks"), F.lit(0).cast("long").alias("copies"),
    )
    return members.unionByName(asking).groupBy("class_id", "group", "part").agg(
        F.max("member").alias("member"), F.max("asks").alias("asks"), F.max("copies").alias("copies")
    )


def bounded(rows: pa.Table, percent: int) -> pa.Table:
    """The queries whose overlap with the union of a group's other members may be enough. A bit
    of a query that no other member sets stands for one token at least that none has."""
    bits = [np.frombuffer(b, dtype=np.uint8) for b in rows["bits"].to_pylist()]
    width = min(len(b) for b in bits)
    bits = [b if len(b) == width else np.bitwise_or.reduce(b.reshape(-1, width), axis=0) for b in bits]
    is_member = rows["member"].to_pylist()
    once, twice = np.zeros(width, np.uint8), np.zeros(width, np.uint8)
    for own in (b for b, member in zip(bits, is_member) if member):
        twice |= once & own
        once |= own
    keep = []
    for i, (n, asks) in enumerate(zip(rows["n"].to_pylist(), rows["asks"].to_pylist())):
        if asks:
            lacking = np.bitwise_count(bits[i] & ~(twice if is_member[i] else once)).sum(dtype=np.int64)
            if lacking <= n - needed(n, percent):
                keep.append(i)
    return rows.select(["class_id", "group"]).take(pa.array(keep, pa.int64()))


def opened(classes: DataFrame, considered: DataFrame, percent: int) -> DataFrame:
    """The pairs of `considered` that the bound by the whole union leaves."""
    rows = roles_of(classes, considered).join(classes.select("class_id", "n", "bits"), "class_id")
    return written(
        rows.select("class_id", "group", "part", "member", "asks", "n", "bits")
        .groupBy("group", "part")
        .applyInArrow(lambda group: bounded(group, percent), "class_id long, group long")
    )


def sets_of(documents: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(class_id, roles, tokens) of the wanted classes, from the text of one row of each."""
    rows = documents.select(
        *row_key(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("")))), F.col("text").cast("binary").alias("text")
    )
    wanted = wanted.select(*row_key(F.col("source.doc_id"), F.col("source.text_hash")), "class_id", "roles")
    # Few texts are wanted, and the others stay where they are.
    rows = passing(rows, mixed("id", "hash"), wanted.select(mixed("id", "hash").alias("key"))).where("passes").drop("passes")
    # Rows that repeat id and text are read once.
    rows = rows.join(wanted, ["no_id", "id", "hash"]).dropDuplicates(["no_id", "id", "hash"])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(text, size) for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["class_id"], batch["roles"], pa.array(own, pa.list_(pa.int64()))], names=["class_id", "roles", "tokens"]
            )

    roles = wanted.schema["roles"].dataType.simpleString()
    return rows.select("class_id", "roles", "text").mapInArrow(tokens, f"class_id long, roles {roles}, tokens array<long>")


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    joined = column.combine_chunks()
    if isinstance(joined, pa.ChunkedArray):
        joined = pa.concat_arrays(joined.chunks) if joined.num_chunks else pa.array([], column.type)
    lengths = np.asarray(joined.value_lengths(), dtype=np.int64)
    return np.asarray(joined.flatten(), dtype=np.int64), np.concatenate([[0], np.cumsum(lengths)])


def compare(rows: pa.Table, percent: int) -> pa.Table:
    """Links of queries with the members of one group: per class the number of rows it is
    linked to, and edges that keep connected what the links connect."""
    members, queries = rows.filter(rows["member"]), rows.filter(rows["asks"])
    ids, copies = members["class_id"].to_numpy(), members["copies"].to_numpy()
    flat, ends = _lists(members["tokens"])
    sizes = np.diff(ends)
    owner = np.repeat(np.arange(len(ids)), sizes)
    order = np.argsort(flat, kind="stable")
    union, first = np.unique(flat[order], return_index=True)
    bounds = np.append(first, len(flat))
    posting = owner[order]
    label = np.arange(len(ids))
    nodes, links, roots = [], [], []
    q_ids = queries["class_id"].to_numpy()
    q_flat, q_ends = _lists(queries["tokens"])
    for i, q in enumerate(q_ids):
        own = q_flat[q_ends[i] : q_ends[i + 1]]
        at = np.minimum(np.searchsorted(union, own), len(union) - 1)
        at = at[union[at] == own]
        if len(at) < needed(len(own), percent):
            continue  # the group's union bounds the overlap with every member
        starts, lengths = bounds[at], bounds[at + 1] - bounds[at]
        inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        common = np.bincount(posting[np.repeat(starts, lengths) + inside], minlength=len(ids))
        hit = (100 * common >= percent * (sizes + len(own) - common)) & (ids != q)
        linked = np.flatnonzero(hit)
        if not len(linked):
            continue
        among = np.unique(label[linked])
        if len(among) > 1:
            label[np.isin(label, among[1:])] = among[0]
        nodes.append(q)
        links.append(int(copies[linked].sum()))
        roots.append(linked[0])
    # Members that the links connect point to the least of them.
    moved = np.flatnonzero(label != np.arange(len(ids)))
    root = np.concatenate([ids[label[np.array(roots, dtype=np.int64)]], ids[label[moved]]])
    return pa.table(
        {
            "class_id": pa.array(np.concatenate([np.array(nodes, dtype=np.int64), ids[moved]]), pa.int64()),
            "links": pa.array(np.concatenate([np.array(links, dtype=np.int64), np.zeros(len(moved), np.int64)]), pa.int64()),
            "root": pa.array(root, pa.int64()),
        }
    )


def similar_documents(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document row: doc_id, text_hash, n_shingles, n_links (other rows linked
    directly), component_id (smallest id reached) and root, which tells components apart even
    if their ids are equal or null (null: a document without shingles, alone)."""
    ship(documents.sparkSession)
    frequent, counts = frequent_tokens(documents, size)
    signed = written(signatures(documents, size, percent, frequent, counts))
    classes = classes_of(signed, percent)
    pairs = opened(classes, candidates(classes, frequent, percent), percent)
    role = F.struct("group", "part", "member", "asks", "copies")
    roles = roles_of(classes, pairs).groupBy("class_id").agg(F.collect_list(role).alias("roles"))
    wanted = written(classes.select("class_id", "source").join(roles, "class_id"))
    sets = sets_of(documents, wanted, size).select("class_id", "tokens", F.explode("roles").alias("role"))
    found = written(
        sets.select("class_id", "tokens", "role.*")
        .groupBy("group", "part")
        .applyInArrow(lambda rows: compare(rows, percent), "class_id long, links long, root long")
    )
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    members_of = classes.select("class_id", "one", "two", "n", "smallest", "copies").join(
        roots.withColumnRenamed("node", "class_id"), "class_id", "left"
    ).withColumn("root", F.coalesce("root", "class_id"))
    named = members_of.groupBy("root").agg(F.min("smallest").alias("component_id"))
    known = written(
        members_of.join(named, "root").join(links, "class_id", "left").select(
            "one", "two", F.col("n").alias("size"), "component_id", "root",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    rows = signed.select("doc_id", "text_hash", "n", "one", "two")
    linked = rows.where(F.col("n") > 0).join(known, ["one", "two"]).select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), "n_links", "component_id", "root"
    )
    empty = rows.where(F.col("n") == 0).select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.lit(0).cast("long").alias("n_links"),
        F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"),
    )
    return linked.unionByName(empty)


def keep_one(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """`documents` with one row of each component: that of the smallest id, null last, and of
    equal ids that of the smallest text hash. Documents without shingles stay, rows that
    repeat id and text as one."""
    judged = similar_documents(documents, size, percent)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    keys = written(judged.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows"), F.min("root").alias("root")))
    first = keys.where("root IS NOT NULL").groupBy("root").agg(F.min(order).alias("first"))
    keeps = F.col("root").isNull() | (order == F.col("first"))
    # Most rows stay, and they stay where they are: only those that may go or repeat are joined.
    doubtful = written(
        keys.join(first, "root", "left").select("doc_id", "text_hash", "rows", keeps.alias("keeps")).where(~F.col("keeps") | (F.col("rows") > 1))
    )
    key = [F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash")]
    rows = documents.select(F.struct("*").alias("row"), *key)
    rows = passing(rows, mixed("_id", "_hash"), doubtful.select(mixed("doc_id", "text_hash").alias("key")))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash"))
    again = rows.where("passes").join(doubtful, same, "left").where(F.coalesce("keeps", F.lit(True)))
    return rows.where(~F.col("passes")).select("row.*").unionByName(again.dropDuplicates(["_id", "_hash"]).select("row.*"))


def jaccard_query(spark: SparkSession, folder: str) -> DataFrame:
    """All of `documents`: three-word shingles, similarity of at least 0.9."""
    rows = similar_documents(spark.read.parquet(f"{folder}/documents.parquet"), 3, 90)
    return rows.select("doc_id", "n_shingles", "component_id", "n_links")
