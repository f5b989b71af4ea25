"""Secret scans by corpus-wide ownership.

Every text is searched for three base kinds of secret and for further credential-like words.
The values of all of them are hashed, and each hash is counted over the whole corpus by
distinct owners and repositories. A value that many owners hold is a copied example; a value
that one or two owners hold and that looks random is a live-looking credential. Words of the
second sort become spans of their own (kind `owned`), base spans always stay.

Defined results: a null text is an empty text; a null owner or repository is one unknown
owner or repository; rows are judged one by one, so repeated rows give repeated results and
an empty table gives none. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import SPAN, no_spans, overlaps_any, span_text, spans, text_of, with_matches, written

# The base kinds, in the order in which they are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs that would be dropped for their length start no match here; the matches are the same.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

# Credential-like words: maximal runs of 16 or more of these characters with a digit.
WORD = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{16,}"
NEEDLES = {"assign": ("=", ":"), "access": ("AKIA",)}
OWNED = "owned"

#: Owners that may share a value before it counts as a copied example.
MAX_OWNERS = 2
#: A live-looking value has letters, digits and at least this many different characters.
LEAST_VARIETY = 8
#: Slices of a hash's occurrences; the few ownership rows are repeated for each.
SALTS = 16


def looks_live(value: Column) -> Column:
    variety = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[A-Za-z]") & value.rlike("[0-9]") & (variety >= LEAST_VARIETY)


def found(documents: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """Per row: base spans and hashed candidates. One pass, no shuffle, texts stay behind."""
    rows = documents.select(
        F.col("doc_id"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
        text_of().alias("text"),
    )
    rows = with_matches(rows, "text", {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "words": WORD}, NEEDLES).drop("text")
    rows = rows.withColumn(
        "assign", F.filter("assign", lambda m: F.length(F.regexp_extract(m["value"], f"^{ASSIGN}", 2)) >= 6)
    ).withColumn("words", F.filter("words", lambda m: looks_live(m["value"])))
    base = F.concat(*(spans(F.col(kind), kind, rank) for rank, kind in enumerate(KINDS)))
    candidate = lambda m, value, rank: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), F.lit(rank).alias("rank"),
        F.sha2(value, 256).alias("hash"), looks_live(value).alias("live"),
    )
    secret = lambda m: F.regexp_extract(m["value"], f"^{ASSIGN}", 2)
    return rows.withColumn("base", base).select(
        "doc_id", "owner", "repository", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), "base",
        F.concat(
            F.transform("assign", lambda m: candidate(m, secret(m), 0)),
            F.transform("access", lambda m: candidate(m, m["value"], 1)),
            F.transform("hex", lambda m: candidate(m, m["value"], 2)),
            F.transform(
                F.filter("words", lambda m: ~overlaps_any(m["start"], m["end"], F.col("base"))),
                lambda m: candidate(m, m["value"], 3),
            ),
        ).alias("candidates"),
    )


def ownership(occurrences: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """Per hash the distinct owners and repositories that hold it. Each step is combined
    before its shuffle, so a value in a third of all rows is a few rows of each task."""
    return (
        occurrences.groupBy("hash", "owner", "repository").agg(F.count("*").alias("rows"))
        .groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("rows").alias("rows"))
        .groupBy("hash").agg(
            F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("rows").alias("rows")
        )
        .withColumn("copied", F.col("owners") > max_owners)
    )


def scan_secrets(
    documents: DataFrame, owner: Column | None = None, repository: Column | None = None,
    max_owners: int = MAX_OWNERS,
) -> DataFrame:
    """One row per document row: counts and spans of the base kinds, the added `owned` spans
    and how many candidates are copied or live-looking."""
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    # Row numbers are fixed once the table is written; they are only a join key.
    rows = written(found(documents, owner, repository).withColumn("row", F.monotonically_increasing_id()))
    occurrences = rows.where(F.size("candidates") > 0).select(
        "row", "owner", "repository", F.explode("candidates").alias("c")
    ).select("row", "owner", "repository", "c.*")
    held = ownership(occurrences, max_owners).select("hash", "copied")
    salted = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    judged = (
        occurrences.withColumn("salt", F.pmod(F.hash("row"), F.lit(SALTS)))
        .join(salted, ["hash", "salt"])
        .withColumn("owned", ~F.col("copied") & F.col("live"))
        .groupBy("row")
        .agg(
            F.collect_list(
                F.when(
                    F.col("owned") & (F.col("rank") == 3),
                    F.struct("start", "rank", F.lit(OWNED).alias("kind"), "end").cast(SPAN),
                )
            ).alias("added"),
            F.sum(F.col("copied").cast("long")).alias("n_copied"),
            F.sum(F.col("owned").cast("long")).alias("n_owned"),
        )
    )
    return rows.join(judged, "row", "left").select(
        "doc_id", *(f"n_{k}" for k in KINDS), "base", F.coalesce("added", no_spans()).alias("added"),
        F.coalesce("n_copied", F.lit(0).cast("long")).alias("n_copied"),
        F.coalesce("n_owned", F.lit(0).cast("long")).alias("n_owned"),
    )


def secrets_query(spark: SparkSession, folder: str) -> DataFrame:
    """All of `documents`: owner is the source, repository the source's part in one language."""
    result = scan_secrets(spark.read.parquet(f"{folder}/documents.parquet"))
    return result.select(
        "doc_id", *(f"n_{k}" for k in KINDS), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.concat("base", "added")).alias("spans"), "n_copied", "n_owned",
    )
