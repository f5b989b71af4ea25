"""Personal data by bootstrapped contextual extraction.

Four base kinds are found by pattern in every text and are the seeds. Every word with a digit
or an @ is an instance; the word before it together with its own shape (letters a, digits 9,
runs folded) is a lexical pattern, and the two words before it, whatever its shape, are another.
Spark scores the graph of patterns and instances in rounds: a pattern is as good as the share of
its distinct instances that are believed, an instance as credible as its patterns together. What
good patterns with enough seeds reach are seeds of the next rounds, until nothing new is
reached. Instances of good patterns that no base span covers become spans of kind `context`;
base spans always stay.

Defined results: a null text is an empty text; rows are judged one by one, so repeated rows
give repeated results; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import SPAN, WS, document_key, no_spans, overlaps_any, span_text, spans, text_of
from codeloom.llm.common import with_matches, written

# The base kinds, in the order in which they are listed. The lookbehinds and
# possessive runs only keep the search linear in long runs; the matches are those of the
# plain patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
NEEDLES = {"email": ("@",), "phone": ("+",)}

#: Words that may be identifiers.
WORD = rf"(?<![^{WS}])[^{WS}0-9@]*+[0-9@][^{WS}]*+"
#: Code points before a word in which its context word is looked for, and of a shape.
CONTEXT, SHAPE = 64, 32
CONTEXTUAL = "context"

#: Rounds of scoring between two choices of good patterns: each lets a pattern's own doubtful
#: instances speak for it, and without end its confidence is seeds / (seeds + SMOOTHING), however
#: many other words it has. A pattern's least share of believed instances and of distinct seeds; a
#: constant against patterns with few instances.
ROUNDS = 3
LEAST_CONFIDENCE = 0.9
LEAST_SEEDS = 5
SMOOTHING = 1.0
#: Slices of a hot pattern's words; the few good patterns are repeated for each.
SALTS = 16


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    def weight(i: Column) -> Column:
        digit = F.substring(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        double = digit * 2
        return F.when(i % 2 == 1, digit).otherwise(double - F.when(double > 9, 9).otherwise(0))

    total = F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda acc, i: acc + weight(i))
    return total % 10 == 0


def holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(digits(value)).between(14, 19), passes_luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def holding(kind: str):
    return lambda match: holds(kind, match["value"])


def context_word(gap: Column) -> Column:
    """The last word of the text before, in lower case and without marks around it; empty at
    the start of a text and after another instance."""
    tail = F.substring(gap, -CONTEXT, CONTEXT)
    word = F.regexp_extract(tail, rf"(?<![^{WS}])([^{WS}]++)[{WS}]++$", 1)
    return F.lower(F.regexp_replace(word, r"^[^\p{L}]+|[^\p{L}]+$", ""))


def context_words(gap: Column) -> Column:
    """The last two words of the text before, as `context_word` gives one; null if there are
    not two since another instance."""
    tail = F.substring(gap, -CONTEXT, CONTEXT)
    words = F.regexp_extract(tail, rf"(?<![^{WS}])([^{WS}]++[{WS}]++[^{WS}]++)[{WS}]++$", 1)
    words = F.regexp_replace(F.regexp_replace(words, r"^[^\p{L}]+|[^\p{L}]+$", ""), rf"[{WS}]+", " ")
    return F.when(words.contains(" "), F.lower(words))


def shape(value: Column) -> Column:
    bare = F.regexp_replace(F.substring(value, 1, SHAPE), r"^[.,;:!?]+|[.,;:!?]+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\p{L}+", "a"), "[0-9]+", "9")


def found(documents: DataFrame, *kept: Column) -> DataFrame:
    """Per row: counts, base spans, and the words that may be identifiers with pattern,
    instance and whether a base span covers them. One pass, no shuffle, texts stay behind."""
    rows = documents.select(*kept, text_of().alias("_text"))
    names = [c for c in rows.columns if c != "_text"]
    rows = with_matches(rows, "_text", PATTERNS | {"_words": WORD}, NEEDLES).drop("_text")
    rows = rows.select(*names, "_words", *(F.filter(k, holding(k)).alias(k) for k in KINDS))
    base = F.concat(*(spans(F.col(kind), kind, rank) for rank, kind in enumerate(KINDS)))
    rows = rows.select(*names, "_words", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), base.alias("base"))
    word = lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"),
        F.array_compact(
            F.array(F.concat_ws(" ", context_word(m["gap"]), shape(m["value"])), F.concat(context_words(m["gap"]), F.lit(" *")))
        ).alias("patterns"),
        F.xxhash64(F.lower(m["value"])).alias("instance"),
        overlaps_any(m["start"], m["end"], F.col("base")).alias("seed"),
    )
    return rows.select(*names, *(f"n_{k}" for k in KINDS), "base", F.transform("_words", word).alias("words"))


def scored(edges: DataFrame, rounds: int) -> DataFrame:
    """(pattern, seeds, confidence) after some rounds, of distinct edges."""
    belief = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("belief"))
    for last in range(1, rounds + 1):
        patterns = written(
            edges.join(belief, "instance")
            .groupBy("pattern")
            .agg(F.sum("belief").alias("believed"), F.count("*").alias("instances"), F.sum("seed").alias("seeds"))
            .where(F.col("seeds") >= 1)
            .select("pattern", "seeds", (F.col("believed") / (F.col("instances") + SMOOTHING)).alias("confidence"))
        )
        if last == rounds:
            return patterns
        # 1 - product of doubts, as a sum of logarithms; confidence stays below 1.
        doubt = F.exp(F.sum(F.log1p(-F.coalesce("confidence", F.lit(0.0)))))
        belief = written(
            edges.join(patterns.select("pattern", "confidence"), "pattern", "left")
            .groupBy("instance")
            .agg(F.greatest(F.max("seed").cast("double"), 1 - doubt).alias("belief"))
        )


def good_patterns(
    words: DataFrame, rounds: int = ROUNDS, least_confidence: float = LEAST_CONFIDENCE, least_seeds: int = LEAST_SEEDS
) -> DataFrame:
    """Patterns that the rounds leave confident, of rows (pattern, instance, seed). What they
    reach are seeds of the next rounds, until they reach nothing new; seeds only grow."""
    # Distinct edges: a pattern or an instance in a third of all rows is combined in each task.
    edges = written(words.groupBy("pattern", "instance").agg(F.max(F.col("seed").cast("int")).alias("seed")))
    while True:
        patterns = scored(edges, rounds)
        good = patterns.where((F.col("confidence") >= least_confidence) & (F.col("seeds") >= least_seeds))
        # An instance is a seed of all its patterns, or of those where a base span covers it.
        reached = edges.join(good, "pattern", "left_semi").groupBy("instance").agg(F.lit(1).alias("reached"))
        grown = written(
            edges.join(reached, "instance", "left").select(
                "pattern", "instance", F.greatest("seed", F.coalesce("reached", F.lit(0))).alias("seed")
            )
        )
        if _seeds(grown) == _seeds(edges):
            return good
        edges = grown


def _seeds(edges: DataFrame) -> int:
    return edges.agg(F.sum("seed")).first()[0] or 0


def discovered(rows: DataFrame, **limits) -> DataFrame:
    """Per `row` the spans that good patterns add, of written `rows` of `found`."""
    words = rows.where(F.size("words") > 0).select("row", F.explode("words").alias("w")).select("row", "w.*")
    words = words.withColumn("pattern", F.explode("patterns")).drop("patterns")
    good = good_patterns(words, **limits).select("pattern", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    span = F.struct("start", F.lit(len(KINDS)).alias("rank"), F.lit(CONTEXTUAL).alias("kind"), "end").cast(SPAN)
    return (
        words.where(~F.col("seed"))
        .withColumn("salt", F.pmod(F.hash("row"), F.lit(SALTS)))
        .join(good, ["pattern", "salt"], "left_semi")
        .groupBy("row")
        .agg(F.collect_set(span).alias("added"))
    )


def find_private(documents: DataFrame, **limits) -> DataFrame:
    """One row per document row: doc_id, counts and spans of the base kinds, added spans."""
    rows = written(found(documents, F.col("doc_id")).withColumn("row", F.monotonically_increasing_id()))
    return rows.join(discovered(rows, **limits), "row", "left").select(
        "doc_id", *(f"n_{k}" for k in KINDS), "base", F.coalesce("added", no_spans()).alias("added")
    )


def redact(documents: DataFrame, **limits) -> DataFrame:
    """`documents` with every span replaced by its kind in square brackets; overlapping spans
    become one, named after the first. `n_chars` follows the text. Null texts stay null."""
    keyed = documents.select(F.struct("*").alias("_row"), document_key().alias("_key"))
    rows = written(
        found(documents, document_key().alias("key")).withColumn("row", F.monotonically_increasing_id())
    )
    every = rows.join(discovered(rows, **limits), "row", "left").select(
        "key", F.array_sort(F.concat("base", F.coalesce("added", no_spans()))).alias("spans")
    )
    # Rows that repeat a document repeat its spans, too.
    every = every.where(F.size("spans") > 0).groupBy("key").agg(F.first("spans").alias("spans"))
    joined = keyed.join(every, F.col("_key") == F.col("key"), "left")
    text = F.col("_row.text")
    step = lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(
        F.struct(
            s["end"].alias("at"),
            F.when(
                s["start"] >= acc["at"],
                F.concat(
                    acc["parts"],
                    F.array(
                        F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                        F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")),
                    ),
                ),
            ).otherwise(acc["parts"]).alias("parts"),
        )
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
    clean = F.aggregate(
        "spans", start, step,
        lambda acc: F.concat(
            F.array_join(acc["parts"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))
        ),
    )
    out = joined.select("_row", F.when(F.col("spans").isNull(), text).otherwise(clean).alias("_text"))
    value = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*(value.get(c, F.col("_row")[c]).alias(c) for c in documents.columns))


def private_query(spark: SparkSession, folder: str) -> DataFrame:
    """All of `documents` with production limits."""
    result = find_private(spark.read.parquet(f"{folder}/documents.parquet"))
    return result.select(
        "doc_id", *(f"n_{k}" for k in KINDS), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.concat("base", "added")).alias("spans"),
    )
