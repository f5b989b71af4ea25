"""URL filters by path-template trees.

Urls are split into host and path segments. Segments that hold digits are folded to their
shape; then the tree of each host is walked level by level: where a node has many children,
the rare ones become a wildcard unless their labels differ from it, and of the others those that
lead on alike and carry labels at statistically equal rates on all hosts are merged into the
largest of them, by count and then by name. Each template's blocked share among labelled urls is
smoothed towards its share in the domain and on all hosts; templates above a limit are rejected.

Rules decide before templates, and in the query they are also the labels from which the
templates learn. Defined results: a null url, or one without `://`, has an empty host and
path, fits no rule and is allowed; repeated rows give repeated results; an empty table gives
none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import written

URL = r"^[\s\S]*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict); a rule fits its host and all subdomains.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

#: Levels at which branches are generalised; segments further down keep their shape.
LEVELS = 8
#: A node with more children than this has a wildcard for those below the least share.
MANY, LEAST_SHARE = 16, 0.02
#: Standard errors within which the label rates of two branches count as equal.
Z = 2.0
#: Prior urls added to each template, and the blocked share to reject.
PRIOR, LEAST_PURITY = 4.0, 0.9
#: What an url without a label adds to the prior urls.
UNLABELLED = 0.1


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct of its text and verdict."""
    kind = "struct<rule:string,verdict:string>"
    fitting = F.lit(None).cast(kind)
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        fitting = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fitting)
    return fitting


def shapes(path: Column) -> Column:
    """Path segments, with identifiers folded: long hexadecimal words and runs of digits."""
    segment = lambda s: F.when(s.rlike("^(?=.*[0-9])[0-9a-fA-F-]{16,}$"), F.lit("<hex>")).otherwise(
        F.regexp_replace(s, "[0-9]+", "<num>")
    )
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), segment)


def _alike(part: str, whole: str, other_part: str, other_whole: str) -> Column:
    """Whether two shares are equal within Z standard errors."""
    k1, n1, k0, n0 = F.col(part), F.col(whole), F.col(other_part), F.col(other_whole)
    pooled = (k1 + k0) / (n1 + n0)
    error = F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))
    return F.abs(k1 / n1 - k0 / n0) <= Z * error


def generalise(tree: DataFrame, level: int) -> DataFrame:
    """One level: (host, so_far, segment) -> token."""
    leads = F.coalesce(F.get("shape", F.lit(level)), F.lit(""))
    counts = [F.sum(c).alias(c) for c in ("n", "blocked", "allowed")]
    child = (
        tree.where(F.size("shape") >= level)
        .groupBy("host", "so_far", F.get("shape", F.lit(level - 1)).alias("segment"), leads.alias("next"))
        .agg(*counts)
        .groupBy("host", "so_far", "segment")
        .agg(*counts, F.max_by("next", F.struct("n", "next")).alias("next"))
    )
    # What a segment leads to on all hosts tells more than on one, where labels may be few.
    pool = child.groupBy("so_far", "segment").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "blocked", "allowed")])
    node = child.groupBy("host", "so_far").agg(F.count("*").alias("children"), F.sum("n").alias("total"))
    child = (
        child.join(node, ["host", "so_far"]).join(pool, ["so_far", "segment"])
        .withColumn("rare", (F.col("children") > MANY) & (F.col("n") < LEAST_SHARE * F.col("total")))
    )
    # Children that stay are few: at most 1 / LEAST_SHARE of them, or MANY.
    largest = (
        child.where(~F.col("rare"))
        .groupBy("host", "so_far", "next")
        .agg(F.max(F.struct("n", "segment", "all_n", "all_blocked", "all_allowed")).alias("of"))
    )
    merged = F.when(
        _alike("all_blocked", "all_n", "of.all_blocked", "of.all_n") & _alike("all_allowed", "all_n", "of.all_allowed", "of.all_n"),
        F.col("of.segment"),
    )
    labels = F.col("blocked") + F.col("allowed")
    wild = child.where("rare").groupBy("host", "so_far").agg(F.sum("blocked").alias("wild_blocked"), F.sum(labels).alias("wild_labels"))
    child = child.withColumn("labels", labels).join(wild, ["host", "so_far"], "left")
    # A rare child without labels is part of the wildcard, one with labels if their rate is.
    folded = F.col("rare") & ((F.col("labels") == 0) | _alike("blocked", "labels", "wild_blocked", "wild_labels"))
    return (
        child.join(largest, ["host", "so_far", "next"], "left")
        .select(
            "host", "so_far", "segment",
            F.when(folded, F.lit("*")).when(F.col("rare"), F.col("segment"))
            .otherwise(F.coalesce(merged, F.col("segment"))).alias("token"),
        )
    )


def templates(urls: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Per (host, shape) its template, of rows (host, shape, label): label is block, allow or
    null. Urls of one shape are counted in each task first, so a hot host is few rows."""
    tree = written(
        urls.groupBy("host", "shape").agg(
            F.count("*").alias("n"),
            F.count(F.when(F.col("label") == "block", 1)).alias("blocked"),
            F.count(F.when(F.col("label") == "allow", 1)).alias("allowed"),
        ).withColumn("so_far", F.lit(""))
    )
    deepest = tree.agg(F.max(F.size("shape"))).first()[0] or 0
    for level in range(1, min(levels, deepest) + 1):
        tokens = generalise(tree, level)
        tree = written(
            tree.withColumn("segment", F.get("shape", F.lit(level - 1)))
            .join(tokens, ["host", "so_far", "segment"], "left")
            .withColumn("so_far", F.when(F.col("token").isNull(), F.col("so_far")).otherwise(F.concat_ws("/", "so_far", "token")))
            .drop("segment", "token")
        )
    rest = F.when(F.size("shape") > levels, F.slice("shape", levels + 1, F.greatest(F.size("shape") - levels, F.lit(1))))
    return tree.select(
        "host", "shape", "n", "blocked", "allowed",
        F.when(rest.isNull(), F.col("so_far")).otherwise(F.concat_ws("/", F.array(F.col("so_far")), rest)).alias("template"),
    )


def domain_of(host: Column) -> Column:
    """The last two names of a host."""
    return F.substring_index(host, ".", -2)


def judged_templates(
    of_shapes: DataFrame, prior: float = PRIOR, least_purity: float = LEAST_PURITY, unlabelled: float = UNLABELLED
) -> DataFrame:
    """Per (host, template) the counts, the smoothed purity and whether it is rejected.

    The blocked share of a template is smoothed towards that of the same template on the other
    hosts of the domain, which is smoothed towards that on all other domains, and this towards
    one half. Where many urls have no label, the labelled ones say less: each counts as
    `unlabelled` more urls of the share that is smoothed to."""
    names = ("n", "blocked", "allowed")
    sums = lambda to: [F.sum(c).alias(f"{to}{c}") for c in names]

    def purity(inner: str, outer: str, parent: Column) -> Column:
        """Of the counts `outer` without the counts `inner` that are part of them."""
        n, blocked, allowed = (F.col(f"{outer}{c}") - (F.col(f"{inner}{c}") if inner != outer else 0) for c in names)
        weight = prior + unlabelled * (n - blocked - allowed)
        return (blocked + weight * parent) / (blocked + allowed + weight)

    own = of_shapes.groupBy("host", "template").agg(*sums("")).withColumn("domain", domain_of(F.col("host")))
    domains = own.groupBy("domain", "template").agg(*sums("domain_"))
    anywhere = domains.groupBy("template").agg(*[F.sum(f"domain_{c}").alias(f"any_{c}") for c in names])
    domains = domains.join(anywhere, "template").withColumn("elsewhere", purity("domain_", "any_", F.lit(0.5)))
    judged = own.join(domains, ["domain", "template"]).withColumn("beside", purity("", "domain_", F.col("elsewhere")))
    return (
        judged.withColumn("purity", purity("", "", F.col("beside")))
        .withColumn("rejected", F.col("purity") >= least_purity)
        .select("host", "template", *names, "purity", "rejected")
    )


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, label: Column | None = None,
    levels: int = LEVELS, prior: float = PRIOR, least_purity: float = LEAST_PURITY,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. `label` (block, allow or null)
    trains the templates; by default it is the verdict of the rule that fits."""
    urls = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        (F.lit(None).cast("string") if label is None else label).alias("label"),
    )
    urls = urls.withColumn("fitting", rule_of(F.col("host"), F.col("path"), rules))
    urls = urls.withColumn("label", F.coalesce("label", "fitting.verdict")).withColumn("shape", shapes(F.col("path")))
    of_shapes = written(templates(urls.where(F.col("host") != ""), levels))
    rejected = (
        of_shapes.join(
            judged_templates(of_shapes, prior, least_purity).where("rejected").select("host", "template"),
            ["host", "template"], "left_semi",
        ).select("host", "shape", F.lit("block").alias("found"))
    )
    # Only urls without a rule need the tree's verdict.
    by_rule = urls.where(F.col("fitting").isNotNull()).select(
        "page_id", "host", "path", F.col("fitting.rule").alias("rule"), F.col("fitting.verdict").alias("verdict")
    )
    by_tree = urls.where(F.col("fitting").isNull()).join(rejected, ["host", "shape"], "left").select(
        "page_id", "host", "path", F.lit(None).cast("string").alias("rule"),
        F.coalesce("found", F.lit("allow")).alias("verdict"),
    )
    return reduce(DataFrame.unionByName, (by_rule, by_tree))


def urls_query(spark: SparkSession, folder: str) -> DataFrame:
    """All of `pages` under RULES."""
    return filter_urls(spark.read.parquet(f"{folder}/pages.parquet"))
