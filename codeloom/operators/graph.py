"""Import graph: edges, consumers, layers, dead exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom import catalog
from codeloom.functions import intervals, paths
from codeloom.operators.nodes import children, of_kind, with_children
from codeloom.schema import findings
from codeloom.session import cut_lineage, scratch_path

#: Starts whose reach is followed together, a bit of a long each.
MASK_BITS = 64


def _local_names_under(nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, import node_id, name) of the specifiers below script import statements."""
    specifiers = with_children(of_kind(nodes, "import_specifier"), nodes, ["name", "alias"], "text", "kind")
    first = F.coalesce("alias_text", "name_text")
    specifiers = specifiers.select(
        "path", "pre", first.alias("name"), F.coalesce("alias_kind", "name_kind").alias("name_kind")
    )
    holders = of_kind(nodes, "import_clause", "namespace_import").select("path", F.col("node_id").alias("parent_id"))
    plain = of_kind(nodes, "identifier").join(holders, ["path", "parent_id"], "left_semi")
    plain = plain.select("path", "pre", F.col("text").alias("name"), F.lit("identifier").alias("name_kind"))
    local = specifiers.unionByName(plain).filter("name IS NOT NULL")
    spans = imports.select("path", "node_id", "pre", "post")
    return intervals.inside(local, spans).select(
        "path", F.col("o_node_id").alias("node_id"), "name", "name_kind"
    )


def import_edges(nodes: DataFrame) -> DataFrame:
    """(path, line, source, name) per imported local name; a statement that brings no
    name keeps one row with a NULL name."""
    imports = of_kind(
        nodes, "import_statement", "import_from_statement", "import_declaration", "use_declaration", "import_spec",
        "interpreted_string_literal",
    )
    language = F.col("language")
    quotes = lambda c: F.regexp_replace(c, "['\"]", "")

    scripts = imports.filter(language.isin(*catalog.SCRIPT_LANGUAGES) & (F.col("kind") == "import_statement"))
    script_nodes = nodes.filter(language.isin(*catalog.SCRIPT_LANGUAGES))
    script_rows = (
        scripts.join(children(script_nodes, "source", "text"), ["path", "node_id"], "left")
        .join(_local_names_under(script_nodes, scripts).drop("name_kind"), ["path", "node_id"], "left")
        .select("path", F.col("start_line").alias("line"), F.coalesce(quotes(F.col("source_text")), F.lit("")).alias("source"), "name")
    )

    python_nodes = nodes.filter(language == "python")
    python = imports.filter((language == "python") & F.col("kind").isin("import_statement", "import_from_statement"))
    aliased = with_children(of_kind(python_nodes, "aliased_import"), python_nodes, ["alias", "name"], "text", how="left")
    python_names = (
        of_kind(python_nodes, "dotted_name")
        .filter(F.coalesce("field", F.lit("")) != "module_name")
        .select("path", "pre", F.col("text").alias("name"))
        .unionByName(aliased.select("path", "pre", F.coalesce("alias_text", "name_text", "text").alias("name")))
    )
    python_local = intervals.inside(python_names, python.select("path", "node_id", "pre", "post")).select(
        "path", F.col("o_node_id").alias("node_id"), "name"
    )
    python_rows = (
        python.join(children(python_nodes, "module_name", "text"), ["path", "node_id"], "left")
        .join(python_local, ["path", "node_id"], "left")
        .select("path", F.col("start_line").alias("line"), F.coalesce("module_name_text", F.lit("")).alias("source"), "name")
    )

    go_nodes = nodes.filter(language == "go")
    last_segment = lambda c: F.regexp_extract(c, r"([^/]*)\z", 1)
    declarations = of_kind(go_nodes, "import_declaration")
    specs = intervals.inside(
        of_kind(go_nodes, "import_spec"), declarations.select("path", "pre", "post"), "left_semi"
    )
    specs = with_children(specs, go_nodes, ["path", "name"], "text", how="left")
    bare = of_kind(go_nodes, "interpreted_string_literal").join(
        declarations.select("path", F.col("node_id").alias("parent_id")), ["path", "parent_id"], "left_semi"
    )
    go_source = F.regexp_replace(F.coalesce("path_text", F.lit("")), '"', "")
    bare_source = F.regexp_replace("text", '"', "")
    go_rows = specs.select(
        "path", F.col("start_line").alias("line"), go_source.alias("source"),
        F.coalesce("name_text", last_segment(go_source)).alias("name"),
    ).unionByName(
        bare.select(
            "path", F.col("start_line").alias("line"), bare_source.alias("source"), last_segment(bare_source).alias("name")
        )
    )

    rust_nodes = nodes.filter(language == "rust")
    uses = of_kind(rust_nodes, "use_declaration")
    scoped = of_kind(rust_nodes, "scoped_identifier").select("path", F.col("node_id").alias("parent_id"))
    aliases = with_children(of_kind(rust_nodes, "use_as_clause"), rust_nodes, ["alias"], "text")
    rust_names = (
        of_kind(rust_nodes, "identifier").join(scoped, ["path", "parent_id"], "left_anti")
        .select("path", "pre", F.col("text").alias("name"))
        .unionByName(aliases.select("path", "pre", F.col("alias_text").alias("name")))
    )
    rust_local = intervals.inside(rust_names, uses.select("path", "node_id", "pre", "post")).select(
        "path", F.col("o_node_id").alias("node_id"), "name"
    )
    used = F.regexp_replace(F.regexp_replace("text", r"^use\s+", ""), r";\z", "")
    rust_rows = uses.join(rust_local, ["path", "node_id"], "left").select(
        "path", F.col("start_line").alias("line"), used.alias("source"), "name"
    )

    java_text = F.trim(F.regexp_replace(F.regexp_replace("text", r"^import\s+(static\s+)?", ""), r";\z", ""))
    java_rows = imports.filter((language == "java") & (F.col("kind") == "import_declaration")).select(
        "path", F.col("start_line").alias("line"), java_text.alias("source"),
        F.regexp_extract(java_text, r"([^.]*)\z", 1).alias("name"),
    )
    parts = [script_rows, python_rows, go_rows, rust_rows, java_rows]
    return reduce(DataFrame.unionByName, parts).distinct()


def export_names(nodes: DataFrame) -> DataFrame:
    """(path, name) rows of exported names by the language's own rule; Python has none."""
    language = F.col("language")
    scripts = nodes.filter(language.isin(*catalog.SCRIPT_LANGUAGES))
    script_rows = intervals.inside(
        of_kind(scripts, "identifier", "type_identifier"),
        of_kind(scripts, "export_statement").select("path", "pre", "post"),
        "left_semi",
    ).select("path", F.col("text").alias("name"))
    own = children(nodes, "name", "text")
    go_rows = (
        of_kind(nodes, "function_declaration", "type_declaration").filter(language == "go")
        .join(own, ["path", "node_id"])
        .filter(F.col("name_text").rlike("^[A-Z]"))
    )
    java_rows = of_kind(nodes, "class_declaration", "interface_declaration").filter(language == "java").join(own, ["path", "node_id"])
    public = of_kind(nodes, "visibility_modifier").filter((language == "rust") & (F.col("text") == "pub")).select(
        "path", F.col("parent_id").alias("node_id")
    )
    rust_rows = public.join(own, ["path", "node_id"])
    name = lambda df: df.select("path", F.col("name_text").alias("name"))
    return reduce(DataFrame.unionByName, [script_rows, name(go_rows), name(java_rows), name(rust_rows)])


def unused_imports(nodes: DataFrame) -> DataFrame:
    """Imported names that no identifier outside the imports of the file uses."""
    imports = of_kind(nodes, "import_statement")
    local = _local_names_under(nodes, imports).filter("name_kind = 'identifier'").join(
        imports.select("path", "node_id", F.col("start_line").alias("line")), ["path", "node_id"]
    )
    identifiers = of_kind(nodes, "identifier", "type_identifier", "shorthand_property_identifier")
    used = intervals.inside(identifiers, imports.select("path", "pre", "post"), "left_anti")
    used = used.select("path", F.col("text").alias("name")).distinct()
    return findings(
        local.join(used, ["path", "name"], "left_anti"),
        rule_id="ai-smell/unused-import", analyzer="ai-smells", severity="warning",
        message=F.concat(F.lit("Unused import: '"), F.col("name"), F.lit("'")),
        file="path", line="line",
        suggestion=F.lit(catalog.SUGGESTION["ai-smell/unused-import"]),
    )


def import_resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Edges (src, dst, line) of relative imports (path, line, source): the exact path,
    else the first suffix that names a file; self-imports are dropped. Distinct targets
    are resolved once, however many files import them."""
    source = F.col("source")
    relative = imports.filter(source.startswith(".")).withColumn(
        "raw", paths.posix_join(paths.dirname(F.col("path")), source)
    )
    without = F.regexp_replace("raw", r"\.(js|jsx)\z", "")
    candidates = F.array(F.col("raw"), *[F.concat(without, F.lit(s)) for s in catalog.IMPORT_SUFFIXES])
    known = files.select(F.col("path").alias("candidate"))
    resolved = (
        relative.select("raw").distinct()
        .select("raw", F.posexplode(candidates).alias("rank", "candidate"))
        .join(known, "candidate", "left_semi")
        .groupBy("raw")
        .agg(F.min_by("candidate", "rank").alias("dst"))
    )
    return (
        relative.join(resolved, "raw")
        .filter(F.col("dst") != F.col("path"))
        .select(F.col("path").alias("src"), "dst", "line")
    )


def distinct_edges(edges: DataFrame, scope: str | None = None) -> DataFrame:
    """Distinct directed edges with both ends in the scope."""
    inside = edges.filter(F.col("src").contains(scope) & F.col("dst").contains(scope)) if scope else edges
    return inside.select("src", "dst").distinct()


def graph_adjacency(edges: DataFrame, exports: DataFrame) -> DataFrame:
    """Adjacency as rows (path, relation, name): imports, imported_by, exports. Rows,
    because a common library can be imported by a third of all files."""
    entry = lambda path, relation, name: F.struct(
        F.col(path).alias("path"), F.lit(relation).alias("relation"), F.col(name).alias("name")
    )
    ends = F.array(entry("src", "imports", "dst"), entry("dst", "imported_by", "src"))
    return edges.select(F.inline(ends)).unionByName(
        exports.select("path", F.lit("exports").alias("relation"), "name")
    )


def directory_groups(files: DataFrame, scope: str | None = None) -> DataFrame:
    """Files per directory within an optional substring scope."""
    inside = files.filter(F.col("path").contains(scope)) if scope else files
    return inside.groupBy(paths.dirname(F.col("path")).alias("directory")).agg(
        F.count("*").alias("files"), F.min("path").alias("first_file")
    )


def reach(edges: DataFrame, starts: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Files that import a start directly or through others, for many starts at once.

    Starts (path) travel in blocks of 64, one bit each: (block, node, level, mask) has one row
    per block, file and level with the starts that reach the file there first; level 0 are the
    starts themselves. The second table holds the starts (bit, flag, start) of each block.
    Neighbouring paths share a block, as they tend to share consumers.

    One join per level, whose masks are combined in each task before the exchange. Links and
    levels are written to the shared folder: each level reads the ones before it.
    """
    spark = edges.sparkSession
    links = cut_lineage(edges.select(F.col("dst").alias("node"), F.col("src").alias("next")).distinct())
    parts = cut_lineage(
        starts.select(F.col("path").alias("start")).filter("start IS NOT NULL").distinct()
        .repartitionByRange("start").withColumn("part", F.spark_partition_id().cast("long"))
    )
    place = F.row_number().over(Window.partitionBy("part").orderBy("start")) - 1
    numbered = cut_lineage(
        parts.withColumn("place", place)
        .withColumn("block", F.col("part") * (1 << 32) + F.floor(F.col("place") / MASK_BITS))
        .withColumn("bit", F.col("place") % MASK_BITS)
        .select("block", "bit", F.expr("shiftleft(1L, bit)").alias("flag"), "start")
    )
    folder, levels = scratch_path(spark, "reach"), []
    step = numbered.select("block", F.col("start").alias("node"), F.lit(0).alias("level"), F.col("flag").alias("mask"))
    schema = step.schema
    for level in range(depth + 1):
        levels.append(f"{folder}/level{level}")
        step.write.parquet(levels[-1])
        frontier = spark.read.schema(schema).parquet(levels[-1])
        met = spark.read.schema(schema).parquet(*levels).groupBy("block", "node").agg(F.bit_or("mask").alias("met"))
        found = (
            frontier.join(links, "node").groupBy("block", F.col("next").alias("node")).agg(F.bit_or("mask").alias("mask"))
        )
        step = (
            found.join(met, ["block", "node"], "left")
            .withColumn("mask", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("met", F.lit(0)))))
            .filter("mask <> 0")
            .select("block", "node", F.lit(level + 1).alias("level"), "mask")
        )
    blocks = numbered.groupBy("block").agg(F.collect_list(F.struct("bit", "flag", "start")).alias("starts"))
    return spark.read.schema(schema).parquet(*levels), blocks


def _unmasked(masks: DataFrame, blocks: DataFrame) -> DataFrame:
    """(start, consumer, level) of masks: every set bit as a row."""
    held = F.filter("starts", lambda s: F.col("mask").bitwiseAND(s["flag"]) != 0)
    return masks.join(blocks, "block").select(
        F.explode(F.transform(held, lambda s: s["start"])).alias("start"), F.col("node").alias("consumer"), "level"
    )


def consumers(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, consumer, level) of the files that import a start directly or through
    others, up to `depth` levels; the start itself is left out."""
    masks, blocks = reach(edges, starts, depth)
    return _unmasked(masks.filter("level > 0"), blocks)


def impacted_files(edges: DataFrame, changed: DataFrame, depth: int = catalog.DEFAULTS["impact_depth"]) -> DataFrame:
    """Consumers of every changed file; files without consumers do not appear."""
    return consumers(edges, changed, depth).select("start", "consumer")


def consumer_counts(masks: DataFrame) -> DataFrame:
    """(block, bit, level, n, before): how many files each start reaches at a level and at
    the levels before, added up bit by bit, without a row per start and file."""
    reached = masks.filter("level > 0")
    bits = F.array(*[F.sum(F.expr(f"shiftrightunsigned(mask, {i}) & 1L")) for i in range(MASK_BITS)])
    per_bit = (
        reached.groupBy("block", "level").agg(bits.alias("sums"))
        .select("block", "level", F.posexplode("sums").alias("bit", "n"))
    )
    lower = Window.partitionBy("block", "bit").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    return per_bit.withColumn("before", F.coalesce(F.sum("n").over(lower), F.lit(0)))


def impact_findings(
    edges: DataFrame, files: DataFrame, depth: int = catalog.DEFAULTS["impact_depth"], named: int = 5
) -> DataFrame:
    """One info finding per file with consumers: their number and the first `named`, nearest
    level first, then by name. Only levels that can still give a name are unpacked, and of
    these each task keeps the first names per start before the exchange."""
    masks, blocks = reach(edges, files, depth)
    counts = cut_lineage(consumer_counts(masks))
    wanted = (
        counts.filter((F.col("before") < named) & (F.col("n") > 0))
        .groupBy("block", "level").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("wanted"))
    )
    near = (
        masks.join(wanted, ["block", "level"])
        .withColumn("mask", F.col("mask").bitwiseAND(F.col("wanted"))).filter("mask <> 0").drop("wanted")
    )
    first = Window.partitionBy("start").orderBy("level", "consumer")
    shown = (
        _unmasked(near, blocks).withColumn("i", F.row_number().over(first)).filter(F.col("i") <= named)
        .groupBy("start")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "consumer"))), lambda s: s["consumer"]), ", ").alias("shown"))
    )
    starts = blocks.select("block", F.inline("starts")).select("block", "bit", "start")
    totals = (
        counts.groupBy("block", "bit").agg(F.sum("n").alias("n")).filter("n > 0").join(starts, ["block", "bit"])
    )
    n = F.col("n")
    message = F.concat(
        F.lit("Changes to this file impact "), n.cast("string"), F.lit(" downstream file"),
        F.when(n > 1, "s").otherwise(""), F.lit(": "), F.col("shown"),
        F.when(n > named, F.concat(F.lit(" (+"), (n - named).cast("string"), F.lit(" more)"))).otherwise(""),
    )
    return findings(
        totals.join(shown, "start"), rule_id="impact/downstream-consumers", analyzer="impact", severity="info",
        message=message, file="start", line=F.lit(1),
    )


def impact_edges(edges: DataFrame, changed: DataFrame, depth: int = catalog.DEFAULTS["impact_depth"]) -> DataFrame:
    """Distinct (changed, consumer) edges; `consumer_changed` marks consumers that changed too."""
    flags = changed.select(F.col("path").alias("consumer")).distinct().withColumn("flag", F.lit(True))
    return (
        impacted_files(edges, changed, depth).join(flags, "consumer", "left")
        .select("start", "consumer", F.coalesce("flag", F.lit(False)).alias("consumer_changed"))
    )


def layer_of(path: Column, layers: list[tuple[str, list[str]]]) -> Column:
    """First layer with a matching glob, else NULL."""
    return paths.first_glob(path, [(glob, name) for name, globs in layers for glob in globs])


def layer_assign(files: DataFrame, layers: list[tuple[str, list[str]]]) -> DataFrame:
    return files.withColumn("layer", layer_of(F.col("path"), layers))


def layer_violation(
    imports: DataFrame, layers: list[tuple[str, list[str]]], rules: list[tuple[str, list[str], list[str]]]
) -> DataFrame:
    """Imports (path, line, source) that cross layers against the (from, allow, deny)
    rules: the first rule of a layer counts, deny wins, a non-empty allow list is closed.
    Layers and rules are configuration and become column expressions."""
    source = F.col("source")
    target_path = F.when(
        source.startswith("."), paths.posix_join(paths.dirname(F.col("path")), source)
    ).otherwise(source)
    here, target = F.col("source_layer"), F.col("target_layer")
    violated, allowed, seen = F.lit(False), F.lit("none"), set()
    for origin, allow, deny in rules:
        if origin in seen:
            continue
        seen.add(origin)
        broken = target.isin(*deny) if deny else F.lit(False)
        if allow:
            broken = broken | ~target.isin(*allow)
        violated = F.when(here == origin, broken).otherwise(violated)
        allowed = F.when(here == origin, F.lit(", ".join(allow) or "none")).otherwise(allowed)
    both = F.struct(
        layer_of(F.col("path"), layers).alias("source_layer"), layer_of(F.col("target_path"), layers).alias("target_layer")
    )
    # Generators end a projection: the path and the layers are computed once per import.
    crossing = (
        imports.withColumn("target_path", F.explode(F.array(target_path)))
        .select("path", "line", F.inline(F.array(both)))
        .filter((here != target) & violated)
    )
    return findings(
        crossing, rule_id="architecture/layer-violation", analyzer="architecture", severity="error",
        message=F.concat(F.lit("Layer violation: '"), here, F.lit("' cannot import from '"), target, F.lit("'")),
        file="path", line="line",
        suggestion=F.concat(
            F.lit("Refactor to avoid importing from the '"), target, F.lit("' layer. Allowed layers: "), allowed
        ),
    )


def unused_exports(files: DataFrame, exports: DataFrame, edges: DataFrame, entry_points: list[str] = []) -> DataFrame:
    """Exports of files that nobody imports and that are neither entry points nor tests."""
    path = F.col("path")
    if entry_points:
        entry = paths.any_glob(path, entry_points) | path.isin(*entry_points)
    else:
        entry = path.contains("index.") | path.contains("main.")
    test = path.rlike(r"\.(test|spec|e2e)\.[jt]sx?\z") | path.contains("__tests__/") | path.contains("tests/")
    imported = edges.select(F.col("dst").alias("path")).distinct()
    lonely = files.select("path").filter(~entry & ~test).join(imported, "path", "left_anti")
    return findings(
        exports.join(lonely, "path", "left_semi"),
        rule_id="dead-code/unused-export", analyzer="dead-code", severity="warning",
        message=F.concat(F.lit("Export '"), F.col("name"), F.lit("' is never imported by any other file")),
        file="path", line=F.lit(1),
    )
