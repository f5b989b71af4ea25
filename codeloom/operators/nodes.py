"""Detectors over the syntax-node table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom import catalog
from codeloom.functions import intervals, names, ordered, paths, text
from codeloom.functions.identity import lookup
from codeloom.functions.kinds import only
from codeloom.schema import findings
from codeloom.session import cut_lineage, small_side


def children(nodes: DataFrame, field: str, *columns: str) -> DataFrame:
    """(path, node_id, <field>_<column>...) of the child under a field; the node table
    names at most one child per field."""
    return only(nodes, "field", field).select(
        "path", F.col("parent_id").alias("node_id"), *[F.col(c).alias(f"{field}_{c}") for c in columns]
    )


def with_children(rows: DataFrame, nodes: DataFrame, fields: list[str], *columns: str, how="inner") -> DataFrame:
    """Attach field children: the first field joins by `how`, the others are optional."""
    for i, field in enumerate(fields):
        rows = rows.join(children(nodes, field, *columns), ["path", "node_id"], how if i == 0 else "left")
    return rows


def of_kind(nodes: DataFrame, *kinds: str) -> DataFrame:
    return only(nodes, "kind", *kinds)


def _security(df, rule, message, severity="error", suggestion=None, **optional) -> DataFrame:
    suggestion = F.lit(suggestion or catalog.SUGGESTION[rule]) if not isinstance(suggestion, Column) else suggestion
    return findings(
        df, rule_id=rule, analyzer="security", severity=severity, message=message,
        file="path", line="start_line", suggestion=suggestion, **optional,
    )


def sql_injection(nodes: DataFrame) -> DataFrame:
    """SQL-like template strings with a named child, and SQL-like `+` expressions that
    contain an identifier."""
    sql = of_kind(nodes, "template_string", "binary_expression").filter(text.looks_like_sql(F.col("text")))
    named = nodes.filter("named").select("path", F.col("parent_id").alias("node_id")).distinct()
    templates = of_kind(sql, "template_string").join(named, ["path", "node_id"], "left_semi")
    plus = with_children(of_kind(sql, "binary_expression"), nodes, ["operator"], "text").filter(
        "operator_text = '+'"
    )
    concatenated = intervals.holding(plus, of_kind(nodes, "identifier"))
    return _security(
        templates,
        "security/sql-injection",
        F.lit("Potential SQL injection: SQL keywords in template literal with interpolation"),
        code_snippet=F.substring("text", 1, 100),
    ).unionByName(
        _security(
            concatenated,
            "security/sql-injection",
            F.lit("Potential SQL injection: SQL keywords in string concatenation"),
            suggestion="Use parameterized queries instead of string concatenation",
        )
    )


def xss_sinks(nodes: DataFrame) -> DataFrame:
    """Assignments to HTML properties, document writers, raw-HTML React attributes."""
    members = nodes.filter((F.col("kind") == "member_expression") & (F.col("field") == "left"))
    assigned = of_kind(nodes, "assignment_expression").join(
        with_children(members, nodes, ["property"], "text")
        .filter(F.col("property_text").isin(*catalog.HTML_PROPERTIES))
        .select("path", F.col("parent_id").alias("node_id"), "property_text"),
        ["path", "node_id"],
    )
    writers = with_children(of_kind(nodes, "call_expression"), nodes, ["function"], "text").filter(
        F.col("function_text").isin(*catalog.HTML_WRITERS)
    )
    attributes = with_children(of_kind(nodes, "jsx_attribute"), nodes, ["name"], "text").filter(
        F.col("name_text") == catalog.REACT_HTML_ATTRIBUTE
    )
    rule = "security/xss"
    parts = [
        _security(assigned, rule, F.concat(F.lit("XSS risk: direct assignment to "), F.col("property_text"))),
        _security(
            writers, rule, F.concat(F.lit("XSS risk: "), F.col("function_text"), F.lit("() usage")),
            suggestion="Avoid document.write; use DOM manipulation instead",
        ),
        _security(
            attributes, rule, F.lit("XSS risk: dangerouslySetInnerHTML usage"), severity="warning",
            suggestion="Sanitize HTML content before using dangerouslySetInnerHTML",
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def eval_calls(nodes: DataFrame) -> DataFrame:
    calls = with_children(of_kind(nodes, "call_expression"), nodes, ["function"], "text").filter(
        F.col("function_text").isin("eval", "Function")
    )
    name = F.col("function_text")
    return _security(
        calls,
        "security/eval",
        F.concat(F.lit("Dangerous "), name, F.lit("() usage detected")),
        suggestion=F.concat(F.lit("Avoid "), name, F.lit("(); use safer alternatives")),
    )


def unsafe_regex(nodes: DataFrame) -> DataFrame:
    risky = of_kind(nodes, "regex").filter(text.unsafe_regex(F.col("text")))
    return _security(
        risky, "security/unsafe-regex", F.lit("Potential ReDoS: regex with nested quantifiers"),
        severity="warning", code_snippet=F.col("text"),
    )


def _smell(df, rule, message, line="start_line", **optional) -> DataFrame:
    return findings(
        df, rule_id=rule, analyzer="ai-smells", severity="warning", message=message,
        file="path", line=line, suggestion=F.lit(catalog.SUGGESTION[rule]), **optional,
    )


def type_assertion_any(nodes: DataFrame) -> DataFrame:
    cast = with_children(of_kind(nodes, "as_expression"), nodes, ["type"], "text").filter("type_text = 'any'")
    return _smell(
        cast,
        "ai-smell/unnecessary-type-assertion",
        F.lit('Type assertion to "any" — may indicate AI-generated type workaround'),
    )


def verbose_error_handling(nodes: DataFrame) -> DataFrame:
    """Catch bodies over 15 lines and over three times the try body. Extra columns
    try_lines and catch_lines carry the numbers behind the message."""
    span = F.col("end_line") - F.col("start_line")
    bodies = nodes.filter("field = 'body'").select("path", F.col("parent_id").alias("node_id"), span.alias("span"))
    handlers = (
        nodes.filter("field = 'handler'")
        .join(bodies, ["path", "node_id"])
        .select(
            "path",
            F.col("parent_id").alias("node_id"),
            F.col("start_line").alias("handler_line"),
            F.col("span").alias("catch_lines"),
        )
    )
    verbose = (
        of_kind(nodes, "try_statement")
        .join(handlers, ["path", "node_id"])
        .join(bodies.withColumnRenamed("span", "try_lines"), ["path", "node_id"])
        .filter("catch_lines > try_lines * 3 AND catch_lines > 15")
    )
    tries, catches = F.col("try_lines"), F.col("catch_lines")
    message = F.concat(
        F.lit("Catch block ("), catches.cast("string"), F.lit(" lines) is "), text.fixed_point(catches, tries, 1),
        F.lit("x larger than try block ("), tries.cast("string"), F.lit(" lines)"),
    )
    return _smell(verbose, "ai-smell/verbose-error-handling", message, line="handler_line")


def proximity_cluster(nodes: DataFrame, width: int = 1024) -> DataFrame:
    """Non-null assertions with at least three within ten lines, reported at the first
    of them. Lines are counted once each and cut into buckets with a ten-line halo, so
    a dense or huge file spreads over tasks."""
    reach = 9
    per_line = of_kind(nodes, "non_null_expression").groupBy("path", "start_line").agg(F.count("*").alias("n"))
    bucket = F.floor(F.col("start_line") / width)
    edges = F.array_distinct(
        F.array(F.floor((F.col("start_line") - reach) / width), bucket, F.floor((F.col("start_line") + reach) / width))
    )
    spread = per_line.withColumn("home", bucket).withColumn("bucket", F.explode(edges))
    near = Window.partitionBy("path", "bucket").orderBy("start_line").rangeBetween(-reach, reach)
    hits = (
        spread.withColumns({"near": F.sum("n").over(near), "first": F.min("start_line").over(near)})
        .filter("home = bucket AND near >= 3 AND first = start_line")
    )
    return _smell(
        hits,
        "ai-smell/excessive-non-null-assertions",
        F.concat(F.col("near").cast("string"), F.lit(" non-null assertions (!) in close proximity")),
    )


# --- naming ---------------------------------------------------------------------------


def naming_resolution(files: DataFrame, defaults: dict[str, str], per_language: dict[str, dict[str, str]]) -> DataFrame:
    """Naming shape of every category for each row's language: the language's own
    override, else the project default for scripts, else the language default."""
    columns = {}
    for i, category in enumerate(catalog.NAMING_CATEGORIES):
        table = {}
        for language in catalog.LANGUAGES:
            base = defaults[category] if language in catalog.SCRIPT_LANGUAGES else catalog.LANGUAGE_KINDS[language][2][i]
            table[language] = per_language.get(language, {}).get(category, base)
        columns[f"{category}_naming"] = F.coalesce(lookup(table, F.col("language")), F.lit(defaults[category]))
    return files.withColumns(columns)


DEFAULT_NAMING = dict(zip(catalog.NAMING_CATEGORIES, catalog.LANGUAGE_KINDS["typescript"][2]))


def _shape_of(category: str, defaults, per_language) -> Column:
    i = catalog.NAMING_CATEGORIES.index(category)
    table = {}
    for language in catalog.LANGUAGES:
        base = defaults[category] if language in catalog.SCRIPT_LANGUAGES else catalog.LANGUAGE_KINDS[language][2][i]
        table[language] = per_language.get(language, {}).get(category, base)
    return lookup(table, F.col("language"))


def _naming_findings(named: DataFrame, label: str, rule: str, shape: Column, line="name_start_line") -> DataFrame:
    name = F.col("name_text")
    wrong = named.withColumn("shape", shape).filter(
        ~name.isin(*catalog.IGNORED_NAMES) & ~names.matches_shape(name, F.col("shape"))
    )
    return findings(
        wrong, rule_id=rule, analyzer="conventions", severity="warning",
        message=F.concat(F.lit(f"{label} '"), name, F.lit("' should use "), F.col("shape"), F.lit(" naming")),
        file="path", line=line,
        suggestion=F.concat(F.lit("Rename to match "), F.col("shape"), F.lit(" convention")),
    )


def _scripts(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("language").isin(*catalog.SCRIPT_LANGUAGES))


def function_naming(nodes: DataFrame, defaults=DEFAULT_NAMING, per_language={}) -> DataFrame:
    """Script functions, methods and function-valued variables."""
    scripts = _scripts(nodes)
    candidates = with_children(
        of_kind(scripts, "function_declaration", "method_definition", "variable_declarator"),
        scripts, ["name", "value"], "text", "kind", "start_line",
    )
    name = F.col("name_text")
    accessors = (
        scripts.filter(F.col("kind").isin("get", "set"))
        .select("path", F.col("parent_id").alias("node_id"), F.lit("method_definition").alias("kind"))
        .distinct()
    )
    kept = candidates.filter(
        ((F.col("kind") != "variable_declarator") | F.col("value_kind").isin("arrow_function", "function"))
        & ~name.startswith("_")
        & (name != "constructor")
        & ~(F.col("path").rlike(r"\.[jt]sx\z") & name.rlike("^[A-Z]"))
    ).join(accessors, ["path", "node_id", "kind"], "left_anti")
    return _naming_findings(
        kept, "Function", "convention/function-naming", _shape_of("functions", defaults, per_language)
    )


def _kinds_of(languages: list[str], index: int) -> Column:
    language, kind = F.col("language"), F.col("kind")
    tests = [(language == l) & kind.isin(*catalog.LANGUAGE_KINDS[l][index]) for l in languages]
    return reduce(lambda a, b: a | b, tests)


def _of_languages(nodes: DataFrame, languages: list[str], index: int) -> DataFrame:
    kinds = {kind for l in languages for kind in catalog.LANGUAGE_KINDS[l][index]}
    return of_kind(nodes, *sorted(kinds)).filter(_kinds_of(languages, index))


def _other_languages() -> list[str]:
    return [l for l in catalog.LANGUAGES if l not in catalog.SCRIPT_LANGUAGES]


def function_naming_multilang(nodes: DataFrame, defaults=DEFAULT_NAMING, per_language={}) -> DataFrame:
    named = with_children(_of_languages(nodes, _other_languages(), 0), nodes, ["name"], "text", "start_line")
    name = F.col("name_text")
    kept = named.filter(
        ~name.startswith("_")
        & ~((F.col("language") == "go") & name.rlike("^[A-Z]"))
        & ~name.isin("constructor", "__init__", "main")
    )
    return _naming_findings(
        kept, "Function", "convention/function-naming", _shape_of("functions", defaults, per_language)
    )


def class_naming(nodes: DataFrame, defaults=DEFAULT_NAMING, per_language={}) -> DataFrame:
    named = with_children(_of_languages(nodes, catalog.LANGUAGES, 1), nodes, ["name"], "text", "start_line")
    return _naming_findings(named, "Type", "convention/class-naming", _shape_of("classes", defaults, per_language))


def constant_naming(nodes: DataFrame, defaults=DEFAULT_NAMING, per_language={}) -> DataFrame:
    """Module-level `const` with a string, number or boolean literal."""
    scripts = _scripts(nodes)
    parents = of_kind(scripts, "program", "export_statement").select("path", F.col("node_id").alias("parent_id"))
    const = scripts.filter("text = 'const'").select("path", F.col("parent_id").alias("node_id")).distinct()
    declarations = (
        of_kind(scripts, "lexical_declaration")
        .join(parents, ["path", "parent_id"], "left_semi")
        .join(const, ["path", "node_id"], "left_semi")
        .select("path", F.col("node_id").alias("parent_id"))
    )
    declarators = of_kind(scripts, "variable_declarator").join(declarations, ["path", "parent_id"], "left_semi")
    named = with_children(declarators, scripts, ["name", "value"], "text", "kind", "start_line").filter(
        (F.col("name_kind") == "identifier") & F.col("value_kind").isin("string", "number", "true", "false")
    )
    return _naming_findings(
        named, "Constant", "convention/constant-naming", _shape_of("constants", defaults, per_language)
    )


def file_naming(files: DataFrame, defaults=DEFAULT_NAMING, per_language={}) -> DataFrame:
    """Added files; index, dot, dunder and config files are free, and so are Python
    files where kebab-case is asked for."""
    shape = F.coalesce(_shape_of("files", defaults, per_language), F.lit(defaults["files"]))
    path = F.col("path")
    base, stem = paths.basename(path), paths.stem_last_dot(path)
    free = (
        (stem == "index") | stem.startswith(".") | stem.startswith("__")
        | stem.rlike(r"\.config\z") | base.rlike(r"\.config\.\w+\z")
        | ((F.col("shape") == "kebab-case") & path.rlike(r"\.py\z"))
    )
    wrong = files.filter("status = 'added'").withColumn("shape", shape).filter(
        ~free & ~names.matches_shape(stem, F.col("shape"))
    )
    return findings(
        wrong, rule_id="convention/file-naming", analyzer="conventions", severity="warning",
        message=F.concat(F.lit("File '"), base, F.lit("' should use "), F.col("shape"), F.lit(" naming")),
        file="path", line=F.lit(1),
        suggestion=F.concat(F.lit("Rename file to match "), F.col("shape"), F.lit(" convention")),
    )


def name_harvest(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(category, name, path) of functions, classes, constants and file stems. Exported
    classes are listed twice, once as a class and once below their export."""
    functions = with_children(
        of_kind(nodes, "function_declaration", "method_definition"), nodes, ["name"], "text"
    ).filter((F.col("kind") != "method_definition") | (F.col("name_text") != "constructor"))
    declarators = with_children(
        of_kind(nodes, "variable_declarator"), nodes, ["name", "value"], "text", "kind"
    ).filter("value_kind IS NOT NULL")
    callable_value = F.col("value_kind").isin("arrow_function", "function", "function_expression")
    variables = declarators.filter(callable_value)
    declarations = of_kind(nodes, "lexical_declaration").select("path", F.col("node_id").alias("parent_id"))
    # Every node may be the first below a declaration; what it says is known before it is sent. An
    # inner join, as a semi join would be repeated for each projection; a row twice has one minimum.
    first = nodes.select("path", "parent_id", "pre", (F.col("text") == "const").alias("const"))
    opened = (
        first.join(declarations, ["path", "parent_id"])
        .groupBy("path", "parent_id").agg(F.min_by("const", "pre").alias("const"))
        .filter("const")
    )
    constants = declarators.filter(~callable_value & F.col("name_text").rlike("^[A-Z_][A-Z0-9_]*$")).join(
        opened, ["path", "parent_id"], "left_semi"
    )
    classes = with_children(of_kind(nodes, "class_declaration"), nodes, ["name"], "text")
    exports = of_kind(nodes, "export_statement").select("path", F.col("node_id").alias("parent_id"))
    exported = classes.join(exports, ["path", "parent_id"], "left_semi")

    row = lambda df, category: df.select(F.lit(category).alias("category"), F.col("name_text").alias("name"), "path")
    stems = files.select(F.lit("files").alias("category"), paths.stem_first_dot(F.col("path")).alias("name"), "path")
    parts = [
        row(functions, "functions"), row(variables, "functions"),
        row(classes, "classes"), row(exported, "classes"),
        row(constants, "constants"), stems,
    ]
    return reduce(DataFrame.unionByName, parts)


def convention_inference(named: DataFrame, order: list[str], samples: int = 5) -> DataFrame:
    """Dominant shape per category of (category, name, <order>): confidence, total,
    and its first samples. Ties go to the shape that is tried first."""
    shaped = named.withColumn("shape", names.classify_name(F.col("name"))).filter("shape IS NOT NULL")
    # Names are counted by the first order column, too: the first samples lie at its first few
    # values, so no other name needs to be sorted.
    places = cut_lineage(shaped.groupBy("category", "shape", F.col(order[0]).alias("at")).agg(F.count("*").alias("n")))
    counts = places.groupBy("category", "shape").agg(F.sum("n").alias("n"))
    best = counts.groupBy("category").agg(
        F.max(F.struct("n", (-names.shape_order(F.col("shape"))).alias("o"), "shape")).alias("top"),
        F.sum("n").alias("total"),
    ).select("category", F.col("top.shape").alias("shape"), F.col("top.n").alias("n"), "total")
    first = Window.partitionBy("category", "shape").orderBy(*order)
    rank = F.row_number().over(Window.partitionBy("category", "shape").orderBy("at"))
    until = places.withColumn("i", rank).filter(F.col("i") <= samples).groupBy("category", "shape").agg(F.max("at").alias("until"))
    # A null comes before all values.
    shown = (
        shaped.join(small_side(until), ["category", "shape"]).filter(F.col(order[0]).isNull() | (F.col(order[0]) <= F.col("until")))
        .withColumn("i", F.row_number().over(first))
        .filter(F.col("i") <= samples)
        .groupBy("category", "shape")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda s: s["name"]), ",").alias("samples"))
    )
    return best.join(shown, ["category", "shape"]).select(
        "category", F.col("shape").alias("convention"), (F.col("n") / F.col("total") * 100).alias("confidence"),
        "total", "samples",
    )


# --- configured node rules ---------------------------------------------------------------


def node_rule_match(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (id, language, kind, rule, message, severity, fix): nodes of the rule's
    language family and kind whose text matches its regex."""
    dialects = {"typescript": ["typescript", "tsx"], "javascript": ["javascript", "jsx"]}
    family = F.coalesce(
        *[F.when(F.col("language") == l, F.array(*map(F.lit, ds))) for l, ds in dialects.items()],
        F.array("language"),
    )
    severity = F.lower("severity")
    spread = rules.select(
        F.col("id"), F.explode(family).alias("language"), "kind", "rule", "message", "fix",
        F.when(severity.isin("error", "info"), severity).otherwise("warning").alias("severity"),
    )
    matched = nodes.join(small_side(spread), ["language", "kind"]).filter("text rlike rule")
    return findings(
        matched,
        rule_id=F.concat(F.lit("custom/"), F.col("id")),
        analyzer="structural-rules",
        severity=F.col("severity"),
        message=F.col("message"),
        file="path",
        line="start_line",
        code_snippet=F.substring("text", 1, 100),
        suggestion=F.col("fix"),
    )


# --- complexity ---------------------------------------------------------------------------


def functions_of(nodes: DataFrame) -> DataFrame:
    """Function nodes of every language."""
    return _of_languages(nodes, catalog.LANGUAGES, 0).select(
        "path", "node_id", "parent_id", "pre", "post", "start_line"
    )


def named_functions(functions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add function_name: the own name, else the variable it is assigned to, else <anonymous>."""
    own = children(nodes, "name", "text")
    variables = (
        of_kind(nodes, "variable_declarator").select("path", "node_id").join(own, ["path", "node_id"])
        .select("path", F.col("node_id").alias("parent_id"), F.col("name_text").alias("variable"))
    )
    return (
        functions.join(own, ["path", "node_id"], "left")
        .join(variables, ["path", "parent_id"], "left")
        .withColumn("function_name", F.coalesce("name_text", "variable", F.lit("<anonymous>")))
        .drop("name_text", "variable")
    )


def _logical(nodes: DataFrame) -> DataFrame:
    return with_children(of_kind(nodes, "binary_expression"), nodes, ["operator"], "text").filter(
        F.col("operator_text").isin(*catalog.LOGICAL_OPERATORS)
    )


def cyclomatic_complexity(nodes: DataFrame) -> DataFrame:
    """1 + branch nodes + logical operators below each function; nested functions count
    in the outer one as well."""
    branches = of_kind(nodes, *catalog.BRANCH_KINDS).select("path", "pre")
    points = branches.unionByName(_logical(nodes).select("path", "pre")).withColumn("cyclomatic", F.lit(1).cast("long"))
    counted = intervals.subtree_sums(functions_of(nodes), points, ["cyclomatic"])
    return named_functions(counted.withColumn("cyclomatic", F.col("cyclomatic") + 1), nodes)


def cognitive_complexity(nodes: DataFrame) -> DataFrame:
    """Nesting nodes weigh 1 + their nesting inside the function, else clauses and
    logical operators weigh 1.

    The nesting inside a function is the nesting in the file minus the nesting of the
    function itself, so one running count over the file serves all functions.
    """
    functions = functions_of(nodes)
    nesting = of_kind(nodes, *catalog.NESTING_KINDS).select("path", "node_id", "pre", "post")
    # At equal positions a question comes before an opening or closing mark.
    mark = lambda at, rank, delta, ask: F.struct(
        F.col(at).alias("at"), F.lit(rank).alias("rank"), F.lit(delta).alias("delta"), F.lit(ask).alias("ask")
    )
    marks = nesting.select(
        "path", "node_id", "pre",
        F.explode(F.array(mark("pre", 0, 0, "node"), mark("pre", 1, 1, None), mark("post", 1, -1, None))).alias("m"),
    ).unionByName(functions.select("path", "node_id", "pre", F.explode(F.array(mark("pre", 0, 0, "function"))).alias("m")))
    depth = ordered.running_sum(
        marks.select("path", "node_id", "pre", "m.*"), ["path"], ["at", "rank"], F.col("delta"), "depth"
    ).filter("ask IS NOT NULL")
    one = F.lit(1).cast("long")
    nested = depth.filter("ask = 'node'").select(
        "path", "pre", (F.col("depth") + 1).cast("long").alias("weight"), one.alias("nested")
    )
    flat = (
        of_kind(nodes, "else_clause").select("path", "pre")
        .unionByName(_logical(nodes).select("path", "pre"))
        .select("path", "pre", one.alias("weight"), F.lit(0).cast("long").alias("nested"))
    )
    sums = intervals.subtree_sums(functions, nested.unionByName(flat), ["weight", "nested"])
    own = depth.filter("ask = 'function'").select("path", "node_id", F.col("depth").alias("own_depth"))
    scored = (
        sums.join(own, ["path", "node_id"])
        .withColumn("cognitive", F.col("weight") - F.col("nested") * F.col("own_depth"))
        .drop("weight", "nested", "own_depth")
    )
    return named_functions(scored, nodes)


def complexity_findings(scored: DataFrame, measure: str, limit: int, severity: str = "warning") -> DataFrame:
    """Functions whose `measure` (cyclomatic or cognitive) exceeds the limit."""
    value = F.col(measure)
    return findings(
        scored.filter(value > limit),
        rule_id=f"complexity/{measure}-too-high",
        analyzer="complexity",
        severity=severity,
        message=F.concat(
            F.lit("Function '"), F.col("function_name"), F.lit(f"' has {measure} complexity "),
            value.cast("string"), F.lit(f" (max: {limit})"),
        ),
        file="path",
        line="start_line",
    )


def html_nodes(pages: DataFrame) -> DataFrame:
    """Tags of (page_id, html) with +1 / -1 / 0 for open, close and void ones. The
    opening `<` and the slash are read from the tag text itself."""
    # Fixed values. Tags that hold nothing.
    void = ["br", "meta", "img", "link", "hr", "input"]
    tags = pages.select(
        "page_id", F.posexplode(F.regexp_extract_all("html", F.lit("</?[a-z][a-z0-9]*"), F.lit(0))).alias("pos", "tag")
    )
    kind = F.regexp_replace("tag", "^</?", "")
    closing = F.col("tag").startswith("</")
    delta = F.when(kind.isin(*void), 0).when(closing, -1).otherwise(1)
    return tags.select(
        "page_id", F.col("pos").cast("long").alias("pos"), kind.alias("kind"), closing.alias("is_close"),
        delta.alias("delta"),
    )


def nesting_depth(marks: DataFrame, key: str, order: str) -> DataFrame:
    """Running depth after each open/close mark."""
    return ordered.running_sum(marks, [key], [order], F.col("delta"), "depth")
