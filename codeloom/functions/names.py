"""Name shapes: classify, test, convert."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.catalog import NAME_SHAPES
from codeloom.functions.text import regex


def matches_shape(name: Column, shape: Column | str) -> Column:
    """Whether `name` has the shape; `shape` is a literal or a column."""
    if isinstance(shape, str):
        return name.rlike(regex(NAME_SHAPES[shape]))
    result = F.lit(None).cast("boolean")
    for label, pattern in NAME_SHAPES.items():
        result = F.when(shape == label, name.rlike(regex(pattern))).otherwise(result)
    return result


def classify_name(name: Column) -> Column:
    """The first shape that fits, else NULL."""
    return F.coalesce(
        *[F.when(name.rlike(regex(p)), F.lit(label)) for label, p in NAME_SHAPES.items()]
    )


def shape_order(shape: Column) -> Column:
    """Position of a shape in classification order."""
    return F.array_position(F.array(*[F.lit(s) for s in NAME_SHAPES]), shape)


def split_words(name: Column) -> Column:
    spaced = F.translate(name, "-_", "  ")
    spaced = F.regexp_replace(spaced, "([a-z])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.filter(F.split(spaced, regex(r"\s+")), lambda w: w != "")
    return F.transform(words, F.lower)


def _joined(words: Column, shape: str) -> Column:
    capital = lambda w: F.concat(F.upper(w.substr(1, 1)), w.substr(F.lit(2), F.length(w)))
    if shape == "camelCase":
        rest = F.transform(F.slice(words, F.lit(2), F.size(words)), capital)
        return F.concat(words[0], F.array_join(rest, ""))
    if shape == "PascalCase":
        return F.array_join(F.transform(words, capital), "")
    if shape == "UPPER_SNAKE":
        return F.upper(F.array_join(words, "_"))
    return F.array_join(words, "_" if shape == "snake_case" else "-")


def convert_name(name: Column, shape: Column | str) -> Column:
    """Re-join the words of `name` in the wanted shape; a name without words stays."""

    def rejoin(words: Column) -> Column:
        if isinstance(shape, str):
            converted = _joined(words, shape)
        else:
            converted = name
            for label in NAME_SHAPES:
                converted = F.when(shape == label, _joined(words, label)).otherwise(converted)
        return F.when(F.size(words) == 0, name).otherwise(converted)

    # A one-element array binds the words, so that they are split once per name.
    return F.transform(F.array(split_words(name)), rejoin)[0]


def message_name(message: Column) -> Column:
    """(name, shape) quoted in a naming finding; NULL when it names no known shape."""
    # One match holds both: no name has a quote, no shape a space.
    found = F.regexp_extract(message, regex(r"'([^']+'.*should use \S+) naming"), 1)

    def parsed(found: Column) -> Column:
        shape = F.substring_index(found, "should use ", -1)
        return F.when(shape.isin(*NAME_SHAPES), F.struct(F.substring_index(found, "'", 1).alias("name"), shape.alias("shape")))

    # A one-element array binds the match, so that it is searched once per message.
    return F.transform(F.array(found), parsed)[0]


def unused_import_name(message: Column) -> Column:
    name = F.regexp_extract(message, regex(r"Unused import:\s*'([^']+)'"), 1)
    return F.when(name != "", name)
