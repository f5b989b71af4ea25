"""Fingerprints, severities, package URLs."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom import catalog
from codeloom.functions.text import collapse_spaces

NUL = chr(0)


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), key)


def severity_rank(severity: Column) -> Column:
    return lookup(catalog.SEVERITY_RANK, severity)


def sarif_level(severity: Column) -> Column:
    return lookup(catalog.SARIF_LEVEL, severity)


def annotation_level(severity: Column) -> Column:
    return lookup(catalog.ANNOTATION_LEVEL, severity)


def content_fingerprint(rule: Column, file: Column, snippet: Column) -> Column:
    text = collapse_spaces(F.coalesce(snippet, F.lit("")))
    return F.sha2(F.concat(rule, F.lit(NUL), file, F.lit(NUL), text), 256)


def message_fingerprint(rule: Column, file: Column, message: Column) -> Column:
    return F.concat(rule, F.lit(NUL), file, F.lit(NUL), message)


def suggestion_key(rule: Column, file: Column, line: Column, snippet: Column) -> Column:
    parts = [rule, F.lit(NUL), file, F.lit(NUL), line.cast("string"), F.lit(NUL), F.coalesce(snippet, F.lit(""))]
    return F.sha2(F.concat(*parts), 256)


def strip_version_prefix(version: Column) -> Column:
    return F.regexp_replace(version, "^[\\^~>=<]", "")


def manifest_of(ecosystem: Column) -> Column:
    return F.coalesce(lookup(catalog.MANIFESTS, ecosystem), F.lit("package.json"))


def package_url(name: Column, version: Column, ecosystem: Column) -> Column:
    coordinates = F.split(name, ":")
    artifact = F.coalesce(F.try_element_at(coordinates, F.lit(2)), F.lit("undefined"))
    body = (
        F.when(ecosystem == "npm", F.concat(F.lit("npm/"), F.regexp_replace(name, "^([^@]*)@", "$1%40")))
        .when(ecosystem == "Go", F.concat(F.lit("golang/"), name))
        .when(ecosystem == "crates.io", F.concat(F.lit("cargo/"), name))
        .when(ecosystem == "Maven", F.concat(F.lit("maven/"), coordinates[0], F.lit("/"), artifact))
        .otherwise(F.concat(F.lit("generic/"), name))
    )
    return F.concat(F.lit("pkg:"), body, F.lit("@"), version)


def shape_key(shape: Column) -> Column:
    """Group key of a normalised block shape; wide enough to stand for the text itself."""
    return F.sha2(shape, 256)
