"""Path and glob functions."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.catalog import LANGUAGE_BY_EXTENSION


def detect_language(path: Column) -> Column:
    """Language of the extension, NULL when unknown."""
    table = F.create_map(*[F.lit(x) for x in chain(*LANGUAGE_BY_EXTENSION.items())])
    return F.try_element_at(table, F.regexp_extract(path, r"(\.[^.]*)\z", 1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, r"(?s)^(.*)/", 1)).otherwise(F.lit("."))


def stem_first_dot(path: Column) -> Column:
    """File name up to its first dot (a leading dot does not count)."""
    return F.regexp_extract(basename(path), r"^(\.[^.]*(?:\..*)?\z|[^.]*)", 1)


def stem_last_dot(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]+\z", "")


def posix_join(directory: Column, relative: Column) -> Column:
    """`directory/relative` with `.` and `..` folded; both in forward or back slashes."""
    parts = lambda c: F.split(F.translate(c, "\\", "/"), "/")
    folded = F.aggregate(
        parts(relative),
        F.filter(parts(directory), lambda p: (p != "") & (p != ".")),
        lambda done, part: F.when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(part.isin(".", ""), done)
        .otherwise(F.array_append(done, part)),
    )
    return F.array_join(folded, "/")


def _expand_braces(pattern: str) -> list[str]:
    found = re.search(r"\{([^{}]*)\}", pattern)
    if not found:
        return [pattern]
    span = re.fullmatch(r"(-?\d+)\.\.(-?\d+)", found[1])
    if span:
        low, high = int(span[1]), int(span[2])
        options = [str(i) for i in range(min(low, high), max(low, high) + 1)]
    elif "," in found[1]:
        options = found[1].split(",")
    else:
        options = ["\\{" + found[1] + "\\}"]
        return _expand_braces_rest(pattern, found, options)
    return list(
        chain.from_iterable(
            _expand_braces(pattern[: found.start()] + o + pattern[found.end() :]) for o in options
        )
    )


def _expand_braces_rest(pattern, found, options):
    tail = _expand_braces(pattern[found.end() :])
    return [pattern[: found.start()] + options[0] + t for t in tail]


def _segment(segment: str) -> str:
    """One path segment; a leading wildcard never stands for a dot."""
    out, i, first = [], 0, True
    while i < len(segment):
        c = segment[i]
        if c == "*":
            while i + 1 < len(segment) and segment[i + 1] == "*":
                i += 1
            rest = segment[i + 1 :]
            if not first:
                out.append("[^/]*")
            elif rest == "" or rest[0] == ".":
                out.append("[^./][^/]*")
            else:
                out.append("(?:[^./][^/]*)?")
        elif c == "?":
            out.append("[^./]" if first else "[^/]")
        elif c == "[" and "]" in segment[i + 2 :]:
            end = segment.index("]", i + 2)
            body = segment[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            i = end
        elif c == "\\" and i + 1 < len(segment):
            i += 1
            out.append(re.escape(segment[i]))
        else:
            out.append(re.escape(c))
        first = False
        i += 1
    return "".join(out)


def glob_to_regex(pattern: str) -> str:
    """Anchored regex of a path glob: `*` and `?` stay in a segment, `**` spans
    segments, braces alternate, wildcards skip dot files. `#...` matches nothing."""
    if pattern.startswith("#"):
        return r"[^\s\S]"
    alternatives = []
    for option in _expand_braces(pattern):
        segments, out = option.split("/"), []
        for i, segment in enumerate(segments):
            last = i == len(segments) - 1
            if segment == "**":
                out.append("(?:[^./][^/]*/)*" + ("[^./][^/]*" if last else ""))
            else:
                out.append(_segment(segment) + ("" if last else "/"))
        alternatives.append("".join(out))
    return r"\A(?:" + "|".join(alternatives) + r")\z"


def glob_match(path: Column, pattern: str) -> Column:
    if pattern.startswith("!"):
        return ~glob_match(path, pattern[1:])
    return path.rlike(glob_to_regex(pattern))


def any_glob(path: Column, patterns: list[str]) -> Column:
    result = F.lit(False)
    for pattern in patterns:
        result = result | glob_match(path, pattern)
    return result


def first_glob(path: Column, table: list[tuple[str, object]]) -> Column:
    """Value of the first (glob, value) row that matches, else NULL."""
    return F.coalesce(F.lit(None), *[F.when(glob_match(path, g), F.lit(v)) for g, v in table])
