"""Regex dialect, trimming and line predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom import catalog

# The white space that JavaScript's `\s` and `trim()` know.
_WIDE = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
SPACES = "\t\n\x0b\x0c\r " + "".join(map(chr, _WIDE))
# The same as a class in few ranges, and its complements for Java's engine, which tries the
# parts of a class one after the other: what nearly every character is stands first.
_SPACE_RANGES = "\t-\r " + chr(0xA0) + chr(0x1680) + chr(0x2000) + "-" + chr(0x200A) + chr(0x2028) + chr(0x2029) + "".join(map(chr, _WIDE[-4:]))
_LINE_ENDS = "\n\r" + chr(0x2028) + chr(0x2029)
_WORD_EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def regex(pattern: str, ignore_case: bool = False, java: bool = True) -> str:
    """A JavaScript line pattern for Java's engine (or RE2 with `java=False`): `\\s`
    covers Unicode spaces, `\\b` looks at ASCII words only, `.` stops at line ends and
    `$` is the very end."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(_SPACE_RANGES if in_class else f"[{_SPACE_RANGES}]")
        elif two == r"\S":
            out.append(f"[!-~[^{_SPACE_RANGES}]]" if java else f"[^{_SPACE_RANGES}]")
        elif two == r"\b" and java:
            out.append(_WORD_EDGE)
        elif two[0] == "\\":
            out.append(two)
        elif two[0] == "$" and not in_class:
            out.append(r"\z")
            i -= 1
        elif two[0] == "." and not in_class:
            out.append(f"[ -~[^{_LINE_ENDS}]]" if java else f"[^{_LINE_ENDS}]")
            i -= 1
        else:
            in_class = two[0] == "[" or (in_class and two[0] != "]")
            out.append(two[0])
            i -= 1
        i += 2
    return ("(?i)" if ignore_case else "") + "".join(out)


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def trim_start(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACES))


def collapse_spaces(text: Column) -> Column:
    return trim(F.regexp_replace(text, f"[{SPACES}]+", " "))


def fixed_point(numerator: Column, denominator: Column, digits: int) -> Column:
    """numerator / denominator as text with `digits` decimals, halves rounded up, in
    exact integer arithmetic. A zero denominator prints as Infinity."""
    scale = 10**digits
    scaled = F.floor((numerator * (2 * scale) + denominator) / (denominator * 2)).cast("long")
    if digits == 0:
        text = scaled.cast("string")
    else:
        fraction = F.lpad((scaled % scale).cast("string"), digits, "0")
        text = F.concat(F.floor(scaled / scale).cast("string"), F.lit("."), fraction)
    return F.when(denominator == 0, F.lit("Infinity")).otherwise(text)


def looks_like_sql(text: Column) -> Column:
    """A SQL verb and a verb-clause shape, not just a sentence with `update` in it."""
    return text.rlike(regex(catalog.SQL_VERB, True)) & text.rlike(regex(catalog.SQL_SHAPE, True))


def unsafe_regex(pattern: Column) -> Column:
    """A repeated group with an inner `+`/`*` and no literal that must occur once."""
    simplified = F.regexp_replace(pattern, r"\[(?:[^\]\\]|\\.)*\]", "#")
    groups = F.regexp_extract_all(simplified, F.lit(r"\(([^)]+)\)(?:[+*]|\{[^}]*,)"), F.lit(1))
    return F.exists(
        groups,
        lambda body: body.rlike("[+*]") & ~body.rlike(r"[^#.\\+*?{}()|](?![+*?{])"),
    )


def is_comment(trimmed: Column) -> Column:
    return trimmed.rlike(r"^(?://|/\*|\*|#)")


def is_boilerplate(trimmed: Column) -> Column:
    """Closers, jumps, and return/import/export lines."""
    return trimmed.isin("{", "}", "});", "]);", ")", ");", "break;", "continue;") | trimmed.rlike(
        "^(?:return|import|export) "
    )


def is_single_call(trimmed: Column) -> Column:
    return trimmed.rlike(regex(r"^\w+[\w.]*\(.*\)[;,]?$"))
