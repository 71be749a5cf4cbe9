"""Scalar functions on text: cleaning, JSON, windows, imports, hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

#: Characters of a text that a window shows whole.
WINDOW = 24_000


def title_case(text: Column) -> Column:
    """Upper case after every character that isn't a letter, lower case elsewhere."""
    parts = F.regexp_extract_all(text, F.lit(r"([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    return F.array_join(F.transform(parts, F.initcap), "")


def clean_type(kind: Column) -> Column:
    """Without a trailing (CWE-n); snake_case and kebab-case become Title Case if there is no space."""
    bare = F.trim(F.regexp_replace(kind, r"(?i)\s*\(cwe-\d+\)\s*$", ""))
    spaced = title_case(F.trim(F.regexp_replace(bare, "[_-]+", " ")))
    return F.when(~F.contains(bare, F.lit(" ")) & bare.rlike("[_-]"), spaced).otherwise(bare)


def class_key(cwe: Column, kind: Column) -> Column:
    """What makes two findings the same class: the CWE number, else the type."""
    number = F.upper(F.regexp_extract(cwe, r"(?i)cwe-\d+", 0))
    return F.when(number != "", number).otherwise(F.lower(F.trim(kind)))


def json_object(text: Column) -> Column:
    """The part from the first { to the last }, without code fences around it; '' if there is none."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


#: What ends a line. Java's \R is \r\n or one of \n \x0B \f \r \x85 U+2028 U+2029, and is found twice as fast as a class of them.
LINE_END = r"\R|[\x1C-\x1E]"


def lines(text: Column) -> Column:
    """Lines without a last empty one. The cut text is bound by a transform, as it would be cut anew wherever it is named."""
    bare = lambda cut: F.when(F.element_at(cut, -1) == "", F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut)
    return F.get(F.transform(F.array(F.split(text, LINE_END)), bare), F.lit(0))


def fed_lines(text: Column) -> Column:
    """Lines as line feeds alone part them, a last empty one too (SQL's string_split)."""
    return F.split(text, "\n")


def nonblank_lines(text: Column) -> Column:
    return F.size(F.filter(lines(text), lambda x: ~x.rlike(r"^\s*$"))).cast("bigint")


def line_range(all_lines: Column, start: Column, end: Column, most: int | None = 400) -> Column:
    """Lines start to end, of which most + 1 at most (None: all), joined. A range beyond the text is cut."""
    first = F.greatest(start, F.lit(1))
    last = F.least(F.size(all_lines), F.when(end >= first, end).otherwise(first))
    if most is not None:
        last = F.least(last, first + most)
    return F.array_join(F.slice(all_lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")


def numbered(all_lines: Column, first: Column, last: Column) -> Column:
    """Lines first + 1 to last with their numbers."""
    return F.transform(F.slice(all_lines, first + 1, F.greatest(last - first, F.lit(0))), lambda x, i: F.concat(F.lpad((first + i + 1).cast("string"), 6, " "), F.lit("│"), x))


def numbered_window(text: Column, around: Column, most: int | None = WINDOW, per_line: int = 160, cut: Callable[[Column], Column] = lines) -> Column:
    """The text with numbered lines (as cut parts them); of a text longer than most characters (None: of none), only most / per_line lines before and after `around`."""
    each = cut(text)
    if most is None:
        return F.array_join(numbered(each, F.lit(0), F.size(each)), "\n")
    reach, long = most // per_line, F.length(text) > most
    middle = F.greatest(around - 1, F.lit(0))
    first = F.when(long, F.greatest(middle - reach, F.lit(0))).otherwise(0)
    last = F.when(long, F.least(F.size(each), middle + reach)).otherwise(F.size(each))
    shown = numbered(each, first, last)
    none = F.array().cast("array<string>")
    before = F.when(first > 0, F.array(F.concat(F.lit("// ... lines 1-"), first.cast("string"), F.lit(" omitted ...")))).otherwise(none)
    omitted = F.concat(F.lit("// ... lines "), (last + 1).cast("string"), F.lit("-"), F.size(each).cast("string"), F.lit(" omitted ..."))
    return F.array_join(F.concat(before, shown, F.when(last < F.size(each), F.array(omitted)).otherwise(none)), "\n")


def imports(text: Column, lang: str, most: int = 50) -> Column:
    if lang not in fixed.IMPORTS:
        return F.array().cast("array<string>")
    found = F.regexp_extract_all(text, F.lit(f"({fixed.IMPORTS[lang]})"), F.lit(1))
    return F.slice(F.transform(found, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), 1, most)


def hash_split(key: Column, seed: str, share: float) -> Column:
    """Whether the key falls into the held-out share: the first 8 bytes of sha256(seed:key) as a fraction of 2^64."""
    first = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double")
    return first / 2.0**64 < share


def flow_text(path: Column) -> Column:
    """A flow path (source, sink, steps of file, line_number?, method, code) as text with numbered steps."""

    def line(s: Column, i: Column) -> Column:
        place = F.concat(s["file"], F.when(s["line_number"].isNotNull(), F.concat(F.lit(":"), s["line_number"].cast("string"))).otherwise(""))
        return F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". ["), place, F.lit("] ("), s["method"], F.lit(") "), s["code"])

    return F.concat_ws("\n", F.concat(F.lit("Source: "), path["source"]), F.concat(F.lit("Sink: "), path["sink"]), F.array_join(F.transform(path["steps"], line), "\n"))


def rate(part: Column, whole: Column, digits: int = 3) -> Column:
    """part / whole, 0 if whole is 0."""
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), digits)
