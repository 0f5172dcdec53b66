"""Text columns: lines, words, markers, snippets, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKER = r"(?i)\b(?:TODO|FIXME)\b"
REFERENCE = r"#\d+|\b[A-Z][A-Z0-9]+-\d+\b|https?://"
TEST_PATH = r"(?i)(?:^|/)[^/]*(?:\.tests?(?:/|$)|\.tests\.)"


def unified_breaks(text: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def lines(text: Column) -> Column:
    """Array of lines; a final line break adds no line, an empty text has none."""
    parts = F.split(unified_breaks(text), "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_count(text: Column) -> Column:
    """Physical lines: a last empty one doesn't count; null is 0."""
    t = F.coalesce(text, F.lit(""))
    last = F.substring(t, -1, 1)
    return F.size(F.split(unified_breaks(t), "\n", -1)) - F.when((t == "") | last.isin("\n", "\r"), 1).otherwise(0)


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)


def marker_without_reference(line: Column, marker: str = MARKER, reference: str = REFERENCE) -> Column:
    """A marker with no issue number, key or address on the same line."""
    return line.rlike(marker) & ~line.rlike(reference)


def snippet(text: Column) -> Column:
    """White space collapsed; letters and digits untouched."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def is_test(path: Column, unit: Column) -> Column:
    """A unit or a path segment that ends in .Tests or .Test, or contains .Tests., in either case."""
    hit = lambda x: F.coalesce(x.rlike(r"(?i)\.tests?$|\.tests\."), F.lit(False))
    return hit(unit) | F.coalesce(F.exists(F.split(F.translate(path, "\\", "/"), "/"), hit), F.lit(False))


def display_path(path: Column, root: str) -> Column:
    """Relative to root, forward slashes, quoted where it holds a space."""
    p = F.translate(path, "\\", "/")
    p = F.when(p.startswith(root.rstrip("/") + "/"), F.substr(p, F.lit(len(root.rstrip("/")) + 2))).otherwise(p)
    return F.when(p.contains(" "), F.concat(F.lit('"'), p, F.lit('"'))).otherwise(p)


def line_column(text: Column, offset: Column) -> tuple[Column, Column]:
    """1-based line and column of a 0-based offset."""
    before = F.substr(text, F.lit(1), offset)
    line = F.size(F.split(before, "\n", -1))
    return line, F.char_length(F.element_at(F.split(before, "\n", -1), -1)) + 1


def well_formed_rule_id(x: Column, prefix: str) -> Column:
    return x.rlike(f"^{prefix}[0-9]{{4}}$")
