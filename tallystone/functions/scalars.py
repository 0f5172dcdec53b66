"""Severities, shares, percentiles, draws, versions, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("none", "hint", "suggestion", "warning", "error")
_LEVEL = {"error": "error", "warning": "warning", "suggestion": "note", "hint": "note", "none": "none"}


def _choose(x: Column, table: dict[str, object], otherwise: Column) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(x == k, F.lit(v)) if out is None else out.when(x == k, F.lit(v))
    return out.otherwise(otherwise)


def severity_rank(word: Column) -> Column:
    """0 none .. 4 error; an unknown word counts as error, never as nothing."""
    return _choose(F.lower(word), {s: i for i, s in enumerate(SEVERITIES)}, F.lit(len(SEVERITIES) - 1))


def severity_word(word: Column) -> Column:
    """What a configuration may say: none, silent and refactoring (hint), suggestion, warning, error; else null."""
    return _choose(F.lower(word), {"none": "none", "silent": "hint", "refactoring": "hint", "suggestion": "suggestion", "warning": "warning", "error": "error"}, F.lit(None).cast("string"))


def report_level(word: Column) -> Column:
    """The level of a report, which merges suggestion and hint."""
    return _choose(F.lower(word), _LEVEL, F.lit("error"))


def severity_from_report(level: Column, exact: Column) -> Column:
    """The exact word wins; a bare level is read as far as it goes."""
    return F.coalesce(severity_word(exact), F.when(F.lower(exact) == "hint", "hint"), _choose(F.lower(level), {"error": "error", "warning": "warning", "note": "suggestion", "none": "none"}, F.lit("warning")))


def effective_severity(silenced: Column, explicit: Column, suffix: Column, bulk: Column, default: Column) -> Column:
    """Precedence: silenced, explicit, the option's suffix, bulk, default."""
    return F.when(F.coalesce(silenced, F.lit(False)), F.lit("none")).otherwise(F.coalesce(severity_word(explicit), severity_word(suffix), severity_word(bulk), default))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def nearest_rank(x: str, share: float) -> Column:
    """The ceil(share * n)-th smallest value, 0 for no rows; never interpolated."""
    return F.coalesce(F.expr(f"CAST(percentile_disc({share}D) WITHIN GROUP (ORDER BY {x}) AS BIGINT)"), F.lit(0).cast("bigint"))


def draw_key(seed: str, key: Column) -> Column:
    """The first 8 bytes of SHA-256(seed, line break, key) as 16 digits, which sort as the number does."""
    return F.substring(F.sha2(F.concat(F.lit(seed + "\n"), key), 256), 1, 16)


_SEMVER = r"^v?(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?$"


def version_parts(x: Column) -> Column:
    """struct<major, minor, patch, pre>; null where x is no version."""
    part = lambda i: F.regexp_extract(x, _SEMVER, i)
    return F.when(x.rlike(_SEMVER), F.struct(*(part(i + 1).cast("bigint").alias(n) for i, n in enumerate(("major", "minor", "patch"))), part(4).alias("pre")))


def version_order(x: Column) -> Column:
    """A sort key: numbers by value, a pre-release below its release, numeric identifiers below others, a shorter list below a longer."""
    v = version_parts(x)
    ids = F.transform(F.filter(F.split(v["pre"], r"\."), lambda i: i != ""), lambda i: F.when(i.rlike(r"^\d+$"), F.concat(F.lit("0"), F.lpad(F.char_length(i).cast("string"), 3, "0"), i)).otherwise(F.concat(F.lit("1"), i)))
    return F.struct(v["major"].alias("major"), v["minor"].alias("minor"), v["patch"].alias("patch"), (v["pre"] == "").alias("release"), ids.alias("ids"))


def next_version(x: Column, bump: Column) -> Column:
    """bump 3 major, 2 minor, 1 patch; a pre-release of that very version is promoted.  Null where x is no version."""
    v = version_parts(x)
    number = lambda *p: F.concat_ws(".", *p)
    patch = F.when(v["pre"] != "", v["patch"]).otherwise(v["patch"] + 1)
    out = F.when(bump >= 3, number(v["major"] + 1, F.lit(0), F.lit(0))).when(bump == 2, number(v["major"], v["minor"] + 1, F.lit(0))).otherwise(number(v["major"], v["minor"], patch))
    return F.when(v.isNotNull(), out)


def duration_seconds(start: Column, end: Column) -> Column:
    """end - start, 0 where that isn't positive."""
    return F.greatest(F.lit(0.0), F.unix_micros(end) / 1e6 - F.unix_micros(start) / 1e6)


def domain_bounds(kind: Column) -> Column:
    """struct<low, high> of an integral type's name as decimal(20,0); null for others."""
    out = None
    for name, bits, signed in (("sbyte", 8, 1), ("byte", 8, 0), ("short", 16, 1), ("ushort", 16, 0), ("int", 32, 1), ("uint", 32, 0), ("long", 64, 1), ("ulong", 64, 0), ("char", 16, 0)):
        low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
        pair = F.struct(F.expr(f"CAST('{low}' AS DECIMAL(20,0))").alias("low"), F.expr(f"CAST('{high}' AS DECIMAL(20,0))").alias("high"))
        out = F.when(kind == name, pair) if out is None else out.when(kind == name, pair)
    return out


def flipped(operator: Column) -> Column:
    """The comparison with its sides exchanged."""
    return _choose(operator, {"<": ">", ">": "<", "<=": ">=", ">=": "<="}, operator)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Closed intervals: touching counts."""
    return (b_start <= a_end) & (b_end >= a_start)


def allowed(rule: Column, include: list[str], exclude: list[str]) -> Column:
    """Nothing included means all; what is excluded stays out."""
    return (F.lit(not include) | rule.isin(include or [""])) & ~rule.isin(exclude or [""])
