"""Findings: their schema, the rules that make them, and what is done to a table of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a finding with their defaults; a rule gives those it knows.
DEFAULTS = {
    "rule_id": "string", "severity": "int", "message": "string", "path": "string", "line": "int", "column": "int", "end_line": "int", "end_column": "int",
    "start": "int", "length": "int", "fix": "array<struct<path:string,start:int,length:int,text:string>>", "fix_is_safe": "boolean",
    "target_frameworks": "array<string>", "suppression": "string", "in_changed_code": "boolean", "enclosing_symbol": "string", "snippet": "string", "ordinal": "int", "bucket": "string",
}
_VALUE = {"suppression": "None", "bucket": "Unknown"}
MERGE_KEY = ("rule_id", "path", "line", "column", "message")


def as_findings(df: DataFrame) -> DataFrame:
    """The full schema: columns that df lacks get their defaults (empty, 0, false; bucket Unknown)."""

    def default(name: str, kind: str) -> Column:
        if kind.startswith("array"):
            return F.array().cast(kind)
        return F.lit(_VALUE.get(name, "") if kind == "string" else 0 if kind == "int" else False).cast(kind)

    return df.select(*[(F.col(f"`{n}`").cast(k) if n in df.columns else default(n, k)).alias(n) for n, k in DEFAULTS.items()])


@dataclass(frozen=True)
class Rule:
    """A plug-in: from a table of files (path, text, ...) to findings.

    `where` is a predicate on a file or line, or makes one from the rule's options; `options`
    has their defaults, which a run may override by name.
    """

    rule_id: str
    severity: int
    message: str
    where: Column | Callable[[dict[str, int]], Column]
    per_line: bool = False
    needs_project: bool = False
    scope: str = "syntax"
    options: dict[str, int] = field(default_factory=dict)

    @property
    def cacheable(self) -> bool:
        """A file's findings depend on that file alone."""
        return self.scope != "compilation"

    def run(self, files: DataFrame, options: dict[str, int] | None = None) -> DataFrame:
        if unknown := set(options or {}) - set(self.options):
            raise ValueError(f"{self.rule_id} has no option {', '.join(sorted(unknown))}")
        where = self.where if isinstance(self.where, Column) else self.where(self.options | (options or {}))
        if self.per_line:
            from ..functions.text import lines

            d = files.select("path", F.posexplode(lines(F.col("text"))).alias("at", "line_text")).where(where)
            got = d.select("path", (F.col("at") + 1).alias("line"), F.col("line_text").alias("snippet"))
        else:
            got = files.where(where).select("path", F.lit(1).alias("line"))
        return as_findings(got.withColumns({"rule_id": F.lit(self.rule_id), "severity": F.lit(self.severity), "message": F.lit(self.message)}))


def run_rules(files: DataFrame, rules: list[Rule], with_project: bool = True, options: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """One union of all rules' findings; those that need a project are left out of the plan without one.  options: by rule_id."""
    parts = [r.run(files, (options or {}).get(r.rule_id)) for r in rules if with_project or not r.needs_project]
    return reduce(DataFrame.unionByName, parts)


def skipped_rules(spark, rules: list[Rule], with_project: bool) -> DataFrame:
    rows = [(r.rule_id, "needs a project") for r in rules if r.needs_project and not with_project]
    return spark.createDataFrame(rows, "rule_id string, reason string").distinct()


def merge_targets(findings: DataFrame, key: tuple[str, ...] = MERGE_KEY, target: str = "target") -> DataFrame:
    """One row a key, with the sorted set of its targets and how often it came."""
    return findings.groupBy(*key).agg(F.array_sort(F.collect_set(target)).alias("targets"), F.count(F.lit(1)).alias("merged"))


def with_ordinals(findings: DataFrame) -> DataFrame:
    """Counts from 0 the findings that look alike in one symbol, or in one file where there is no symbol."""
    place = F.coalesce(F.nullif("enclosing_symbol", F.lit("")), "path")
    w = Window.partitionBy("rule_id", place, "snippet").orderBy("path", "start", "line")
    return findings.withColumn("ordinal", F.row_number().over(w) - 1)


def fingerprint() -> Column:
    """Stable while lines move: rule, place, snippet without white space runs, ordinal."""
    place = F.coalesce(F.nullif("enclosing_symbol", F.lit("")), "path")
    return F.sha2(F.concat_ws("\n", "rule_id", place, F.trim(F.regexp_replace("snippet", r"\s+", " ")), F.col("ordinal").cast("string")), 256)


def baseline_buckets(findings: DataFrame, baseline: DataFrame | None, key: str = "fingerprint") -> DataFrame:
    """Existing or New by the baseline; Unknown where none was loaded."""
    if baseline is None:
        return findings.withColumn("bucket", F.lit("Unknown"))
    known = baseline.select(key).distinct().withColumn("__known", F.lit(True))
    return findings.join(known, key, "left").withColumn("bucket", F.when(F.col("__known"), "Existing").otherwise("New")).drop("__known")


def baseline_fixed(baseline: DataFrame, findings: DataFrame, rules_run: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Accepted entries that fire no more, of rules that ran: silence of a rule that didn't run proves nothing."""
    return baseline.join(findings.select(key).distinct(), key, "left_anti").join(rules_run.select("rule_id").distinct(), "rule_id", "left_semi")


def suppression_audit(now: DataFrame, reference: DataFrame | None, key: tuple[str, ...] = ("source", "rule", "place", "detail")) -> DataFrame:
    """change, key: added and removed suppressions.  Without a reference all are current and nothing gates."""
    if reference is None:
        return now.select(F.lit("current").alias("change"), *key).distinct()
    a, b = now.select(*key).distinct(), reference.select(*key).distinct()
    return a.join(b, list(key), "left_anti").select(F.lit("added").alias("change"), *key).unionByName(b.join(a, list(key), "left_anti").select(F.lit("removed").alias("change"), *key))


def mark_superseded(findings: DataFrame, supersedes: DataFrame, place: tuple[str, ...] = ("path", "line", "column")) -> DataFrame:
    """Sets suppression to Superseded where a rule that supersedes this one fired at the same place; a superseded winner still wins.

    supersedes: (winner, loser), a catalogue's few hundred rows, compared without case.
    """
    few = F.broadcast(supersedes.select(F.upper("winner").alias("__winner"), F.upper("loser").alias("__loser")))
    won = findings.select(*place, F.upper("rule_id").alias("__winner")).join(few, "__winner").select(*place, "__loser").distinct().withColumn("__lost", F.lit(True))
    out = findings.withColumn("__loser", F.upper("rule_id")).join(won, [*place, "__loser"], "left")
    return out.withColumn("suppression", F.when(F.col("__lost"), "Superseded").otherwise(F.col("suppression"))).drop("__lost", "__loser")


def language_floor(findings: DataFrame, required: DataFrame, floors: DataFrame) -> DataFrame:
    """Drops a finding only where its rule's floor and its path's are known and the path's lowest is below."""
    d = findings.join(required, "rule_id", "left").join(floors, "path", "left")
    return d.where("lowest IS NULL OR required IS NULL OR lowest >= required").select(*findings.columns)


def scoped_severity(findings: DataFrame, overrides: DataFrame) -> DataFrame:
    """overrides: (rule_id, path, override), override none drops the row; without one a finding keeps its severity."""
    d = findings.join(overrides, ["rule_id", "path"], "left")
    return d.where("override IS NULL OR override <> 0").withColumn("severity", F.coalesce("override", "severity")).drop("override")


def in_changed_code(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Marks findings whose line is in a changed range (path, from_line, to_line) of their path.

    Ranges of one path are apart, so a finding has one at most; the equi-join on path keeps this a hash or merge join.
    """
    d = findings.drop("in_changed_code").join(ranges.withColumnRenamed("path", "__path"), (F.col("path") == F.col("__path")) & F.col("line").between(F.col("from_line"), F.col("to_line")), "left")
    return d.withColumn("in_changed_code", F.col("__path").isNotNull()).drop("__path", "from_line", "to_line")
