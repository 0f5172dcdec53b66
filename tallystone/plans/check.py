"""The whole check: files to findings to a verdict, and the plan of a release."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import next_version
from ..operators import findings as fd
from ..operators import relations as rl


def check(files: DataFrame, rules: list[fd.Rule], supersedes: DataFrame, overrides: DataFrame | None = None, baseline: DataFrame | None = None, changed: DataFrame | None = None, with_project: bool = True) -> DataFrame:
    """Findings of all rules: one a key, superseded ones marked, severities scoped, with ordinals, fingerprints, buckets and changed code."""
    d = fd.run_rules(files, rules, with_project)
    d = d.dropDuplicates(list(fd.MERGE_KEY))
    d = fd.mark_superseded(d, supersedes)
    if overrides is not None:
        d = fd.scoped_severity(d, overrides).select(*fd.DEFAULTS)
    d = fd.with_ordinals(d).withColumn("fingerprint", fd.fingerprint())
    d = fd.baseline_buckets(d.drop("bucket"), baseline)
    return fd.in_changed_code(d, changed) if changed is not None else d


def gate_inputs(findings: DataFrame, metrics: DataFrame) -> DataFrame:
    """metrics with newIssues (null without a baseline, so that its gate can't fire) and maxSeverity.

    With a baseline maxSeverity judges new findings only; what is superseded or suppressed doesn't count.
    """
    d = findings.where("suppression = 'None'")
    known = F.max(F.col("bucket") != "Unknown")
    own = d.agg(
        F.when(F.coalesce(known, F.lit(False)), F.count_if(F.col("bucket") == "New")).cast("double").alias("newIssues"),
        F.coalesce(F.max(F.when(F.col("bucket") != "Existing", F.col("severity"))), F.lit(0)).cast("double").alias("maxSeverity"),
    )
    return metrics.unionByName(rl.unpivot_metrics(own, ["newIssues", "maxSeverity"]))


def release(surfaces: dict[str, tuple[DataFrame, DataFrame, str, list[str]]], version: str) -> tuple[DataFrame, DataFrame]:
    """(changes, verdict): the changes of each surface, and one row with the highest bump and the next version."""
    changes = None
    for name, (before, after, key, compared) in surfaces.items():
        d = rl.snapshot_diff(before, after, key, compared).select(F.lit(name).alias("surface"), F.col(key).cast("string").alias("key"), "state", "bump")
        changes = d if changes is None else changes.unionByName(d)
    verdict = rl.highest_bump(changes).withColumn("next", next_version(F.lit(version), F.col("bump")))
    return changes, verdict
