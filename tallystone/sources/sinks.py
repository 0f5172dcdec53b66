"""Sinks: reports, baselines, histories, renderings.  Writes that would hide something refuse."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SEVERITIES


class Refused(Exception):
    """A write that isn't safe."""


def report_rows(findings: DataFrame) -> DataFrame:
    """A finding as a report's result; suppressions are kept."""
    words = F.element_at(F.lit(list(SEVERITIES)), F.col("severity") + 1)
    level = F.when(F.col("severity") >= 4, "error").when(F.col("severity") == 3, "warning").when(F.col("severity") >= 1, "note").otherwise("none")
    place = F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn"), F.col("end_line").alias("endLine"), F.col("end_column").alias("endColumn")).alias("region"))
    properties = F.struct(words.alias("severity"), F.col("enclosing_symbol").alias("enclosingSymbol"), "ordinal", F.col("in_changed_code").alias("inChangedCode"), "bucket", F.col("fix_is_safe").alias("fixIsSafe"))
    reason = lambda kind, why: F.array(F.struct(F.lit(kind).alias("kind"), F.lit(why).alias("justification")))
    held = F.when(F.col("suppression") != "None", reason("inSource", "source")).when(F.col("bucket") == "Existing", reason("external", "baseline"))
    return findings.select(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(F.struct(place.alias("physicalLocation"))).alias("locations"), properties.alias("properties"), F.coalesce(held, F.array().cast("array<struct<kind:string,justification:string>>")).alias("suppressions"))


def write_report(findings: DataFrame, path: str, open_path: str | None = None) -> None:
    """Results as JSON lines; a second file, if asked for, is the same without what is suppressed."""
    rows = report_rows(findings)
    rows.write.mode("overwrite").json(path)
    if open_path:
        rows.where(F.size("suppressions") == 0).write.mode("overwrite").json(open_path)


def write_document(findings: DataFrame, path: str, version: str, driver: dict | None = None, invocation: dict | None = None, name: str = "tallystone") -> None:
    """The report as one document with one run: its tool, one invocation and all results, as text in one file of the folder.

    driver and invocation are bags of properties; `start` and `end` of an invocation are its
    times in UTC.  A document is one file, so one task sorts and writes it, spilling to disk;
    write_report() writes results in many files.  No findings give an empty list.
    """
    told = dict(invocation or {})
    times = {k: told.pop(n) for n, k in (("start", "startTimeUtc"), ("end", "endTimeUtc")) if n in told}
    run = {"tool": {"driver": {"name": name, "version": version, "properties": driver or {}}}, "invocations": [{"executionSuccessful": True, **times, "properties": told}]}
    head = json.dumps({"version": "2.1.0", "runs": [run]})[: -len("}]}")] + ', "results": ['
    spark = findings.sparkSession
    ends = spark.createDataFrame([(0, head), (2, "]}]}")], "at int, value string")
    results = report_rows(findings).select(F.lit(1).alias("at"), F.to_json(F.struct("*")).alias("value"))
    order = Window.orderBy("at", "value")  # one file has one order, so one partition
    d = ends.unionByName(results).withColumn("before", F.lag("at").over(order))
    d.select(F.concat(F.when((F.col("at") == 1) & (F.col("before") == 1), ",").otherwise(""), "value").alias("value")).write.mode("overwrite").text(path)


def baseline(verb: str, found: DataFrame, accepted: DataFrame | None, unreadable: DataFrame, owned_elsewhere: list[str] = (), key: str = "fingerprint") -> DataFrame:
    """The baseline after create, update (never removes), prune (keeps what still fires) or show.

    Refuses over an incomplete tree; rules that arrangement owns are never held.
    """
    if verb != "show" and not unreadable.isEmpty():
        raise Refused("some files could not be read: a baseline of the rest would accept what was not seen")
    found = found.where(~F.col("rule_id").isin(list(owned_elsewhere) or [""])).select("rule_id", key)
    if verb == "create" or accepted is None:
        return found.distinct()
    if verb == "update":
        return accepted.select("rule_id", key).unionByName(found).distinct()
    if verb == "prune":
        return accepted.select("rule_id", key).join(found.select(key), key, "left_semi").select("rule_id", key)
    return accepted.select("rule_id", key)


def write_baseline(rows: DataFrame, path: str, apply: bool = False) -> bool:
    """Only with apply."""
    if apply:
        rows.write.mode("overwrite").parquet(path)
    return apply


def append_history(metrics: DataFrame, path: str) -> None:
    metrics.select(F.current_timestamp().alias("ts"), "name", "value").write.mode("append").json(path)


def trend(history: DataFrame, n: int = 20) -> DataFrame:
    """The last n rows of a history, newest first; with one metric a run, its last n runs.  last_runs() has whole runs."""
    return history.orderBy(F.desc("ts"), "name").limit(n)


def last_runs(history: DataFrame, n: int = 20) -> DataFrame:
    """All rows of the last n runs, newest first; a run is what was appended at one time, however many metrics it has."""
    runs = history.select("ts").distinct().orderBy(F.desc("ts")).limit(n)
    return history.join(F.broadcast(runs), "ts").orderBy(F.desc("ts"), "name")  # n rows


def lines(findings: DataFrame, style: str = "plain") -> DataFrame:
    """One rendered line a finding: plain, terminal, github, markdown, agent, json, or junit's test cases; for a report's short list."""
    words = F.element_at(F.lit(list(SEVERITIES)), F.col("severity") + 1)
    xml = lambda x: F.replace(F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    colour = F.when(F.col("severity") >= 4, "\x1b[31m").when(F.col("severity") == 3, "\x1b[33m").otherwise("\x1b[36m")
    shape = {
        "terminal": F.concat(F.format_string("%s(%d,%d): ", "path", "line", "column"), colour, words, F.lit("\x1b[0m "), F.col("rule_id"), F.lit(": "), F.col("message")),
        "json": F.to_json(F.struct("rule_id", words.alias("severity"), "path", "line", "column", "message")),
        "junit": F.format_string('<testcase classname="%s" name="%s"><failure type="%s" message="%s">%s:%d</failure></testcase>', xml(F.col("rule_id")), xml(F.col("path")), words, xml(F.col("message")), xml(F.col("path")), "line"),
        "plain": F.format_string("%s(%d,%d): %s %s: %s", "path", "line", "column", words, "rule_id", "message"),
        "github": F.format_string("::%s file=%s,line=%d,col=%d,title=%s::%s", F.when(F.col("severity") >= 4, "error").when(F.col("severity") == 3, "warning").otherwise("notice"), "path", "line", "column", "rule_id", "message"),
        "markdown": F.format_string("| %s | %s | `%s:%d` | %s |", words, "rule_id", "path", "line", F.replace(F.col("message"), F.lit("|"), F.lit("\\|"))),
        "agent": F.concat_ws("\t", "rule_id", words, F.format_string("%s:%d", "path", "line"), "message"),
    }[style]
    return findings.select(shape.alias("line"))


def summary_line(metrics: DataFrame) -> DataFrame:
    """All metrics in one line, by name; one that wasn't measured shows as a dash."""
    return metrics.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "value"))), lambda m: F.concat(m["name"], F.lit(" "), F.when(m["value"].isNull(), "-").otherwise(F.format_string("%.1f", m["value"])))), ", ").alias("line"))


def exit_code(passed: bool, incomplete: bool = False, bad_settings: bool = False, crashed: bool = False, nothing_loaded: bool = False, cancelled: bool = False) -> int:
    """0 passed, 1 the gate failed, 2 incomplete input, 3 bad settings, 4 nothing could be loaded, 5 a crash, 130 cancelled; the gravest wins."""
    return 130 if cancelled else 5 if crashed else 4 if nothing_loaded else 3 if bad_settings else 2 if incomplete else 0 if passed else 1


def shortened(values, k: int = 25):
    """struct<shown, more>."""
    return F.struct(F.slice(values, 1, k).alias("shown"), F.greatest(F.size(values) - k, F.lit(0)).alias("more"))


def release_notes(changes: DataFrame, verdict: DataFrame, most: int = 25) -> DataFrame:
    """(surface, at, line) of a release's notes: a heading, up to `most` changes by key, and how many more there are.

    changes: (surface, key, state), verdict: one row with next.  Lines are for a reader, so
    a surface's list is cut by row_number() and never gathered.
    """
    order = Window.partitionBy("surface").orderBy("key")
    d = changes.withColumn("at", F.row_number().over(order))
    shown = d.where(F.col("at") <= most).select("surface", "at", F.format_string("- %s: %s", "key", "state").alias("line"))
    n = changes.groupBy("surface").agg(F.count(F.lit(1)).alias("n"))
    head = n.crossJoin(F.broadcast(verdict.select("next"))).select("surface", F.lit(0).alias("at"), F.format_string("## %s: %s", "next", "surface").alias("line"))
    rest = n.where(F.col("n") > most).select("surface", F.lit(most + 1).alias("at"), F.format_string("- and %d more", F.col("n") - most).alias("line"))
    return head.unionByName(shown).unionByName(rest)


def write_sweep_archive(rows: DataFrame, path: str) -> None:
    """One JSON line a key with its values in order, sorted by key; rows: (key, value, oracle, ours, agree), a key's few values."""
    values = F.array_sort(F.collect_list(F.struct("value", "oracle", "ours", "agree")))
    rows.groupBy("key").agg(values.alias("values")).sort("key").write.mode("overwrite").json(path)
