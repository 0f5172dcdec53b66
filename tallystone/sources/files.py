"""Sources: trees of text files, strict decoding, configuration files, reports, histories, catalogues, tables in documents."""

from __future__ import annotations

import codecs
import json
import re

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relations import fill_forward

#: UTF-32LE before UTF-16LE, whose mark it begins with.
MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


def decode(data: bytes) -> tuple[str | None, str, int, int]:
    """(text, encoding, first bad byte, its line); text is None where a byte is bad, and then offset and line say where."""
    mark, name = next(((m, n) for m, n in MARKS if data.startswith(m)), (b"", "utf-8"))
    try:
        return data[len(mark) :].decode(name), name, -1, -1
    except UnicodeDecodeError as e:
        before = data[len(mark) : len(mark) + e.start].decode(name, "ignore")
        return None, name, len(mark) + e.start, before.count("\n") + 1


DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType()), T.StructField("bad_offset", T.IntegerType()), T.StructField("bad_line", T.IntegerType())])


@F.pandas_udf(DECODED)
def decoded(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode(bytes(x)) if x is not None else (None, "", -1, -1) for x in data], columns=["text", "encoding", "bad_offset", "bad_line"])


def scan(spark: SparkSession, roots: list[str], suffix: str = ".cs", generated: str = r"(?i)\.(?:g|generated|designer)\.[^.]+$") -> DataFrame:
    """(path, text, encoding, bad_offset, bad_line, is_generated) of all files below the roots, each path once.

    Files that vanish meanwhile are passed over; one that can't be read fails the job, it isn't left out silently.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").option("ignoreMissingFiles", "true").load(roots)
    d = raw.select("path", "content").dropDuplicates(["path"]).withColumn("d", decoded("content"))
    return d.select("path", "d.*", F.col("path").rlike(generated).alias("is_generated"))


def unreadable(files: DataFrame) -> DataFrame:
    return files.where("text is null").select("path", "bad_offset", "bad_line").distinct()


def first_that_loads(readers: list[tuple[str, object]], named: str | None = None) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """The first reader with rows, and why each before it was passed over; a reader that was named must not fail."""
    passed = []
    for name, read in readers:
        if named and name != named:
            continue
        try:
            got = read()
            if not got.isEmpty():
                return got, passed
            passed.append((name, "empty"))
        except (OSError, ValueError, PySparkException) as e:  # what reading can meet; an error of the reader's own is none of these
            if named:
                raise
            passed.append((name, str(e).splitlines()[0]))
    return None, passed


REPORT = (
    "runs array<struct<tool:struct<driver:struct<name:string,version:string,properties:variant>>,"
    "invocations:array<struct<startTimeUtc:timestamp,endTimeUtc:timestamp,properties:variant>>,results:array<struct<ruleId:string,level:string,message:struct<text:string>,"
    "locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int,endLine:int,endColumn:int>>>>,"
    "properties:struct<severity:string,enclosingSymbol:string,ordinal:int,inChangedCode:boolean,bucket:string,fixIsSafe:boolean>,"
    "suppressions:array<struct<kind:string,justification:string>>>>>>"
)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a stored report's first run; the exact severity word wins over the level.

    A suppression by the baseline is not one in the source, and edits aren't rebuilt.
    """
    from ..functions.scalars import severity_from_report, severity_rank
    from ..operators.findings import as_findings

    r = spark.read.schema(REPORT).json(path, multiLine=True).select(F.explode(F.get("runs", F.lit(0))["results"]).alias("r"))
    at = F.get(F.col("r.locations"), F.lit(0))["physicalLocation"]
    own = F.get(F.filter("r.suppressions", lambda s: s["justification"] != "baseline"), F.lit(0))
    region = at["region"]
    d = r.select(
        F.col("r.ruleId").alias("rule_id"), severity_rank(severity_from_report(F.col("r.level"), F.col("r.properties.severity"))).alias("severity"), F.col("r.message.text").alias("message"),
        at["artifactLocation"]["uri"].alias("path"), region["startLine"].alias("line"), region["startColumn"].alias("column"), region["endLine"].alias("end_line"), region["endColumn"].alias("end_column"),
        F.coalesce("r.properties.fixIsSafe", F.lit(False)).alias("fix_is_safe"), F.coalesce(own["kind"], F.lit("None")).alias("suppression"), F.coalesce("r.properties.inChangedCode", F.lit(False)).alias("in_changed_code"),
        F.coalesce("r.properties.enclosingSymbol", F.lit("")).alias("enclosing_symbol"), F.coalesce("r.properties.ordinal", F.lit(0)).alias("ordinal"), F.coalesce("r.properties.bucket", F.lit("Unknown")).alias("bucket"),
    )
    return as_findings(d)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """One row for each stored report: what its first run says of itself.

    A property that is missing or of another type has its default; a run without a gate has
    a null gate; seconds are 0 unless the end is after the start.  A report without runs is an error.
    """
    r = spark.read.schema(REPORT).json(path, multiLine=True).select(F.get("runs", F.lit(0)).alias("run"))
    r = r.select(F.when(F.col("run").isNull(), F.raise_error(F.lit("a report has no runs"))).otherwise(F.col("run")).alias("run"))
    r = r.select(F.col("run.tool.driver").alias("driver"), F.get("run.invocations", F.lit(0)).alias("invocation"))
    written_as = {"boolean": "BOOLEAN", "int": "BIGINT", "string": "STRING", "array<string>": "ARRAY<STRING>"}  # a cast alone would take "yes" for true

    def own(bag: str, name: str, kind: str, default: Column) -> Column:
        at = F.col(f"{bag}.properties")
        same = F.schema_of_variant(F.try_variant_get(at, f"$.{name}", "variant")) == written_as[kind]
        return F.coalesce(F.when(same, F.try_variant_get(at, f"$.{name}", kind)), default).alias(name)

    gate = F.nullif(own("invocation", "gate", "string", F.lit("")), F.lit(""))
    took = F.unix_micros("invocation.endTimeUtc") - F.unix_micros("invocation.startTimeUtc")
    return r.select(
        F.col("driver.name").alias("tool"), F.col("driver.version").alias("version"), *(own("driver", n, "string", F.lit("")) for n in ("loadMode", "loadSummary", "configurationFingerprint")), own("driver", "optionOverridesActive", "boolean", F.lit(False)),
        *(own("invocation", n, "int", F.lit(0)) for n in ("fileCount", "lineCount")), own("invocation", "partial", "boolean", F.lit(False)), F.greatest(F.coalesce(took, F.lit(0)) / 1e6, F.lit(0.0)).alias("seconds"), gate.alias("gate"),
        F.when(gate.isNotNull(), own("invocation", "gatePassed", "boolean", F.lit(True))).alias("gatePassed"), F.when(gate.isNotNull(), own("invocation", "gateFailures", "array<string>", F.array().cast("array<string>"))).alias("gateFailures"),
    )


def property_or(bag: Column, path: str, kind: str, default: Column) -> Column:
    """A value of a JSON bag; the default where it is missing or of another type."""
    return F.coalesce(F.expr(f"try_variant_get({bag._jc.toString()}, '$.{path}', '{kind}')"), default)


_SECTION, _PAIR = r"^\s*\[(.*)\]\s*$", r"^\s*([^=:#;\[][^=:]*?)\s*[=:]\s*(.*?)\s*$"


def parse_sections(documents: DataFrame) -> DataFrame:
    """(doc, section, glob, key, value, line) of configuration documents (doc, text); keys in lower case, values as written.

    glob is null in the preamble, where `root` may stand.
    """
    from ..functions.text import unified_breaks

    d = documents.select("doc", F.posexplode(F.split(unified_breaks(F.col("text")), "\n", -1)).alias("at", "s"))
    d = d.where(~F.col("s").rlike(r"^\s*([#;].*)?$")).withColumn("header", F.when(F.col("s").rlike(_SECTION), F.struct(F.col("at").alias("section"), F.regexp_extract("s", _SECTION, 1).alias("glob"))))
    d = fill_forward(d, ["doc"], ["at"], F.col("header"), "h").where("header is null").where(F.col("s").rlike(_PAIR))
    return d.select("doc", F.coalesce("h.section", F.lit(-1)).alias("section"), F.col("h.glob").alias("glob"), F.lower(F.regexp_extract("s", _PAIR, 1)).alias("key"), F.regexp_extract("s", _PAIR, 2).alias("value"), (F.col("at") + 1).alias("line"))


def tool_settings(text: str) -> tuple[dict, list[str]]:
    """A commented JSON document; a malformed one gives no settings and a diagnostic, never an exception."""
    out, i, quoted = [], 0, False
    while i < len(text):
        c = text[i]
        if quoted:
            out.append(text[i : i + 2] if c == "\\" else c)
            i += 2 if c == "\\" else 1
            quoted = c != '"'
        elif text.startswith("//", i):
            i = (text.find("\n", i) + 1 or len(text) + 1) - 1
        elif text.startswith("/*", i):
            i = (text.find("*/", i) + 1 or len(text)) + 1
        else:
            quoted = c == '"'
            out.append(c)
            i += 1
    plain = "".join(out)
    plain = re.sub(r',(\s*[}\]])(?=(?:[^"\\]|\\.|"(?:[^"\\]|\\.)*")*$)', r"\1", plain)
    try:
        got = json.loads(plain)
    except ValueError as e:
        return {}, [f"settings are malformed: {e}"]
    return (got, []) if isinstance(got, dict) else ({}, ["settings are no object"])


def exclusions(settings: dict) -> list[str]:
    """Declared globs; anything but a list of strings excludes nothing more."""
    x = settings.get("exclude")
    return x if isinstance(x, list) and all(isinstance(g, str) for g in x) else []


def markdown_table(docs: DataFrame, row: str = r"^\|\s*(\d+)\s*\|\s*(.*?)\s*\|") -> DataFrame:
    """(key, meaning): the first row of a key wins."""
    d = docs.select(F.posexplode(F.split("text", "\n")).alias("at", "s")).where(F.col("s").rlike(row))
    return d.select("at", F.regexp_extract("s", row, 1).alias("key"), F.regexp_extract("s", row, 2).alias("meaning")).groupBy("key").agg(F.min_by("meaning", "at").alias("meaning"))


def xml_property(text: Column, name: str) -> Column:
    return F.xpath_string(text, F.lit(f"//{name}/text()"))


def catalogue(spark: SparkSession, rules: str, allocated: str) -> DataFrame:
    """Rules of a JSON array, each with whether its id is in the list of allocated ones."""
    ids = spark.read.text(allocated).select(F.trim("value").alias("id")).where("id <> '' AND id NOT LIKE '#%'").distinct().withColumn("allocated", F.lit(True))
    return spark.read.json(rules, multiLine=True).join(ids, "id", "left").withColumn("allocated", F.coalesce("allocated", F.lit(False)))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Options of {"options": [...]} by key, the last one of a key."""
    d = spark.read.json(path, multiLine=True).select(F.posexplode("options").alias("at", "o"))
    return d.groupBy(F.col("o.key").alias("key")).agg(F.max_by("o", "at").alias("option"))


def history(spark: SparkSession, path: str, schema: str = "ts timestamp, name string, value double") -> DataFrame:
    return spark.read.schema(schema).json(path)


def sweep_archive(spark: SparkSession, path: str) -> DataFrame:
    """(key, value, agree, oracle, ours) of an archive of keys with their values."""
    schema = "key string, values array<struct<value:string,oracle:string,ours:string,agree:boolean>>"
    return spark.read.schema(schema).json(path).select("key", F.explode("values").alias("v")).select("key", "v.*")
