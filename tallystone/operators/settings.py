"""Configuration documents as tables of lines: comments and their keys, distilling, fixing, managed blocks, registries."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import unified_breaks
from ..sources.files import parse_sections

COMMENT = r"^\s*[#;]"


def document_lines(documents: DataFrame) -> DataFrame:
    """(doc, line, text) of documents (doc, text); lines from 1, the last one also where it is empty."""
    return documents.select("doc", F.posexplode(F.split(unified_breaks(F.col("text")), "\n", -1)).alias("at", "text")).select("doc", (F.col("at") + 1).alias("line"), "text")


def with_owner(lines: DataFrame, by: Sequence[str], order: str, is_comment: Column) -> DataFrame:
    """owner: the first line at or below each line that isn't a comment; null for what trails a document.

    A comment's owner is the line that its unbroken run of comments stands on.
    """
    # from the end backwards: a frame that reaches to the end is worked out anew for every row
    w = Window.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("owner", F.last(F.when(~is_comment, F.col(order)), ignorenulls=True).over(w))


def droppable(value: Column, default: Column, verified: Column, has_suffix: Column) -> Column:
    """A value says nothing where its default was verified and equals it; a severity behind the last colon doesn't count for options that may have one."""
    bare = lambda x: F.trim(F.when(has_suffix, F.regexp_replace(F.trim(x), ":[^:]*$", "")).otherwise(x))
    return F.coalesce(verified & (bare(value) == bare(default)), F.lit(False))


def distill(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """(doc, text, dropped): documents (doc, text) without what only repeats a verified default, nor the comments that stand on it.

    registry: (key, default, verified, has_suffix), one row a key.  Documents are files of
    settings: one is put together again in one row.
    """
    a = parse_sections(documents).join(registry, "key").where(droppable(F.col("value"), F.col("default"), F.col("verified"), F.col("has_suffix")))
    gone = a.select("doc", F.col("line").alias("owner")).distinct().withColumn("__gone", F.lit(1))
    lines = with_owner(document_lines(documents), ["doc"], "line", F.col("text").rlike(COMMENT))
    kept = lines.join(gone, ["doc", "owner"], "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("__gone").isNull(), F.struct("line", "text")))), lambda x: x["text"]), "\n")
    return kept.groupBy("doc").agg(text.alias("text"), F.count_if(F.col("__gone").isNotNull() & (F.col("line") == F.col("owner"))).alias("dropped"))


def agreeing(assignments: DataFrame, spellings: DataFrame) -> DataFrame:
    """(doc, line, value): lines to rewrite so that every spelling of an option says what its most specific one says.

    spellings: (key, option, rank), the least rank the most specific; a registry's few hundred rows.
    """
    a = assignments.join(F.broadcast(spellings), "key")
    best = a.groupBy("doc", "option").agg(F.min_by("value", F.struct("rank", "line")).alias("best"))
    return a.join(best, ["doc", "option"]).where("value <> best").select("doc", "line", "key", F.col("best").alias("value"))


def fixed(documents: DataFrame, spellings: DataFrame) -> DataFrame:
    """(doc, text) with agreeing spellings and a first line `root = true` where a document lacks one."""
    a = parse_sections(documents)
    new = agreeing(a, spellings).select("doc", "line", F.concat_ws(" = ", "key", "value").alias("new"))
    rooted = a.where("glob IS NULL AND key = 'root' AND lower(value) = 'true'").select("doc").distinct().withColumn("__root", F.lit(1))
    lines = document_lines(documents).join(new, ["doc", "line"], "left").select("doc", "line", F.coalesce("new", "text").alias("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    d = lines.groupBy("doc").agg(text.alias("text")).join(rooted, "doc", "left")
    return d.select("doc", F.when(F.col("__root").isNull(), F.concat(F.lit("root = true\n\n"), "text")).otherwise(F.col("text")).alias("text"))


BEGIN, END, LOCAL = "# managed:begin", "# managed:end", "# local"


def split_block(text: str) -> tuple[str | None, str, str]:
    """(mark, managed, local) of a document; without a whole block all of it is local."""
    lines = text.replace("\r\n", "\n").split("\n")
    begin = next((i for i, x in enumerate(lines) if x.startswith(BEGIN)), None)
    end = next((i for i, x in enumerate(lines) if x.startswith(END)), None)
    if begin is None or end is None or end < begin:
        return None, "", ended(text)
    at = next((i for i in range(end, len(lines)) if lines[i].startswith(LOCAL)), end) + 1
    return lines[begin][len(BEGIN) :].strip(), ended("\n".join(lines[begin + 1 : end])), ended("\n".join(lines[at:]).lstrip("\n"))


def ended(text: str) -> str:
    """LF only, one at the end, none for blank text."""
    t = text.replace("\r\n", "\n").rstrip("\n")
    return t + "\n" if t.strip() else ""


def assemble_block(managed: str, version: str, local: str) -> str:
    """The document of a managed and a local part; splitting it gives both back, so doing this again changes nothing."""
    payload = ended(managed)
    head = f"{BEGIN} {version} {hashlib.sha256(payload.encode()).hexdigest()[:16]}\n"
    return head + payload + f"{END}\n\n{LOCAL}\n" + ("\n" + ended(local) if local.strip() else "")


def without_root(local: str) -> tuple[str, bool]:
    """A local part without `root` before its first section, where it would override nothing."""
    out, preamble, found = [], True, False
    for x in local.split("\n"):
        preamble = preamble and not x.strip().startswith("[")
        if preamble and x.split("=")[0].strip().lower() == "root" and "=" in x:
            found = True
        else:
            out.append(x)
    return ("\n".join(out).lstrip("\n"), True) if found else (local, False)


def flag_bits(value: Column, groups: dict[str, int]) -> Column:
    """A comma-separated list of groups as bits; `all` is all of them, an unknown member adds nothing."""
    members = F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x))
    bits = sum((F.when(F.array_contains(members, g), F.lit(b)).otherwise(F.lit(0)) for g, b in groups.items()), F.lit(0))
    return F.when(F.array_contains(members, "all"), F.lit(sum(groups.values()))).otherwise(bits)


def registry_changes(registry: DataFrame, probed: DataFrame, source: str = "probe") -> DataFrame:
    """(key, before, after, was): what verified probes (key, value, verdict) change in a registry (key, default, source)."""
    p = probed.where("verdict = 'Verified'").select("key", F.col("value").alias("after")).dropDuplicates(["key"])
    d = registry.join(p, "key")
    same = F.col("default").eqNullSafe(F.col("after")) & F.col("source").eqNullSafe(F.lit(source))
    return d.where(~same).select("key", F.col("default").alias("before"), "after", F.coalesce("source", F.lit("?")).alias("was"))


def patched_registry(registry: DataFrame, probed: DataFrame, source: str = "probe") -> DataFrame:
    """The registry after those changes; rows that none touches stay as they are."""
    c = registry_changes(registry, probed, source).select("key", "after", F.lit(True).alias("__new"))
    d = registry.join(c, "key", "left")
    return d.withColumns({"default": F.when(F.col("__new"), F.col("after")).otherwise(F.col("default")), "source": F.when(F.col("__new"), F.lit(source)).otherwise(F.col("source"))}).select(*registry.columns)
