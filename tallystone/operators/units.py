"""Units that compile one file, nodes and their thresholds, fidelity, sets of members, and iteration to a fixed point."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import percent
from .relations import checkpoints


def paths_without(compiled: DataFrame, capable: DataFrame) -> DataFrame:
    """(path) of what some unit without the capability compiles; compiled: (unit, path), capable: (unit)."""
    return compiled.join(capable.select("unit").distinct(), "unit", "left_anti").select("path").distinct()


def units_by_path(compiled: DataFrame) -> DataFrame:
    """(path, n_units, first_unit) without gathering a path's units in one row."""
    return compiled.distinct().groupBy("path").agg(F.count(F.lit(1)).alias("n_units"), F.min("unit").alias("first_unit"))


def counterparts(nodes: DataFrame, others: DataFrame, key: Sequence[str], depth: str, item: str) -> DataFrame:
    """Each node with the deepest of the other unit's nodes of the same key (path, span and kind); nodes without one go."""
    best = others.groupBy(*key).agg(F.max_by(item, F.struct(depth, item)).alias("counterpart"))
    return nodes.join(best, list(key))


def over_threshold(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """measured: (path, metric, value), limits: (metric, rule_id, most), a catalogue's few rows.  Rows strictly over."""
    return measured.join(F.broadcast(limits), "metric").where("value > most")


def matching_lines(actual: Column, expected: Column) -> Column:
    """How many lines of two arrays are equal at the same place."""
    n = F.least(F.size(actual), F.size(expected))
    return F.size(F.filter(F.zip_with(F.slice(actual, F.lit(1), n), F.slice(expected, F.lit(1), n), lambda a, b: a == b), lambda same: same))


def fidelity(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """files: (lines, matched).  Share of lines and of whole files that match, in percent; 0 of nothing is 0."""
    d = files.groupBy(*by).agg(F.sum("lines").alias("lines"), F.sum("matched").alias("matched"), F.count(F.lit(1)).alias("files"), F.count_if(F.col("matched") == F.col("lines")).alias("whole"))
    return d.withColumns({"line_percent": percent(F.col("matched"), F.col("lines")), "file_percent": percent(F.col("whole"), F.col("files"))})


def counted_reasons(rows: DataFrame, reason: str, listed: Column) -> DataFrame:
    """(reason, n, to_list): how often each reason came, and how many of those must be shown one by one."""
    return rows.groupBy(reason).agg(F.count(F.lit(1)).alias("n"), F.count_if(listed).alias("to_list"))


def tiers(options: DataFrame, tier: str, honoured: Column) -> DataFrame:
    return options.groupBy(tier).agg(F.count(F.lit(1)).alias("n"), F.count_if(honoured).alias("honoured"))


def same_members(left: DataFrame, right: DataFrame, key: str, member: str) -> DataFrame:
    """(key, same) for keys on either side: both have the same set of members.  One shuffle, no array of members."""
    d = left.select(key, member, F.lit(1).alias("__l"), F.lit(0).alias("__r")).unionByName(right.select(key, member, F.lit(0).alias("__l"), F.lit(1).alias("__r")))
    d = d.groupBy(key, member).agg(F.max("__l").alias("__l"), F.max("__r").alias("__r"))
    return d.groupBy(key).agg(F.bool_and(F.col("__l") == F.col("__r")).alias("same"))


def members_or_none(rows: DataFrame, by: Sequence[str], member: str, unknown: Column) -> DataFrame:
    """(by, members): the sorted set of a type's members, null where any part of it is unknown.  Members are a type's few names."""
    return rows.groupBy(*by).agg(F.when(F.bool_or(unknown), F.lit(None)).otherwise(F.array_sort(F.collect_set(member))).alias("members"))


def candidates(files: DataFrame, path: str, lines: str, segments: Sequence[str], suffixes: Sequence[str], least: int, most: int) -> DataFrame:
    """Files that a draw may take: no excluded directory or suffix, least to most lines."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    out = F.exists(parts, lambda s: s.isin(*segments))
    for x in suffixes:
        out = out | F.col(path).endswith(x)
    return files.where(~out & F.col(lines).between(least, most))


def to_fixed_point(rows: DataFrame, key: str, state: str, step: Callable[[DataFrame], DataFrame], rounds: int = 16) -> DataFrame:
    """(key, state, passes, converged): applies step until it changes a row no more; the last pass of a row is the one that changes nothing.

    Rows that have settled leave the loop, so a round costs what is still moving.  Each
    round is checkpointed in the shared folder; what moves after `rounds` isn't converged.
    """
    checkpoints(rows.sparkSession)
    done, moving = None, rows.select(key, state)
    for i in range(1, rounds + 1):
        # grouped, not joined: a join multiplies size estimates, which checkpoints keep, so their digits would double each round
        side = lambda d, n: d.select(key, F.lit(n).alias("__n"), F.struct(F.col(state).alias("s")).alias("__s"))
        of = lambda n: F.first(F.when(F.col("__n") == n, F.col("__s")), ignorenulls=True)
        both = side(moving, 0).unionByName(side(step(moving), 1)).groupBy(key).agg(of(0).alias("__b"), of(1).alias("__a")).where(F.col(key).isNotNull() & F.col("__a").isNotNull() & F.col("__b").isNotNull())
        after = both.select(key, F.col("__a.s").alias(state), F.col("__a.s").eqNullSafe(F.col("__b.s")).alias("__same")).checkpoint()
        settled = after.where("__same").select(key, state, F.lit(i).alias("passes"), F.lit(True).alias("converged"))
        done = settled if done is None else done.unionByName(settled)
        moving = after.where("NOT __same").select(key, state)
        if moving.isEmpty():
            return done
    return done.unionByName(moving.select(key, state, F.lit(rounds).alias("passes"), F.lit(False).alias("converged")))
