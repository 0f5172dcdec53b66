"""Operators over any table: metrics and gates, snapshots, configuration, clones, sweeps, recursion."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import draw_key, nearest_rank, percent
from ..session import dealt, parts_of

# metrics and gate


def fold_metrics(members: DataFrame, by: Sequence[str] = (), measures: Sequence[str] = ("value",)) -> DataFrame:
    """Count, 95th percentile by nearest rank and maximum of each measure; zeros for no rows."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in measures:
        aggs += [nearest_rank(m, 0.95).alias(f"p95_{m}"), F.coalesce(F.max(m), F.lit(0)).cast("bigint").alias(f"max_{m}")]
    return members.groupBy(*by).agg(*aggs)


def unpivot_metrics(summary: DataFrame, names: Sequence[str]) -> DataFrame:
    """(name, value), null where not measured."""
    pairs = ", ".join(f"'{n}', CAST(`{n}` AS DOUBLE)" for n in names)
    return summary.selectExpr(f"stack({len(names)}, {pairs}) AS (name, value)")


FLOORS = ("commentDensity",)


def evaluate_gate(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(name, bound, value, state): pass, fail or unknown; ceilings, but floors for densities.

    A metric that isn't known or wasn't measured is reported and never passes.
    """
    d = thresholds.join(metrics, "name", "left")
    ok = F.when(F.col("name").isin(*FLOORS), F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound"))
    return d.select("name", "bound", "value", F.when(F.col("value").isNull(), "unknown").when(ok, "pass").otherwise("fail").alias("state"))


def gate_passes(states: DataFrame) -> DataFrame:
    """One row: passed, exit_code (0 or 1)."""
    ok = F.coalesce(F.bool_and(F.col("state") == "pass"), F.lit(True))
    return states.agg(ok.alias("passed"), F.when(ok, 0).otherwise(1).alias("exit_code"))


def duplication(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """lines: (group columns, path, line, duplicated).  Distinct duplicated lines in percent of all; 0 without lines."""
    d = lines.groupBy(*by, "path", "line").agg(F.max(F.col("duplicated").cast("int")).alias("dup"))
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("total_lines"), F.sum("dup").cast("bigint").alias("duplicated_lines")).withColumn("percent", percent(F.col("duplicated_lines"), F.col("total_lines")))


def duplication_of(lines: DataFrame, by: Sequence[str], content: str) -> DataFrame:
    """lines: (group columns, content), a row a line.  Like duplication(), with every row a line of its own and a line duplicated where its content comes twice in any group.

    Lines are counted by content on the map side first, so one that is everywhere travels as a number.
    """
    d = lines.groupBy(*by, content).agg(F.count(F.lit(1)).alias("__n"))
    twice = F.col(content).isNotNull() & (F.sum("__n").over(Window.partitionBy(content)) > 1)
    d = d.withColumn("__dup", F.when(twice, F.col("__n")).otherwise(0))
    return d.groupBy(*by).agg(F.sum("__n").alias("total_lines"), F.sum("__dup").alias("duplicated_lines")).withColumn("percent", percent(F.col("duplicated_lines"), F.col("total_lines")))


# snapshots and releases


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, compared: Sequence[str]) -> DataFrame:
    """(key, state, bump): removed and changed 3, added 2; unchanged rows go."""
    b = before.select(key, F.struct(*compared).alias("__b"))
    a = after.select(key, F.struct(*compared).alias("__a"))
    state = F.when(F.col("__a").isNull(), "removed").when(F.col("__b").isNull(), "added").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return b.join(a, key, "full_outer").select(key, state.alias("state")).where("state is not null").withColumn("bump", F.when(F.col("state") == "added", 2).otherwise(3))


def highest_bump(diffs: DataFrame) -> DataFrame:
    """The largest bump, a patch for none; what wasn't measured adds nothing."""
    return diffs.agg(F.greatest(F.coalesce(F.max("bump"), F.lit(1)), F.lit(1)).alias("bump"), F.coalesce(F.bool_or(F.col("bump").isNotNull()), F.lit(False)).alias("measured"))


def first_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows with the number that is left out: a report's short list."""
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    return df.orderBy(*order).limit(k).crossJoin(F.broadcast(total)).withColumn("more", F.greatest(F.col("__n") - k, F.lit(0))).drop("__n")


def draw(df: DataFrame, seed: str, key: Column, n: int) -> DataFrame:
    """n rows in the order of a seeded hash of their key: the same rows whatever the partitioning."""
    return df.withColumn("draw", draw_key(seed, key)).orderBy("draw", key).limit(n)


# configuration


def ranked(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """df with each row's place, from 1, in one order over all rows, without sorting them in one task.

    Rows are dealt to ranges and fixed there by a checkpoint; a place is the rows of the
    ranges before, of which there is one sum a range, and the row's number in its own.
    """
    checkpoints(df.sparkSession)
    d = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).checkpoint()
    n = d.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = n.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return d.withColumn("__own", own).join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__own")).drop("__range", "__own", "__before")


def last_wins(assignments: DataFrame, key: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """The value set last in order, for each key."""
    return assignments.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value))


def most_specific(assignments: DataFrame, key: Sequence[str], rank: str, value: str) -> DataFrame:
    return assignments.groupBy(*key).agg(F.min_by(value, F.struct(rank, value)).alias(value))


def fill_forward(rows: DataFrame, by: Sequence[str], order: Sequence[str], header: Column, name: str) -> DataFrame:
    """The last header at or before each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(header, ignorenulls=True).over(w))


def ancestors(path: Column) -> Column:
    """All directories above a path, outermost first, the root as an empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def config_chain(files: DataFrame, documents: DataFrame) -> DataFrame:
    """(path, dir, depth): the documents (dir, is_root) above each file, from the nearest root document inwards."""
    up = files.select("path", F.posexplode(ancestors(F.col("path"))).alias("depth", "dir"))
    d = up.join(documents.select("dir", "is_root"), "dir")
    w = Window.partitionBy("path")
    d = d.withColumn("__root", F.coalesce(F.max(F.when(F.col("is_root"), F.col("depth"))).over(w), F.lit(0)))
    return d.where("depth >= __root").select("path", "dir", "depth")


def glob_regex(glob: str) -> str:
    """A section's glob as an anchored regular expression: * ** ? [..] [!..] {a,b} {1..3}."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i):
            out.append(".*")
            i += 1
        elif c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (j := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : j]
            out.append(f"[{'^' + body[1:] if body[0] in '!^' else body}]".replace("\\", "\\\\"))
            i = j
        elif c == "{" and (j := glob.find("}", i)) > 0:
            body = glob[i + 1 : j].split("..")
            if len(body) == 2 and all(x.lstrip("-").isdigit() for x in body):
                low, high = sorted(map(int, body))
                out.append("(?:" + "|".join(map(str, range(low, high + 1))) + ")")
                i = j
            else:
                out.append("(?:")
                depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append("\\" + glob[i])
        else:
            out.append(c if c.isalnum() or c in "/_-" else "\\" + c)
        i += 1
    anchored = "".join(out)
    return f"^{anchored}$" if "/" in glob.strip("/") or glob.startswith("/") else f"^(?:.*/)?{anchored}$"


def not_excluded(path: Column, globs: Sequence[str], built_in: Sequence[str] = ("bin", "obj", "node_modules", ".git")) -> Column:
    """Built-in directories anywhere, declared globs from the repository's root."""
    hit = F.exists(F.split(path, "/"), lambda s: s.isin(*built_in))
    for g in globs:
        hit = hit | path.rlike("^" + glob_regex("/" + g.lstrip("/")).removeprefix("^/"))
    return ~hit


def section_value(path: Column, sections: Sequence[tuple[str, str]]) -> Column:
    """The value of the last section whose glob a path matches, as later ones win; null where none does.

    Sections are a document's few; each path is looked at where it is read, so nothing is joined or shuffled.
    """
    return F.coalesce(*[F.when(path.rlike(glob_regex(g)), F.lit(v)) for g, v in reversed(sections)], F.lit(None).cast("string"))


# groups


def siblings(units: DataFrame, key: str, item: str) -> DataFrame:
    """(item, key, n_siblings, a_sibling) for members of groups with more than one; a null or empty key groups nothing."""
    known = units.where((F.col(key).isNotNull()) & (F.col(key).cast("string") != ""))
    g = known.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.min(item).alias("__lo"), F.max(item).alias("__hi")).where("__n > 1")
    return known.select(item, key).join(g, key).select(item, key, (F.col("__n") - 1).alias("n_siblings"), F.when(F.col(item) == F.col("__lo"), F.col("__hi")).otherwise(F.col("__lo")).alias("a_sibling"))


def repeated_values(values: DataFrame, by: str, value: str, position: str, more_than: int) -> DataFrame:
    """(by, value, n, first) of values that a group has more often than more_than; summed on the map side."""
    return values.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first")).where(F.col("n") > more_than)


def repeats_in_order(rows: DataFrame, chain: Sequence[str], order: Sequence[str], value: str, position: str) -> DataFrame:
    """Every later element that equals an earlier one of its chain, with the first one's position."""
    w = Window.partitionBy(*chain, value).orderBy(*order)
    return rows.withColumns({"__k": F.row_number().over(w), "first_position": F.first(position).over(w)}).where("__k > 1").drop("__k")


def shingles(tokens: Column, k: int) -> Column:
    """Runs of k tokens.  The array is bound first: a lambda would work it out again for every run."""
    runs = lambda t: F.when(F.size(t) >= k, F.transform(F.sequence(F.lit(0), F.size(t) - k), lambda i: F.slice(t, i + 1, F.lit(k)))).otherwise(F.array().cast("array<array<string>>"))
    return F.transform(F.array(tokens), runs)[0]


def run_hashes(tokens: Column, k: int) -> Column:
    """array<struct<h1, h2>>: two independent 64-bit hashes of every run of k tokens.

    A token is hashed once; its runs are slices of longs, and only their hashes leave the row.
    """

    def runs(t: Column) -> Column:
        part = lambda i: F.slice(t, i + 1, F.lit(k))
        some = F.transform(F.sequence(F.lit(0), F.size(t) - k), lambda i: F.struct(F.xxhash64(part(i)).alias("h1"), F.xxhash64(F.lit("second"), part(i)).alias("h2")))
        return F.when(F.size(t) >= k, some).otherwise(F.array().cast("array<struct<h1:bigint,h2:bigint>>"))

    return F.transform(F.array(F.transform(tokens, lambda w: F.xxhash64(w))), runs)[0]


def clone_groups(docs: DataFrame, path: str, tokens: Column, k: int) -> DataFrame:
    """(first_path, first_pos, occurrences, across) of every run of k tokens that occurs twice or more.

    Hashes travel instead of the tokens: 128 bits a run, and its place.  Most runs occur once,
    so nothing is combined before they travel: that would sort every run twice, and make its
    row longer.  Each is sorted once, where it arrives.  Which runs belong together
    into longer clones is clone_extents()'s task.
    """
    d = docs.select(F.col(path).alias("path"), F.posexplode(run_hashes(tokens, k)).alias("pos", "h")).select("path", "pos", "h.*").repartition(parts_of(docs), "h1", "h2")
    g = d.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("occurrences"), F.min(F.struct("path", "pos")).alias("f"), F.min("path").alias("lo"), F.max("path").alias("hi"))
    return g.where("occurrences > 1").select(F.col("f.path").alias("first_path"), F.col("f.pos").alias("first_pos"), "occurrences", (F.col("lo") != F.col("hi")).alias("across"))


def clone_extents(matches: DataFrame) -> DataFrame:
    """Merge matching runs (a, b, pos_a, pos_b) of two paths into longest ones: an island has one pos_a - pos_b and no gap."""
    d = matches.withColumn("__d", F.col("pos_a") - F.col("pos_b"))
    w = Window.partitionBy("a", "b", "__d").orderBy("pos_a")
    d = d.withColumn("__i", F.col("pos_a") - F.row_number().over(w))
    return d.groupBy("a", "b", "__d", "__i").agg(F.min("pos_a").alias("from_a"), F.min("pos_b").alias("from_b"), F.count(F.lit(1)).alias("runs")).drop("__d", "__i")


# sweeps


def classify_sweep(rows: DataFrame, key: Sequence[str], theirs: str, ours: str, agree: Column) -> DataFrame:
    """By how many outputs each side has and whether all agree.

    Rows are dealt by key, in parts that follow the table's size, and counted there.  A key's
    few outputs are gathered, as counts of distinct ones would triple the rows and shuffle twice.
    """
    some = lambda c: F.size(F.collect_set(c)).cast("bigint")
    r = dealt(rows.select(*key, F.col(theirs).alias("__t"), F.col(ours).alias("__o"), agree.alias("__agree")), *key)
    d = r.groupBy(*key).agg(some("__t").alias("theirs"), some("__o").alias("ours"), F.count_if(~F.col("__agree")).alias("differ"))
    outcome = F.when((F.col("theirs") <= 1) & (F.col("ours") <= 1), "Unexercised").when(F.col("ours") <= 1, "Inert").when(F.col("theirs") <= 1, "Spurious").when(F.col("differ") == 0, "Conformant").otherwise("Divergent")
    return d.withColumn("outcome", outcome)


def classify_pairs(rows: DataFrame, key: Sequence[str], agree: Column, baseline: Column, reached: Column, attributable: Column, outputs: str) -> DataFrame:
    """The first that holds: baseline, unexercised, conformant, inherited (all of the rest), divergent (any), interaction only.

    Rows are dealt by key, in parts that follow the table's size.  One output at most is
    a smallest that is the largest: a count of distinct ones would group every row twice more.
    """
    r = dealt(rows.select(*key, agree.alias("__agree"), baseline.alias("__base"), F.when(~agree, attributable).alias("__inherited"), F.when(~agree, reached).alias("__seen"), F.col(outputs).alias("__out")), *key)
    d = r.groupBy(*key).agg(
        F.bool_and("__base").alias("base"), F.min("__out").alias("least"), F.max("__out").alias("most"), F.bool_and("__agree").alias("same"),
        F.coalesce(F.bool_and("__inherited"), F.lit(True)).alias("inherited"), F.coalesce(F.bool_or("__seen"), F.lit(False)).alias("seen"),
    )
    one = F.col("least").eqNullSafe(F.col("most"))
    outcome = F.when(~F.col("base"), "BaselineDiffers").when(one, "Unexercised").when(F.col("same"), "Conformant").when(F.col("inherited"), "Inherited").when(F.col("seen"), "Divergent").otherwise("InteractionOnly")
    return d.select(*key, outcome.alias("outcome"))


def pairwise_plan(options: DataFrame) -> DataFrame:
    """(family, first, second, corners, reason) of a family's option pairs; options: (family, option, n_values, honoured), a registry's few hundred rows."""
    a = options.select("family", F.col("option").alias("first"), F.col("n_values").alias("n1"), F.col("honoured").alias("h1"))
    b = options.select("family", F.col("option").alias("second"), F.col("n_values").alias("n2"), F.col("honoured").alias("h2"))
    d = a.join(b, "family").where("first < second")
    reason = F.when(~F.col("h1") | ~F.col("h2"), "not honoured").when((F.col("n1") < 2) | (F.col("n2") < 2), "one value").otherwise("")
    return d.select("family", "first", "second", (F.col("n1") * F.col("n2")).cast("bigint").alias("corners"), reason.alias("reason"))


def assignments_of(df: DataFrame, symbols: str, most: int = 8) -> DataFrame:
    """Every on/off assignment of a row's symbols, as a bit mask; none for more than `most` symbols, which is the feature's bound."""
    n = F.size(symbols)
    return df.where((n > 0) & (n <= most)).withColumn("mask", F.explode(F.sequence(F.lit(0), F.expr(f"shiftleft(1, size({symbols})) - 1"))))


# recursion


def checkpoints(spark) -> None:
    """Use the cluster's checkpoint folder; on a local master, as in tests, one of our own where none is set, else an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tallystone-checkpoints-"))


def climbed(edges: DataFrame, child: str, parent: str, most: int) -> DataFrame:
    """(node, ancestor, depth) of every ancestor of every node, once for each length of a way there, however many ways there are.

    A round joins what the last one reached with the edges, and is checkpointed in the
    shared folder; only the frontier moves.  A circle, or more than `most` levels, is an error.
    """
    checkpoints(edges.sparkSession)
    e = edges.select(F.col(child).alias("__child"), F.col(parent).alias("__parent"))
    frontier = e.select(F.col("__child").alias("node"), F.col("__parent").alias("ancestor"), F.lit(1).alias("depth")).distinct().checkpoint()
    out = frontier
    for _ in range(most):
        up = frontier.join(e, frontier["ancestor"] == e["__child"])
        frontier = up.select("node", F.col("__parent").alias("ancestor"), (F.col("depth") + 1).alias("depth")).distinct().checkpoint()
        if frontier.isEmpty():
            return out
        out = out.unionByName(frontier)
    raise RuntimeError(f"more than {most} levels, or a circle")


def depth_to_root(edges: DataFrame, child: str, parent: str, most: int = 64) -> DataFrame:
    """(node, depth): steps from each node up to one without a parent; the longest of several ways."""
    return climbed(edges, child, parent, most).groupBy("node").agg(F.max("depth").alias("depth"))


def closure(edges: DataFrame, child: str, parent: str, most: int = 64) -> DataFrame:
    """(node, ancestor), each node that has a parent its own ancestor too."""
    own = edges.select(F.col(child).alias("node"), F.col(child).alias("ancestor"))
    return climbed(edges, child, parent, most).select("node", "ancestor").unionByName(own).distinct()


def reachable(sources: DataFrame, edges: DataFrame, sanitizers: DataFrame, rounds: int = 50) -> DataFrame:
    """Nodes that taint reaches along edges (src, dst) from sources (node), never through a sanitizer.

    Breadth first on new nodes only; each round's frontier is checkpointed in the shared folder,
    once: what was reached before is the union of the frontiers, and is never written again.
    """
    checkpoints(sources.sparkSession)
    clean = sanitizers.select("node")
    seen = frontier = sources.select("node").distinct().join(clean, "node", "left_anti").checkpoint()
    for _ in range(rounds):
        frontier = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(clean, "node", "left_anti").join(seen, "node", "left_anti").checkpoint()
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError("more rounds are needed")


# sets


def shape_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change) of two sets, both ways."""
    return before.select(key).subtract(after.select(key)).withColumn("change", F.lit("removed")).unionByName(after.select(key).subtract(before.select(key)).withColumn("change", F.lit("added")))


def overlap_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: both, left_only, right_only."""
    a = left.select(key).distinct().withColumn("__l", F.lit(1))
    b = right.select(key).distinct().withColumn("__r", F.lit(1))
    d = a.join(b, key, "full_outer")
    return d.agg(F.count_if(F.expr("__l = 1 AND __r = 1")).alias("both"), F.count_if(F.expr("__r IS NULL")).alias("left_only"), F.count_if(F.expr("__l IS NULL")).alias("right_only"))
