"""Metrics, gates, snapshots, configuration, clones, sweeps and recursion, on small frames with the awkward cases."""

import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallystone.functions import scalars as sc
from tallystone.operators import relations as rl
from tallystone.operators import settings as se
from tallystone.operators import units as un
from tallystone.plans.catalogue import QUERIES


def rows(df, *names):
    return sorted((tuple(r[n] for n in names or df.columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 19, 20, 21, 100])
def test_nearest_rank(spark, n):
    got = spark.range(1, n + 1).agg(sc.nearest_rank("id", 0.95)).first()[0]
    assert got == (sorted(range(1, n + 1))[math.ceil(0.95 * n) - 1] if n else 0)


def test_fold_of_nothing(spark):
    assert rows(rl.fold_metrics(spark.createDataFrame([], "value int"))) == [(0, 0, 0)]


def test_gate_floors_ceilings_and_unknown(spark):
    m = spark.createDataFrame([("commentDensity", 60.0), ("duplication", 2.9), ("x", None)], "name string, value double")
    t = lambda *r: rl.evaluate_gate(m, spark.createDataFrame(r, "name string, bound double"))
    assert rows(t(("commentDensity", 61.0), ("duplication", 2.9), ("x", 1.0), ("y", 1.0)), "name", "state") == [("commentDensity", "fail"), ("duplication", "pass"), ("x", "unknown"), ("y", "unknown")]
    assert rl.gate_passes(t(("commentDensity", 60.0))).first()["passed"]
    assert rl.gate_passes(t(("duplication", 3.0))).first()["exit_code"] == 0


def test_duplication(spark):
    l = spark.createDataFrame([("t", "p", 1, True), ("t", "p", 1, True), ("t", "p", 2, False)], "k string, path string, line int, duplicated boolean")
    assert rows(rl.duplication(l, ["k"]), "total_lines", "duplicated_lines", "percent") == [(2, 1, 50.0)]
    assert rl.duplication(l.limit(0), ["k"]).isEmpty()


def test_duplication_pct_of_odd_texts_equals_sql(spark, tmp_path):
    """Repeated ids, final line breaks, empty and null texts, white space beyond the blank, no source."""
    import duckdb
    from oracle import differences
    from tallystone.plans.catalogue import ORACLES

    d = [(1, "a\nb\n", "src1"), (1, "a\nb\n", "src1"), (2, "", "src2"), (3, None, "src2"), (4, "\u00a0b\u3000\r\nc\r", "src2"), (5, "z\n\ny", None), (5, "only\t", "src3"), (5, "only", "src3")]
    spark.createDataFrame(d, "doc_id bigint, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    mine, theirs, n = differences(QUERIES["duplication_pct"](spark, str(tmp_path)), c, ORACLES["duplication_pct"])
    assert not mine and not theirs and n == 3, (mine, theirs)


def test_owners_of_a_long_document_take_one_pass(spark):
    """A frame to the document's end would be worked out anew for each of its lines."""
    l = spark.range(1, 2001).selectExpr("1 AS doc", "id AS line", "id % 4 > 0 OR id > 1990 AS c")
    d = se.with_owner(l, ["doc"], "line", F.col("c"))
    assert "unboundedfollowing" not in d._jdf.queryExecution().toString().lower()
    assert rows(d, "line", "owner") == sorted([(i, next((k for k in range(i, 1991) if k % 4 == 0), None)) for i in range(1, 2001)], key=repr)


def test_runs_of_clones_are_sorted_once(spark):
    """Most runs occur once, so combining them before the shuffle would only sort, spill and widen them."""
    d = spark.createDataFrame([(2, "a b c d"), (2, "b c d"), (1, "x a b c"), (3, "a a a a"), (4, None)], "k bigint, text string")
    g = rl.clone_groups(d, "k", F.split("text", " "), 3)
    plan = g._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 1 and plan.index("Aggregate") < plan.index("Exchange ") and "Aggregate" not in plan[plan.index("Exchange ") :]
    assert rows(g) == [(1, 1, 2, True), (2, 0, 2, False), (3, 0, 2, False)]


def test_parts_of_a_table(spark, monkeypatch):
    """They grow with the table, slower once their rows no longer go straight to files; an unknown size takes the usual number."""
    from tallystone import session

    d = spark.range(1000)  # 8,000 bytes
    monkeypatch.setattr(session, "PART_BYTES", 100)
    monkeypatch.setattr(session, "LARGE_PART_BYTES", 800)
    assert [session.parts_of(d), session.parts_of(spark.range(100_000)), session.parts_of(spark.range(1))] == [80, 1000, 4]
    monkeypatch.setattr(session, "DIRECT", 50)
    assert session.parts_of(d) == 50
    assert session.parts_of(spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "a int")) == 8


@pytest.mark.parametrize("name", ["sweep_classify", "pair_classify"])
def test_sweeps_are_counted_where_rows_were_dealt(spark, name):
    """One shuffle, in parts that follow the table's size: tables of all keys of a file, or of a fixed number of parts, grow with the input."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.rindex("Aggregate") < plan.index("Exchange ") and "REPARTITION_BY_NUM" in plan


def test_snapshot_diff_of_nulls(spark):
    b, a = spark.createDataFrame([(1, None), (2, "x"), (3, "x")], "k int, v string"), spark.createDataFrame([(1, None), (2, None), (4, "x")], "k int, v string")
    assert rows(rl.snapshot_diff(b, a, "k", ["v"])) == [(2, "changed", 3), (3, "removed", 3), (4, "added", 2)]
    assert rows(rl.highest_bump(rl.snapshot_diff(b, b, "k", ["v"]))) == [(1, False)]


def test_first_k_says_what_is_left_out(spark):
    assert rows(rl.first_k(spark.range(5), [F.desc("id")], 2)) == [(3, 3), (4, 3)]
    assert rows(rl.first_k(spark.range(1), [F.desc("id")], 2)) == [(0, 0)]


def test_draw_ignores_partitions(spark):
    a, b = (rows(rl.draw(spark.range(500).repartition(n), "s", F.col("id").cast("string"), 7)) for n in (1, 9))
    assert a == b and len(a) == 7


def test_last_wins_and_forward_fill(spark):
    d = spark.createDataFrame([("k", 1, 2, "b"), ("k", 2, 1, "c"), ("k", 1, 3, "a")], "k string, depth int, line int, v string")
    assert rows(rl.last_wins(d, ["k"], ["depth", "line"], "v")) == [("k", "c")]
    f = spark.createDataFrame([("d", 1, None), ("d", 2, "h"), ("d", 3, None)], "doc string, line int, h string")
    assert rows(rl.fill_forward(f, ["doc"], ["line"], F.col("h"), "s"), "line", "s") == [(1, None), (2, "h"), (3, "h")]


def test_config_chain_stops_at_the_nearest_root(spark):
    f = spark.createDataFrame([("a/b/c/f.cs",), ("x/f.cs",)], "path string")
    c = spark.createDataFrame([("", True), ("a", True), ("a/b", False)], "dir string, is_root boolean")
    # the first directory of every path is its first ancestor
    got = rows(rl.config_chain(f, c), "path", "dir")
    assert ("a/b/c/f.cs", "a/b") in got and ("a/b/c/f.cs", "a") in got and all(d != "" for p, d in got if p.startswith("a/"))


@pytest.mark.parametrize(
    "glob, yes, no",
    [
        ("*.cs", ["a.cs", "x/a.cs"], ["a.csx", "a.c"]), ("{a,b}.x", ["a.x", "b.x"], ["c.x", "ab.x"]), ("src/**.cs", ["src/a.cs", "src/d/e.cs"], ["x/src/a.cs", "src.cs"]),
        ("[!a]b", ["cb"], ["ab"]), ("f{1..3}", ["f1", "f3"], ["f4", "f0"]), ("a?c", ["abc"], ["a/c", "ac"]), ("a.b", ["a.b"], ["axb"]),
    ],
)
def test_globs(spark, glob, yes, no):
    got = spark.createDataFrame([(x,) for x in yes + no], "p string").select("p", F.col("p").rlike(rl.glob_regex(glob))).collect()
    assert {r[0] for r in got if r[1]} == set(yes)
    assert re.compile(rl.glob_regex(glob))


def test_exclusions(spark):
    d = spark.createDataFrame([("src/a.cs",), ("obj/a.cs",), ("gen/x.cs",), ("src/gen/x.cs",)], "p string")
    assert rows(d.where(rl.not_excluded(F.col("p"), ["gen/**"]))) == [("src/a.cs",), ("src/gen/x.cs",)]


def test_siblings_of_empty_keys(spark):
    u = spark.createDataFrame([("p", 1), ("p", 2), ("", 3), ("", 4), (None, 5), ("q", 6)], "k string, i int")
    assert rows(rl.siblings(u, "k", "i"), "i", "n_siblings", "a_sibling") == [(1, 1, 2), (2, 1, 1)]


def test_shingles(spark):
    d = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    assert [r[0] for r in d.select(rl.shingles(F.col("t"), 2)).collect()] == [[["a", "b"], ["b", "c"]], [], []]


def test_clone_extents_break_at_gaps(spark):
    m = spark.createDataFrame([("a", "b", 1, 5), ("a", "b", 2, 6), ("a", "b", 4, 8), ("a", "b", 1, 9)], "a string, b string, pos_a int, pos_b int")
    assert rows(rl.clone_extents(m), "from_a", "from_b", "runs") == [(1, 5, 2), (1, 9, 1), (4, 8, 1)]


def test_reach_stops_at_sanitizers_and_in_circles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 4), (4, 5)], "src int, dst int")
    n = lambda *x: spark.createDataFrame([(i,) for i in x], "node int")
    assert rows(rl.reachable(n(1), e, n(4))) == [(1,), (2,), (3,)]
    assert rows(rl.reachable(n(4), e, n(4))) == []


def walked(sources, edges, clean):
    to = {}
    for a, b in edges:
        to.setdefault(a, []).append(b)
    seen, new = set(), set(sources) - clean
    while new:
        seen |= new
        new = {b for a in new for b in to.get(a, ())} - clean - seen
    return seen


def test_reach_by_brute_force(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(4500)]
    sources, clean = range(0, 3000, 500), set(range(0, 3000, 9))
    n = lambda x: spark.createDataFrame([(i,) for i in x], "node int")
    got = rl.reachable(n(sources), spark.createDataFrame(edges, "src int, dst int"), n(clean)).collect()
    want = walked(sources, edges, clean)
    assert len(want) > 500 and sorted(r["node"] for r in got) == sorted(want)


def test_whole_reach_takes_every_order(spark):
    d = "/root/testdata/sf0.001"
    o = spark.read.parquet(f"{d}/orders.parquet").collect()
    sources = [r["c_custkey"] for r in spark.read.parquet(f"{d}/customer.parquet").collect() if r["c_acctbal"] < 0]
    clean = {r["o_orderkey"] for r in o if r["o_orderstatus"] == "P"}
    want = walked(sources, [(r["o_custkey"], r["o_orderkey"]) for r in o], clean)
    got = [r["node"] for r in QUERIES["taint_reach_whole"](spark, d).collect()]
    assert sorted(got) == sorted(want) and max(got) > 400


def test_climbing(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "c")], "k string, p string")
    assert rows(rl.depth_to_root(e, "k", "p")) == [("a", 2), ("b", 1), ("x", 1)]
    assert rows(rl.closure(e, "k", "p")) == [("a", "a"), ("a", "b"), ("a", "c"), ("b", "b"), ("b", "c"), ("x", "c"), ("x", "x")]
    with pytest.raises(RuntimeError):
        rl.depth_to_root(spark.createDataFrame([("a", "b"), ("b", "a")], "k string, p string"), "k", "p", most=5)


def test_ranks_over_ranges(spark):
    d = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"), F.col("id")).repartition(9)
    got = rl.ranked(d, [F.col("x").desc()], "place")
    assert got.columns == ["x", "id", "place"] and got.where("place <> 5000 - x").isEmpty() and got.count() == 5000
    assert rl.ranked(d.limit(0), [F.col("x")], "place").isEmpty()


def test_assignments(spark):
    d = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, list("abcdefghi"))], "k int, s array<string>")
    assert rows(rl.assignments_of(d, "s"), "k", "mask") == [(1, 0), (1, 1), (1, 2), (1, 3)]


def test_shapes(spark):
    k = lambda *x: spark.createDataFrame([(i,) for i in x], "k int")
    assert rows(rl.shape_changes(k(1, 1, 2), k(2, 3), "k")) == [(1, "removed"), (3, "added")]
    assert rows(rl.overlap_counts(k(1, 1, 2), k(2, 3, 4), "k")) == [(1, 1, 2)]


# settings


def test_stuck_comments_go_with_what_was_dropped(spark):
    text = "# head\n\n[*]\n# about a\na = 1\n; banner\n\n# about b\nb = 2:warning\nc = 3\n# tail"
    docs = spark.createDataFrame([("d", text), ("e", "a = 2")], "doc string, text string")
    reg = spark.createDataFrame([("a", "1", True, False), ("b", "2", True, True), ("c", "3", False, False)], "key string, default string, verified boolean, has_suffix boolean")
    got = {r["doc"]: (r["text"], r["dropped"]) for r in se.distill(docs, reg).collect()}
    assert got == {"d": ("# head\n\n[*]\n; banner\n\nc = 3\n# tail", 2), "e": ("a = 2", 0)}


def test_fixing(spark):
    docs = spark.createDataFrame([("d", "x_size = 4\nsize = 2\n[*.a]\nother = 1"), ("r", "ROOT = True\nsize = 3")], "doc string, text string")
    spell = spark.createDataFrame([("x_size", "size", 1), ("size", "size", 2)], "key string, option string, rank int")
    got = dict(rows(se.fixed(docs, spell)))
    assert got == {"d": "root = true\n\nx_size = 4\nsize = 4\n[*.a]\nother = 1", "r": "ROOT = True\nsize = 3"}
    again = dict(rows(se.fixed(se.fixed(docs, spell), spell)))
    assert again == got


@settings(max_examples=60, deadline=None)
@given(st.text("ab=[]\n # ", max_size=40), st.text("xy\n=", max_size=30))
def test_blocks_split_what_was_assembled(local, managed):
    one = se.assemble_block(managed, "1.0", local)
    mark, m, l = se.split_block(one)
    assert mark.startswith("1.0 ") and m == se.ended(managed) and l.lstrip("\n") == se.ended(local).lstrip("\n")
    assert se.assemble_block(m, "1.0", l) == se.assemble_block(managed, "1.0", l)


def test_block_without_marks():
    assert se.split_block("a\r\nb") == (None, "", "a\nb\n")
    assert se.without_root("root = true\na = 1\n[x]\nroot = true") == ("a = 1\n[x]\nroot = true", True)
    assert se.without_root("a = 1") == ("a = 1", False)


def test_registry_changes(spark):
    r = spark.createDataFrame([("a", "1", "probe"), ("b", None, None), ("c", "3", "docs"), ("d", "4", "docs")], "key string, default string, source string")
    p = spark.createDataFrame([("a", "1", "Verified"), ("b", "2", "Verified"), ("c", "3", "Verified"), ("d", "9", "Refuted"), ("z", "1", "Verified")], "key string, value string, verdict string")
    assert rows(se.registry_changes(r, p)) == [("b", None, "2", "?"), ("c", "3", "3", "docs")]
    assert rows(se.patched_registry(r, p)) == [("a", "1", "probe"), ("b", "2", "probe"), ("c", "3", "probe"), ("d", "4", "docs")]


# units


def test_units(spark):
    c = spark.createDataFrame([("u", "p"), ("v", "p"), ("v", "q"), ("u", "r")], "unit string, path string")
    assert rows(un.paths_without(c, spark.createDataFrame([("u",)], "unit string"))) == [("p",), ("q",)]
    assert rows(un.units_by_path(c)) == [("p", 2, "u"), ("q", 1, "v"), ("r", 1, "u")]


def test_fidelity(spark):
    d = spark.createDataFrame([(["a", "b"], ["a", "c", "d"]), (["a"], ["a"]), ([], [])], "x array<string>, y array<string>")
    f = d.select(F.size("y").alias("lines"), un.matching_lines(F.col("x"), F.col("y")).alias("matched"))
    assert rows(un.fidelity(f), "lines", "matched", "files", "whole", "line_percent") == [(4, 2, 3, 2, 50.0)]


def test_fixed_point_that_isnt_reached(spark):
    d = spark.createDataFrame([("a", 1), ("b", 0), ("c", -1)], "k string, state int")
    step = lambda x: x.withColumn("state", F.when(F.col("state") > 0, F.col("state") - 1).when(F.col("state") < 0, -F.col("state") - 3).otherwise(0))
    got = rows(un.to_fixed_point(d, "k", "state", step, rounds=3))
    assert got[:2] == [("a", 0, 2, True), ("b", 0, 1, True)] and got[2][0] == "c" and got[2][3] is False
    assert un.to_fixed_point(d.limit(0), "k", "state", step).isEmpty()


def test_fixed_point_of_large_keys(spark, tmp_path):
    keys = [0, 1, 32768, 65535, 65536, 131072, 3 << 20, -(1 << 40)]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["p_partkey"]: (r["state"], r["passes"], r["converged"]) for r in QUERIES["fixed_point"](spark, str(tmp_path)).collect()}
    halvings = {k: (k & -k).bit_length() - 1 if k else 0 for k in keys}
    assert got == {k: (k >> n, n + 1, True) for k, n in halvings.items()}


def test_a_lattice_has_many_ways_and_few_ancestors(spark):
    """40 diamonds: 2^40 paths."""
    edges = [e for i in range(40) for e in ((f"n{i}", f"l{i}"), (f"n{i}", f"r{i}"), (f"l{i}", f"n{i + 1}"), (f"r{i}", f"n{i + 1}"))]
    e = spark.createDataFrame(edges, "k string, p string").coalesce(1)
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = dict(map(tuple, rl.depth_to_root(e, "k", "p", most=100).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    assert got["n0"] == 80 and got["n39"] == 2 and len(got) == 120


def test_section_value(spark):
    d = spark.createDataFrame([("a.cs",), ("b.txt",), ("x/a.cs",)], "path string")
    got = d.select("path", rl.section_value(F.col("path"), [("*", "all"), ("*.cs", "code"), ("a.*", "a")]).alias("v")).collect()
    assert [r["v"] for r in got] == ["a", "all", "a"]
