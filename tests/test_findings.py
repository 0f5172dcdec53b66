"""Rules, ordinals, baselines, supersession, severities, and the whole check, on small frames."""

import pytest
from pyspark.sql import functions as F

from tallystone.functions import text as tx
from tallystone.operators import findings as fd
from tallystone.operators import relations as rl
from tallystone.plans import check as plan
from tallystone.sources.sinks import Refused, baseline


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("a.cs", "x TODO now\ny TODO #12\n"), ("b.cs", ""), ("c.cs", None), ("d.cs", "fixme\r\ny\rTODO ABC-12 z")], "path string, text string")


def rule(**k):
    return fd.Rule("R0001", 3, "a marker", tx.marker_without_reference(F.col("line_text")), per_line=True, **k)


def test_per_line_rule(files):
    assert rows(rule().run(files), "path", "line", "snippet") == [("a.cs", 1, "x TODO now"), ("d.cs", 1, "fixme")]


def test_rules_without_a_project(spark, files):
    other = fd.Rule("R0002", 2, "m", F.lit(True), needs_project=True, scope="compilation")
    assert not other.cacheable and rule().cacheable
    assert fd.run_rules(files, [rule(), other], with_project=False).select("rule_id").distinct().count() == 1
    assert fd.run_rules(files, [rule(), other]).where("rule_id = 'R0002'").count() == 4
    assert rows(fd.skipped_rules(spark, [rule(), other], False), "rule_id", "reason") == [("R0002", "needs a project")]
    assert fd.skipped_rules(spark, [rule(), other], True).isEmpty()


def test_ordinals_count_per_symbol_or_file(spark):
    f = spark.createDataFrame([("r", "a", 5, 1, "s", ""), ("r", "a", 2, 1, "s", ""), ("r", "b", 1, 1, "s", ""), ("r", "b", 1, 1, "t", "K"), ("r", "a", 9, 1, "t", "K")], "rule_id string, path string, start int, line int, snippet string, enclosing_symbol string")
    got = {(r["path"], r["start"], r["snippet"]): r["ordinal"] for r in fd.with_ordinals(f).collect()}
    assert got == {("a", 2, "s"): 0, ("a", 5, "s"): 1, ("b", 1, "s"): 0, ("a", 9, "t"): 0, ("b", 1, "t"): 1}


def test_fingerprint_survives_white_space(spark):
    f = spark.createDataFrame([("a  b", 1), (" a\tb ", 9), ("ab", 1)], "snippet string, line int").withColumns({"rule_id": F.lit("r"), "enclosing_symbol": F.lit(""), "path": F.lit("p"), "ordinal": F.lit(0)})
    got = [r[0] for r in f.select(fd.fingerprint()).collect()]
    assert got[0] == got[1] != got[2]


def test_baseline_buckets(spark):
    f = spark.createDataFrame([("x",), ("y",)], "fingerprint string")
    known = spark.createDataFrame([("y",), ("y",), ("z",)], "fingerprint string")
    assert rows(fd.baseline_buckets(f, known), "fingerprint", "bucket") == [("x", "New"), ("y", "Existing")]
    assert rows(fd.baseline_buckets(f, None), "bucket") == [("Unknown",), ("Unknown",)]


def test_fixed_needs_a_rule_that_ran(spark):
    b = spark.createDataFrame([("r", "x"), ("q", "y"), ("r", "z")], "rule_id string, fingerprint string")
    now, ran = spark.createDataFrame([("z",)], "fingerprint string"), spark.createDataFrame([("r",)], "rule_id string")
    assert rows(fd.baseline_fixed(b, now, ran), "fingerprint") == [("x",)]


def test_baseline_verbs(spark):
    found = spark.createDataFrame([("r", "x"), ("own", "y")], "rule_id string, fingerprint string")
    old = spark.createDataFrame([("r", "w"), ("r", "x")], "rule_id string, fingerprint string")
    none, bad = spark.createDataFrame([], "path string"), spark.createDataFrame([("p",)], "path string")
    of = lambda verb, u=none: rows(baseline(verb, found, old, u, ["own"]), "fingerprint")
    assert of("create") == [("x",)] and of("update") == [("w",), ("x",)] and of("prune") == [("x",)] and of("show", bad) == [("w",), ("x",)]
    with pytest.raises(Refused):
        of("create", bad)


def test_a_superseded_winner_still_wins(spark):
    f = spark.createDataFrame([("A", "p", 1, 1), ("b", "p", 1, 1), ("C", "p", 1, 1), ("C", "p", 2, 1)], "rule_id string, path string, line int, column int").withColumn("suppression", F.lit("None"))
    m = spark.createDataFrame([("a", "B"), ("B", "c")], "winner string, loser string")
    assert rows(fd.mark_superseded(f, m), "rule_id", "line", "suppression") == [("A", 1, "None"), ("C", 1, "Superseded"), ("C", 2, "None"), ("b", 1, "Superseded")]


def test_language_floor(spark):
    f = spark.createDataFrame([("r", "p"), ("r", "q"), ("s", "p"), ("r", "n")], "rule_id string, path string")
    need, floor = spark.createDataFrame([("r", 9)], "rule_id string, required int"), spark.createDataFrame([("p", 8), ("q", 9)], "path string, lowest int")
    assert rows(fd.language_floor(f, need, floor), "rule_id", "path") == [("r", "n"), ("r", "q"), ("s", "p")]


def test_scoped_severity(spark):
    f = spark.createDataFrame([("r", "p", 3), ("r", "q", 3), ("r", "o", 3)], "rule_id string, path string, severity int")
    o = spark.createDataFrame([("r", "p", 0), ("r", "q", 4)], "rule_id string, path string, override int")
    assert rows(fd.scoped_severity(f, o), "path", "severity") == [("o", 3), ("q", 4)]


def test_changed_code_ends_count(spark):
    f = spark.createDataFrame([("p", 1), ("p", 2), ("p", 4), ("p", 5), ("q", 3)], "path string, line int")
    r = spark.createDataFrame([("p", 2, 4)], "path string, from_line int, to_line int")
    assert rows(fd.in_changed_code(f, r), "path", "line", "in_changed_code") == [("p", 1, False), ("p", 2, True), ("p", 4, True), ("p", 5, False), ("q", 3, False)]


def test_suppression_audit_without_a_reference(spark):
    n = spark.createDataFrame([("s", "r", "p", "d")] * 2, "source string, rule string, place string, detail string")
    assert rows(fd.suppression_audit(n, None), "change") == [("current",)]
    assert rows(fd.suppression_audit(n, n.limit(0)), "change") == [("added",)]


def test_the_whole_check(spark, files):
    none = spark.createDataFrame([], "winner string, loser string")
    ranges = spark.createDataFrame([("a.cs", 1, 1)], "path string, from_line int, to_line int")
    d = plan.check(files, [rule()], none, changed=ranges)
    assert rows(d, "path", "bucket", "in_changed_code") == [("a.cs", "Unknown", True), ("d.cs", "Unknown", False)]
    metrics = spark.createDataFrame([("p95", 1.0)], "name string, value double")
    unknown = {r["name"]: r["value"] for r in plan.gate_inputs(d, metrics).collect()}
    assert unknown == {"p95": 1.0, "newIssues": None, "maxSeverity": 3.0}
    with_known = plan.check(files, [rule()], none, baseline=d.where("path = 'a.cs'"))
    assert {r["name"]: r["value"] for r in plan.gate_inputs(with_known, metrics).collect()}["newIssues"] == 1.0
    gate = rl.evaluate_gate(plan.gate_inputs(d, metrics), spark.createDataFrame([("newIssues", 0.0), ("maxSeverity", 3.0)], "name string, bound double"))
    assert rows(gate, "name", "state") == [("maxSeverity", "pass"), ("newIssues", "unknown")]
    assert rl.gate_passes(gate).first()["exit_code"] == 1


def test_a_release(spark):
    part = lambda *r: spark.createDataFrame(r, "id string, v int")
    changes, verdict = plan.release({"rules": (part(("a", 1), ("b", 1)), part(("a", 1), ("b", 1), ("c", 1)), "id", ["v"])}, "1.2.3")
    assert rows(changes, "key", "state") == [("c", "added")] and verdict.first()["next"] == "1.3.0"
    _, same = plan.release({"rules": (part(("a", 1)), part(("a", 1)), "id", ["v"])}, "1.2.3")
    assert same.first()["next"] == "1.2.4"


def test_options_of_a_rule(files):
    long = fd.Rule("R0003", 2, "m", lambda o: F.char_length("text") > o["most"], options={"most": 15})
    paths = lambda **o: rows(fd.run_rules(files, [long], options=o), "path")
    assert paths() == [("a.cs",), ("d.cs",)] and paths(R0003={"most": 22}) == [] and paths(R0003={"most": -1}) == [("a.cs",), ("b.cs",), ("d.cs",)]
    with pytest.raises(ValueError):
        paths(R0003={"least": 1})


@pytest.mark.parametrize("name", ["baseline_verbs", "baseline_fixed", "baseline_buckets"])
def test_fingerprints_are_printed_once(spark, name):
    """Nothing is found or printed again for each place that asks, and no condition on a fingerprint goes down to the words."""
    from tallystone.plans.catalogue import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan and "parquet" not in plan and "LogicalRDD" in plan


def test_words_are_counted_where_texts_were_dealt(spark):
    """One shuffle, of texts: tables of the words of a whole file, and their shuffle, grow with what a task reads."""
    from tallystone.plans.catalogue import QUERIES

    plan = QUERIES["findings_repeated_literal"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.rindex("Aggregate") < plan.index("Exchange ")
