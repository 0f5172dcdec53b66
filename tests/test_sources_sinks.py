"""Files, configuration, reports and histories: read, written and read back."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallystone.functions import edits as ed
from tallystone.functions import python as py
from tallystone.functions import scalars as sc
from tallystone.functions import text as tx
from tallystone.operators.findings import as_findings
from tallystone.sources import files as fs
from tallystone.sources import sinks as sk
from tallystone.streaming import history as hs


def rows(df, *names):
    return sorted((tuple(r[n] for n in names or df.columns) for r in df.collect()), key=repr)


def test_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {"a.cs": b"\xef\xbb\xbfx\n", "sub/b.g.cs": "é".encode("utf-16"), "sub/c.cs": b"ok\nbad \xff", "d.txt": b"no"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rpartition("/")[2]: r for r in fs.scan(spark, [str(tmp_path), str(tmp_path / "sub")]).collect()}
    assert set(got) == {"a.cs", "b.g.cs", "c.cs"}
    assert got["a.cs"]["text"] == "x\n" and got["b.g.cs"]["text"] == "é" and got["b.g.cs"]["is_generated"]
    assert (got["c.cs"]["text"], got["c.cs"]["bad_offset"], got["c.cs"]["bad_line"]) == (None, 7, 2)
    assert fs.unreadable(fs.scan(spark, [str(tmp_path)])).count() == 1


@pytest.mark.parametrize("name", ["utf-8-sig", "utf-16", "utf-32", "utf-8"])
def test_marks(name):
    assert fs.decode("aé\n".encode(name))[0] == "aé\n"


def test_first_that_loads(spark):
    some, none = spark.range(1), spark.range(0)

    def broken():
        raise OSError("gone")

    got, passed = fs.first_that_loads([("a", lambda: none), ("b", broken), ("c", lambda: some)])
    assert got.count() == 1 and passed == [("a", "empty"), ("b", "gone")]
    with pytest.raises(OSError):
        fs.first_that_loads([("b", broken)], named="b")


def test_sections(spark):
    d = spark.createDataFrame([("d", "root = true\r\n; c\n[*.cs]\nIndent = 4\n# x\n[a]\nb=\nKey : V v ")], "doc string, text string")
    assert rows(fs.parse_sections(d), "glob", "key", "value", "line") == [("*.cs", "indent", "4", 4), ("a", "b", "", 7), ("a", "key", "V v", 8), (None, "root", "true", 1)]


@pytest.mark.parametrize("text, want", [("{}", []), ('{"exclude": []}', []), ('{"exclude": "x"}', []), ('{"exclude": ["a", 1]}', []), ('{"exclude": ["a/**", "b"],} // c', ["a/**", "b"]), ("{", []), ('{/* , */ "exclude": ["//x,]",]}', ["//x,]"]), ("[]", [])])
def test_tool_settings(text, want):
    got, said = fs.tool_settings(text)
    assert fs.exclusions(got) == want and bool(said) == (text in ("{", "[]"))


def finding(spark, *r):
    return as_findings(spark.createDataFrame(r, "rule_id string, severity int, message string, path string, line int, suppression string, bucket string"))


def test_report_round_trip(spark, tmp_path):
    f = finding(spark, ("R1", 4, "m|n", "p", 3, "None", "New"), ("R2", 1, "m", "p", 4, "None", "Existing"), ("R3", 2, "m", "q", 5, "Superseded", "New"))
    sk.write_report(f, str(tmp_path / "all"), str(tmp_path / "open"))
    assert spark.read.json(str(tmp_path / "all")).count() == 3 and spark.read.json(str(tmp_path / "open")).count() == 1
    whole = tmp_path / "report.json"
    whole.write_text(json.dumps({"runs": [{"results": [json.loads(x) for x in sk.report_rows(f).toJSON().collect()]}, {"results": []}]}))
    got = fs.read_report(spark, str(whole))
    assert rows(got, "rule_id", "severity", "line", "suppression", "bucket") == [("R1", 4, 3, "None", "New"), ("R2", 1, 4, "None", "Existing"), ("R3", 2, 5, "inSource", "New")]


def test_document_round_trip(spark, tmp_path):
    f = finding(spark, ("R1", 4, 'm"|n\n', "p", 3, "None", "New"), ("R2", 1, "m", "p", 4, "None", "Existing"), ("R2", 1, "m", "p", 4, "None", "Existing"))
    at = str(tmp_path / "doc")
    sk.write_document(f, at, "1.2.3", {"loadMode": "full", "optionOverridesActive": "yes"}, {"fileCount": 7, "gate": "strict", "gatePassed": False, "gateFailures": ["a", "b"], "start": "2024-01-01T00:00:00Z", "end": "2024-01-01T00:00:02.5Z"})
    (file,) = (tmp_path / "doc").glob("part-*")
    assert [len(r["results"]) for r in json.loads(file.read_text())["runs"]] == [3]
    assert rows(fs.read_report(spark, at), "rule_id", "severity", "line", "suppression") == [("R1", 4, 3, "None"), ("R2", 1, 4, "None"), ("R2", 1, 4, "None")]
    assert fs.read_run(spark, at).first().asDict() == {
        "tool": "tallystone", "version": "1.2.3", "loadMode": "full", "loadSummary": "", "configurationFingerprint": "", "optionOverridesActive": False, "fileCount": 7, "lineCount": 0,
        "partial": False, "seconds": 2.5, "gate": "strict", "gatePassed": False, "gateFailures": ["a", "b"],
    }
    sk.write_document(f.where("false"), str(tmp_path / "none"), "1")
    assert fs.read_report(spark, str(tmp_path / "none")).isEmpty()
    got = fs.read_run(spark, str(tmp_path / "none")).first()
    assert (got["gate"], got["gatePassed"], got["gateFailures"], got["seconds"], got["fileCount"]) == (None, None, None, 0.0, 0)
    (tmp_path / "bare.json").write_text('{"runs": []}')
    with pytest.raises(PySparkException, match="no runs"):
        fs.read_run(spark, str(tmp_path / "bare.json")).collect()


def test_report_levels(spark):
    d = spark.createDataFrame([("note", None), ("note", "hint"), ("warning", "bad"), ("odd", None)], "level string, exact string")
    assert [r[0] for r in d.select(sc.severity_from_report(F.col("level"), F.col("exact"))).collect()] == ["suggestion", "hint", "warning", "warning"]


def test_lines(spark):
    f = finding(spark, ("R1", 3, "a|b", "p.cs", 3, "None", "New"))
    assert {s: sk.lines(f, s).first()[0] for s in ("plain", "github", "markdown", "agent")} == {
        "plain": "p.cs(3,0): warning R1: a|b", "github": "::warning file=p.cs,line=3,col=0,title=R1::a|b", "markdown": "| warning | R1 | `p.cs:3` | a\\|b |", "agent": "R1\twarning\tp.cs:3\ta|b",
    }


def test_baseline_needs_apply(spark, tmp_path):
    d = spark.createDataFrame([("r", "x")], "rule_id string, fingerprint string")
    assert not sk.write_baseline(d, str(tmp_path / "b")) and not (tmp_path / "b").exists()
    assert sk.write_baseline(d, str(tmp_path / "b"), apply=True) and spark.read.parquet(str(tmp_path / "b")).count() == 1


def test_history_and_trend(spark, tmp_path):
    m = spark.createDataFrame([("a", 1.0), ("b", None)], "name string, value double")
    for _ in range(3):
        sk.append_history(m, str(tmp_path / "h"))
    h = fs.history(spark, str(tmp_path / "h"))
    assert h.count() == 6 and sk.trend(h, 2).count() == 2
    assert sk.summary_line(m).first()[0] == "a 1.0, b -"


def test_exit_codes():
    assert [sk.exit_code(True), sk.exit_code(False), sk.exit_code(True, incomplete=True), sk.exit_code(False, bad_settings=True), sk.exit_code(True, True, True, True)] == [0, 1, 2, 3, 5]
    assert [sk.exit_code(True, bad_settings=True, nothing_loaded=True), sk.exit_code(True, crashed=True, nothing_loaded=True), sk.exit_code(True, crashed=True, cancelled=True)] == [4, 5, 130]


def test_small_readers(spark, tmp_path):
    d = spark.createDataFrame([("| 0 | ok |\n| 1 | bad |\n| 0 | again |\nx",)], "text string")
    assert rows(fs.markdown_table(d)) == [("0", "ok"), ("1", "bad")]
    assert spark.createDataFrame([("<a><V>1.2</V></a>",)], "t string").select(fs.xml_property(F.col("t"), "V")).first()[0] == "1.2"
    (tmp_path / "rules.json").write_text('[{"id": "R1"}, {"id": "R2"}]')
    (tmp_path / "ids.txt").write_text("# ids\nR1\n")
    assert rows(fs.catalogue(spark, str(tmp_path / "rules.json"), str(tmp_path / "ids.txt")), "id", "allocated") == [("R1", True), ("R2", False)]
    (tmp_path / "o.json").write_text('{"options": [{"key": "a", "v": 1}, {"key": "a", "v": 2}]}')
    assert fs.registry(spark, str(tmp_path / "o.json")).select("option.v").first()[0] == 2
    (tmp_path / "s.json").write_text('{"key": "k", "values": [{"value": "1", "oracle": "h", "ours": "g", "agree": false}]}')
    assert rows(fs.sweep_archive(spark, str(tmp_path / "s.json")), "key", "agree") == [("k", False)]


def test_notes_say_what_is_cut(spark):
    c = spark.createDataFrame([("rules", f"k{i}", "added") for i in range(4)] + [("options", "o", "removed")], "surface string, key string, state string")
    got = rows(sk.release_notes(c, spark.createDataFrame([("2.0.0",)], "next string"), 2), "surface", "at", "line")
    assert got == [("options", 0, "## 2.0.0: options"), ("options", 1, "- o: removed"), ("rules", 0, "## 2.0.0: rules"), ("rules", 1, "- k0: added"), ("rules", 2, "- k1: added"), ("rules", 3, "- and 2 more")]


def test_sweep_archive_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("b", "1", "x", "x", True), ("a", "2", "y", "z", False), ("a", "1", "y", "y", True)], "key string, value string, oracle string, ours string, agree boolean")
    sk.write_sweep_archive(d, str(tmp_path / "s"))
    assert rows(fs.sweep_archive(spark, str(tmp_path / "s")), "key", "value", "oracle", "ours", "agree") == rows(d)


def test_property_bags(spark):
    d = spark.createDataFrame([('{"p": {"n": 3}}',), ('{"p": {"n": "x"}}',), ("{}",)], "t string").withColumn("bag", F.parse_json("t"))
    assert [r[0] for r in d.select(fs.property_or(F.col("bag"), "p.n", "int", F.lit(-1))).collect()] == [3, -1, -1]


def test_spread(spark):
    from tallystone.session import spread

    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(spark.range(100).repartition(50)).rdd.getNumPartitions() == 50


# functions


def test_line_counts(spark):
    cases = {"": 0, "a": 1, "a\n": 1, "a\r\nb": 2, "a\rb": 2, "a\n\n": 2, "\n": 1, None: 0}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", tx.line_count(F.col("t"))).collect()
    assert {r[0]: r[1] for r in got} == cases


def test_words(spark):
    d = spark.createDataFrame([("  Ab, c-d 1é2 ",), ("",), ("...",), (None,)], "t string")
    assert [r[0] for r in d.select(tx.words(F.col("t"))).collect()] == [["ab", "c", "d", "1", "2"], [], [], None]


@pytest.mark.parametrize("text, width", [("ab", 2), ("\tx", 5), ("ab\tx", 5), ("日本", 4), ("é", 1), ("é", 1), ("a​b", 2), ("👩‍👩‍👧", 2), ("👍🏽", 2), ("x\nab", 2), ("ñ ß", 3), ("a­b", 2)])
def test_width(text, width):
    assert py.width(text) == width


def test_tests_and_paths(spark):
    d = spark.createDataFrame([("a/X.Tests/f",), ("a/Xtests/f",), ("a\\x.test\\f",), ("a/X.Tests.Y/f",), (None,)], "p string")
    assert [r[0] for r in d.select(tx.is_test(F.col("p"), F.lit("u"))).collect()] == [True, False, True, True, False]
    q = spark.createDataFrame([("r\\a b\\c",), ("r/x",), ("y",)], "p string").select(tx.display_path(F.col("p"), "r/"))
    assert [r[0] for r in q.collect()] == ['"a b/c"', "x", "y"]


def test_versions(spark):
    order = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1", "1.2.0", "1.10.0", "v2.0.0"]
    d = spark.createDataFrame([(v,) for v in reversed(order)], "v string")
    assert [r[0] for r in d.orderBy(sc.version_order(F.col("v"))).collect()] == order
    bump = lambda v, b: spark.range(1).select(sc.next_version(F.lit(v), F.lit(b))).first()[0]
    assert [bump("1.2.3", 3), bump("1.2.3", 2), bump("1.2.3", 1), bump("1.2.3-rc.1", 1), bump("x", 1)] == ["2.0.0", "1.3.0", "1.2.4", "1.2.3", None]


def test_severities(spark):
    d = spark.createDataFrame([("Error",), ("silent",), ("refactoring",), ("odd",), (None,)], "w string")
    assert [r[0] for r in d.select(sc.severity_word(F.col("w"))).collect()] == ["error", "hint", "hint", None, None]
    assert [r[0] for r in d.select(sc.severity_rank(F.col("w"))).collect()][3] == 4


def test_generator():
    a, b = py.SplitMix64(1), py.SplitMix64(1)
    assert [a.next() for _ in range(3)] == [b.next() for _ in range(3)] and py.SplitMix64(0).next() == 0xE220A8397B1DCDAF
    assert all(0 <= a.below(7) < 7 and 0 <= a.double() < 1 for _ in range(200))
    assert sorted(a.shuffle(range(20))) == list(range(20)) and {a.pick([0, 1, 0]) for _ in range(20)} == {1}


def test_json():
    assert py.shape(json.loads('{"a": [1, {"b": null}], "c": {}, "d": true}')) == ["a[] : number", "a[].b : null", "c : object", "d : boolean"]
    assert py.keys(json.loads('{"a": [{"b": {"c": 1}}], "b": 2}')) == ["a", "b", "c"]
    deep = "[" * 3 + "]" * 3
    assert py.shape(json.loads(deep)) == ["[][] : array"]


def test_well_formed():
    assert py.well_formed("/// <summary>a</summary>\n/// <see/>") and not py.well_formed("/// <a>") and not py.well_formed("/// a & b")


@pytest.mark.parametrize("old, new", [("", ""), ("a\nb\nc\n", "a\nx\nc\n"), ("a\n", ""), ("", "a\nb"), ("a\nb", "b\na"), ("x\n" * 30, "x\n" * 29 + "y\n"), ("a\r\nb", "a\nb"), ("abc", "abd")])
def test_edits_rebuild_the_text(old, new):
    assert ed.apply(old, ed.line_edits(old, new)) == new


def test_edits_are_small_and_apart():
    assert ed.trimmed(5, "abcd", "abXd") == (7, 1, "X") and ed.trimmed(0, "a", "a") is None
    with pytest.raises(ValueError):
        ed.apply("abc", [(0, 2, ""), (1, 1, "")])


def test_unified():
    a, b = [f"l{i}" for i in range(30)], [f"l{i}" for i in range(30)]
    b[3], b[8], b[25] = "x", "y", "z"
    out = ed.unified("\n".join(a), "\n".join(b), "f").split("\n")
    assert [x for x in out if x.startswith("@@")] == ["@@ -1,12 +1,12 @@", "@@ -23,7 +23,7 @@"] and ed.unified("a", "a", "f") == ""


def test_a_hunk_beyond_the_table(monkeypatch):
    monkeypatch.setattr(ed, "MOST_CELLS", 4)
    assert ed.hunks(list("axbyc"), list("aXbYc")) == [(1, 4, 1, 4)]


# streaming


def test_windows_of_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"ts": f"2024-01-0{d}T0{h}:00:00", "event_type": "a"}) for d in (1, 2, 3) for h in (1, 2)))
    s = hs.read_stream(spark, str(src), "ts timestamp, event_type string")
    hs.write_stream(hs.windowed_counts(s), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "event_type", "n") == [("a", 2), ("a", 2)]
    (src / "2.json").write_text(json.dumps({"ts": "2024-01-01T03:00:00", "event_type": "a"}) + "\n" + json.dumps({"ts": "2024-01-05T03:00:00", "event_type": "a"}))
    hs.write_stream(hs.windowed_counts(hs.read_stream(spark, str(src), "ts timestamp, event_type string")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "n") == [(2,), (2,), (2,)]  # the late row is left to the batch run
    assert hs.windowed_counts(spark.read.schema("ts timestamp, event_type string").json(str(src))).agg(F.sum("n")).first()[0] == 8


def test_last_runs_are_whole(spark):
    h = spark.createDataFrame([(t, f"m{i}", float(i)) for t in range(5) for i in range(6)], "ts int, name string, value double")
    got = sk.last_runs(h, 3).collect()
    assert len(got) == 18 and {r["ts"] for r in got} == {2, 3, 4}
    assert sk.last_runs(h.where("false"), 3).count() == 0


def test_bugs_of_a_reader_are_not_passed_over():
    def wrong():
        return None.nothing

    with pytest.raises(AttributeError):
        fs.first_that_loads([("a", wrong)])


@pytest.mark.parametrize("text, width", [("\u1112\u1161\u11ab", 2), ("🇫🇷🇩🇪", 4), ("a\r\nbc", 2), ("👨‍👩‍👧‍👦x", 3), ("\u0301", 0), ("q\u0301\u0302z", 2)])
def test_width_goes_by_cluster(text, width):
    assert py.width(text) == width


def test_further_renderings(spark):
    from tallystone.operators import findings as fd

    f = fd.as_findings(spark.createDataFrame([("R1", 4, 'a < "b"', "p.cs", 3, 2)], "rule_id string, severity int, message string, path string, line int, column int"))
    one = lambda style: sk.lines(f, style).first()[0]
    assert "\x1b[31m" in one("terminal") and one("terminal").endswith('R1: a < "b"')
    assert '"message":"a < \\"b\\""' in one("json")
    assert one("junit").startswith('<testcase classname="R1" name="p.cs"><failure type="') and 'message="a &lt; &quot;b&quot;"' in one("junit")


def test_edits_take_little_memory_at_once():
    """Two bytes a cell of the table, where a list takes eight and more; the same hunks as by definition."""
    import random
    import tracemalloc

    def plain(x, y):
        n, m = len(x), len(y)
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        return best[0][0]

    r = random.Random(7)
    for _ in range(200):
        a, b = [[r.choice("abc") for _ in range(r.randrange(12))] for _ in "12"]
        h = ed.hunks(a, b)
        assert len(a) - sum(x1 - x0 for x0, x1, _, _ in h) == plain(a, b)
        out, at = [], 0
        for x0, x1, y0, y1 in h:
            out += a[at:x0] + b[y0:y1]
            at = x1
        assert out + a[at:] == b
    a, b = [str(i) for i in range(700)], [str(i) for i in range(1, 1400, 2)]
    tracemalloc.start()
    ed.hunks(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_500_000  # 4,037,416 with lists


@pytest.mark.parametrize("name", ["line_edits", "applied_edits", "unified_diffs"])
def test_few_whole_texts_cross_to_python_at_once(spark, name):
    from tallystone.plans.catalogue import QUERIES

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        QUERIES[name](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(key)) <= 1000
    finally:
        spark.conf.set(key, before)
