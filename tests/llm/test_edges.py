"""Every operator and stage on empty tables, nulls in any column, repeated rows, very long texts, ties and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallystone.llm import automaton, embeddings, fingerprints, html_text, language, minhash, packing, quality, secrets, token_store

TEXT = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 60_000 + "z" * 50_000


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "token_store": lambda s, d: token_store.token_store(d),
    "secrets": lambda s, d: secrets.report(d),
    "language": lambda s, d: language.identify(d),
    "fingerprints": lambda s, d: fingerprints.fingerprints(d),
    "quality": lambda s, d: quality.quality(d, labels(s)),
    "bpe": lambda s, d: automaton.bpe(d),
    "minhash": lambda s, d: minhash.near_duplicates(d),
}


def frame(spark, rows):
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], TEXT)
    # names that the operators use inside
    return d.withColumns({n: F.lit("clash") for n in ("key", "score", "start", "part", "k", "base", "spans", "component_id", "at", "length", "__text")})


ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three four five six"), (4, "one two three four five six"), (5, "one two three four five six"), (6, LONG), (None, "some text here"), (None, None), (7, "日本語 テスト"), (8, "\x00\x1f"), (-9, "x")]


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(spark, name):
    got = OPERATORS[name](spark, frame(spark, ROWS)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_and_all_nulls(spark, name):
    assert OPERATORS[name](spark, frame(spark, ROWS).limit(0)).collect() == []
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 3, TEXT)
    assert OPERATORS[name](spark, nulls).count() == 3


def test_packing(spark):
    got = packing.pack(frame(spark, ROWS)).collect()
    assert sum(r["piece"] == 0 for r in got) == len(ROWS)
    assert packing.pack(frame(spark, ROWS).limit(0)).collect() == []


def test_pages(spark):
    p = spark.createDataFrame([(1, "u", None), (None, None, ""), (2, "u", "<p>a  b"), (2, "u", "<p>a  b"), (3, "u", "<div>" * 20_000 + "deep"), (4, "u", "x" * 300_000), (5, "u", "<" * 3000), (6, "u", "<!--")], "page_id long, url string, html string")
    got = html_text.extract(p.withColumn("text", F.lit("clash"))).collect()
    assert len(got) == 8 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] == 2] == ["a b", "a b"]
    assert html_text.extract(p.limit(0)).collect() == []


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, None], 1), (10, [1.0, 0.0], None), (11, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)]
    d = spark.createDataFrame(v, "vec_id long, embedding array<float>, label int").withColumns({n: F.lit("clash") for n in ("rep", "grp", "size", "vec", "leaf")})
    got = embeddings.near_vectors(d).collect()
    assert len(got) == len(v)
    by = {(r["vec_id"]): r for r in got}
    assert (by[1]["component_id"], by[2]["component_id"], by[2]["kept"]) == (1, 1, False)
    assert all(by[i]["n_links"] == 0 and by[i]["kept"] for i in (3, 4, 5, 6, 7, 8, 9, 10, 11))
    assert by[None]["component_id"] is None and not by[None]["kept"]
    assert embeddings.near_vectors(d.limit(0)).collect() == []


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, k, tmp_path):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    stage = corpus_pipeline.STAGES[k][1]
    d = frame(spark, ROWS)
    got = stage(spark, d, str(tmp_path))
    if k < len(corpus_pipeline.STAGES) - 1:
        assert got.columns == d.columns and [f.dataType for f in got.schema] == [f.dataType for f in d.schema]
    got.collect()
    assert stage(spark, d.limit(0), str(tmp_path)).collect() == []
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 2, TEXT)
    stage(spark, nulls, str(tmp_path)).collect()


def test_without_labels(spark):
    d = frame(spark, ROWS)
    none = labels(spark).limit(0)
    assert {r["score"] for r in quality.quality(d, none).collect()} == {0.5}
    one = labels(spark).where("quality = 1")
    assert quality.quality(d, one).count() == len(ROWS)
    assert quality.keep_good(d, none).count() == len(ROWS)
