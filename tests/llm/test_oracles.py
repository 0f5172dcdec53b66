"""The two operators that SQL expresses, and the pipeline against its stages one by one."""

from collections import defaultdict

import pytest

import corpus_pipeline
from oracle import connect, differences
from tallystone.llm import language, packing, quality, queries, secrets
from tallystone.llm.common import written
from test_near import near_by_all_pairs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01" if name == "op4_vectors" else SF
    mine, theirs, rows = differences(queries.queries()[name](spark, sf), connect(sf), queries.oracle_sql()[name])
    assert not mine and not theirs, (mine, theirs)
    assert rows > 100


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_dedup", "secrets", "packing"]


def test_pipeline_by_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in quality.quality(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet")).collect() if r["score"] >= 0.3}
    left = docs.where(docs.doc_id.isin(list(good)))
    known = {r["doc_id"] for r in language.identify(left).collect() if r["lang_pred"] != "und" and r["score"] >= 0.5}
    alone = {i for i, (_, c) in near_by_all_pairs([(i, rows[i]) for i in known], 5).items() if c == i}
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(docs.where(docs.doc_id.isin(list(alone)))).collect()}
    assert 0 < len(alone) < len(known) <= len(good) < len(rows) and "[SECRET]" in "".join(clean.values())
    want = packing.pack(written(spark.createDataFrame(sorted(clean.items()), "doc_id long, text string"), "t")).collect()
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.01").collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, got)) == sorted(map(key, want))
    ends = defaultdict(list)
    for r in got:
        ends[r["sequence_id"]].append((r["offset"], r["offset"] + r["length"]))
    for x in ends.values():
        x.sort()
        assert x[0][0] == 0 and x[-1][1] <= 1024 and all(a[1] == b[0] for a, b in zip(x, x[1:]))


def test_labelled_good_documents_stay(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, "/root/testdata/sf0.01").select("doc_id").collect()}
    good = [r["doc_id"] for r in labels.where("quality = 1").collect()]
    bad = [r["doc_id"] for r in labels.where("quality = 0").collect()]
    assert sum(i in kept for i in good) >= 0.98 * len(good) and sum(i in kept for i in bad) <= 0.1 * len(bad)
