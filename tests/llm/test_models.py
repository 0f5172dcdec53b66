"""Language ID against code lengths by definition, the discriminant against densities by definition, and both on held-out rows."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystone.llm import language, quality, queries

SF = "/root/testdata/sf0.01"


def ppm_bits(train: list[str], text: str) -> float:
    """The escape chain by definition: method C with exclusion, down to all bytes left."""
    seen: dict[bytes, Counter] = defaultdict(Counter)
    pad = bytes([language.START]) * language.ORDER
    for t in train:
        b = pad + t.encode()
        for i in range(language.ORDER, len(b)):
            for k in range(language.ORDER + 1):
                seen[b[i - k : i]][b[i]] += 1
    total, b = 0.0, pad + text.encode()
    for i in range(language.ORDER, len(b)):
        out: set[int] = set()
        for k in range(language.ORDER, -1, -1):
            c = {x: n for x, n in seen.get(b[i - k : i], {}).items() if x not in out}
            if not c:
                continue
            whole = sum(c.values()) + len(c)
            if b[i] in c:
                total -= math.log2(c[b[i]] / whole)
                break
            total -= math.log2(len(c) / whole)
            out |= c.keys()
        else:
            total += math.log2(256 - len(out))
    return total


def test_code_lengths_are_exact():
    train = {"a": ["the cat sat on the mat", "that hat"], "b": ["der Hund über", "die Hände"]}
    langs, lang, gram, count = sorted(train), [], [], []
    for i, x in enumerate(langs):
        g, n = np.unique(np.concatenate([language.grams(t) for t in train[x]]), return_counts=True)
        lang += [i] * len(g)
        gram += g.tolist()
        count += n.tolist()
    m = language.Model(langs, np.array(lang), np.array(gram, np.int64), np.array(count, np.int64))
    texts = ["the hat", "über die Hand", "xyz 日本", "t", "thatthatthat"]
    got = m.bits(texts)
    for t, row in zip(texts, got, strict=True):
        for x, bits in zip(langs, row, strict=True):
            assert bits == pytest.approx(ppm_bits(train[x], t), rel=1e-4), (t, x)


def test_long_and_short_texts_score_alike():
    langs = ["a", "b"]
    g = [np.unique(language.grams(t * 3), return_counts=True) for t in ("the cat sat ", "der Hund ")]
    m = language.Model(langs, np.repeat([0, 1], [len(x[0]) for x in g]), np.concatenate([x[0] for x in g]).astype(np.int64), np.concatenate([x[1] for x in g]).astype(np.int64))
    t = "the Hund sat on a cat " * 120_000
    one, many = m.bits([t])[0], m.bits(["x", t, "the cat"])[1]
    assert np.allclose(one, many) and len(t.encode()) > 2 << 20
    half = m.bits([t[: len(t) // 2]])[0]
    assert np.allclose(one, 2 * half, rtol=1e-4)


def test_a_hundred_languages_fit():
    """Sparse: what is kept grows with the grams learned, not with contexts by bytes by languages."""
    rng = np.random.default_rng(3)
    langs, lang, gram = [f"l{i:03}" for i in range(100)], [], []
    for i in range(100):
        first = 0x400 + 64 * i  # another script each
        text = "".join(map(chr, first + rng.integers(0, 60, 40_000)))
        g = np.unique(language.grams(text))
        lang.append(np.full(len(g), i))
        gram.append(g)
    m = language.Model(langs, np.concatenate(lang), np.concatenate(gram).astype(np.int64), np.ones(sum(map(len, gram)), np.int64))
    m.bits(["".join(map(chr, 0x400 + rng.integers(0, 6400, 2000)))])
    assert sum(x.nbytes for x in vars(m).values() if isinstance(x, np.ndarray)) < 200 << 20
    texts = ["".join(map(chr, 0x400 + 64 * i + rng.integers(0, 60, 200))) for i in (0, 41, 99)]
    assert m.bits(texts).argmin(1).tolist() == [0, 41, 99]


def test_kept_code_lengths_change_nothing(monkeypatch):
    langs = ["a", "b"]
    g = [np.unique(language.grams(t), return_counts=True) for t in ("the cat sat on the mat", "der Hund über die Hände")]
    made = lambda: language.Model(langs, np.repeat([0, 1], [len(x[0]) for x in g]), np.concatenate([x[0] for x in g]).astype(np.int64), np.concatenate([x[1] for x in g]).astype(np.int64))
    many = made()
    monkeypatch.setattr(language, "KEPT_BYTES", 0)
    few = made()
    few.met, few.costs, few.shift = few.met[:2], few.costs[:2], np.uint32(31)
    texts = ["der Hund sat " * 9, "the über", "xyz 日本 the cat", ""]
    assert np.array_equal(many.bits(texts), few.bits(texts)) and np.array_equal(many.bits(texts[::-1])[::-1], few.bits(texts))


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op5_language(spark, SF)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == docs.count()
    r = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] > 0.99 and 0 <= r[1] <= r[2] <= 1


def test_und(spark):
    d = spark.createDataFrame([(i, "the cat and the hat", "en") for i in range(20)] + [(100, None, "en"), (101, "12 .. 4² ½_", "en"), (102, "", None), (103, "hat", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(d).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[103] == ("en", 1.0)
    assert {r["lang_pred"] for r in language.identify(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.keep_known(d).count() == 21


def test_held_out_rows_teach_nothing(spark):
    d = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(language.held_out("id"), "zz").otherwise("en").alias("lang"))
    assert {r["lang_pred"] for r in language.identify(d).collect()} == {"en"}


def test_discriminant_is_the_density():
    rng = np.random.default_rng(0)
    d = quality.D
    x = {c: rng.normal(size=(900, d)) @ rng.normal(size=(d, d)) + c for c in (0, 1)}
    m = quality.Discriminant({c: (float(len(v)), v.sum(0), v.T @ v) for c, v in x.items()}, pool=0.0, ridge=0.0)
    at = np.concatenate([x[0][:40], x[1][:40]])
    logs = {}
    pooled = sum(np.cov(v.T, bias=True) for v in x.values()) / 2
    for c, v in x.items():
        w = d / (d + len(v))
        cov = (1 - w) * np.cov(v.T, bias=True) + w * pooled
        z = at - v.mean(0)
        logs[c] = -0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z) - 0.5 * np.linalg.slogdet(cov)[1]
    assert np.allclose(m.score(at), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))), atol=1e-6)


def test_quality_of_held_out_rows(spark):
    got = queries.op7_quality(spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    r = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(x["predicted"] == x["quality"] for x in r) / len(r) > 0.97
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) for x in r)


def test_held_out_labels_teach_nothing(spark):
    d = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words number "), "id").alias("text"))
    one = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    lie = one.withColumn("quality", F.when(language.held_out("doc_id"), 0).otherwise(1))
    a, b = (sorted(map(tuple, quality.quality(d, l).collect())) for l in (one, lie))
    assert a == b


def test_statistics_are_finite():
    for t in (None, "", " ", "a", "!!!", "A" * 100_000, "\n" * 500, "é" * 9, "x " * 50_000):
        assert np.isfinite(quality.statistics(t)).all() and len(quality.statistics(t)) == quality.D
