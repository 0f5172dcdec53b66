"""Near duplicates of texts and vectors against all pairs, and fingerprints against sets."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallystone.llm import common, embeddings, fingerprints, minhash, queries
from tallystone.llm.common import components

SF = "/root/testdata/sf0.001"


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_by_all_pairs(rows, k, percent=80):
    """doc_id -> (n_shingles, component)."""
    rows = sorted(rows)
    sets = [shingles(t, k) for _, t in rows]
    having = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            having[x].add(i)
    links = set()
    for i, s in enumerate(sets):
        for j in set().union(*(having[x] for x in s)) if s else ():
            if i < j and 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                links.add((i, j))
    r = roots(len(rows), links)
    return {rows[i][0]: (len(sets[i]), rows[r[i]][0]) for i in range(len(rows))}


def edited(rng, words, share):
    return [rng.choice(words) + "x" if rng.random() < share else w for w in words]


def groups(seed, n):
    """Texts in chains of edits, of many lengths, among them sets just above and below the limit."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    out = []
    for _ in range(n):
        w = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 8, 13, 30, 60, 200, 900]))
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            out.append(" ".join(w))
            w = edited(rng, w, rng.choice([0, 0.005, 0.01, 0.02, 0.05]))
    out += ["same words in a row again"] * 30 + ["Same  WORDS in\ta row\nagain"] * 5 + ["", " \t\x0b", None, "É é", "é é"]
    common = " ".join(rng.choices(vocabulary, k=120))
    out += [f"{common} tail{i} end{i}" for i in range(60)] + [f"{common} {' '.join(rng.choices(vocabulary, k=45))}" for _ in range(40)]
    rng.shuffle(out)
    return [(i * 3 - 50, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("k, small", [(4, 8), (5, 2)])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, k, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    rows = groups(k, 120)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), k=k).collect()
    want = near_by_all_pairs(rows, k)
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_files_grow_with_what_they_are_made_from(spark, monkeypatch):
    least = 2 * spark.sparkContext.defaultParallelism
    t = common.written(spark.range(20_000).repartition(4), "ids")
    n = common.bytes_of(t)
    assert n > 10_000 and common.few(spark) == common.few(spark, t) == least
    monkeypatch.setattr(common, "FILE_BYTES", 100)
    assert common.few(spark) == least and common.few(spark, t) == -(-n // 100) and common.few(spark, t, t) == -(-2 * n // 100)
    monkeypatch.setattr(common, "MOST_RANGES", 50)
    assert common.few(spark, t) == 50
    rows = groups(9, 40)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near_by_all_pairs(rows, 4)


def test_minhash_query(spark):
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet")
    want = near_by_all_pairs(list(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True)), 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op10_minhash(spark, "/root/testdata/sf0.01").collect()}
    assert got == want


def test_sketches_agree_as_sets_do():
    rng = np.random.default_rng(1)
    for size, similar in ((10, 0.8), (200, 0.8), (3000, 0.5)):
        seen = []
        for _ in range(60):
            both = int(round(similar * size))
            x = rng.integers(0, 2**63, 2 * size, dtype=np.int64).astype(np.uint64)
            a, b = np.unique(x[:size]), np.unique(np.concatenate([x[:both], x[size : 2 * size - both]]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            seen.append((minhash.sketch(a) == minhash.sketch(b)).mean() - true)
        assert abs(np.mean(seen)) < 0.02 and np.std(seen) < 0.06


def test_every_coordinate_fills():
    for n in (1, 2, 5, 1000):
        s = minhash.sketch(np.arange(1, n + 1, dtype=np.uint64))
        assert (s < np.iinfo(np.uint64).max).all()


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, links):
    want = roots(31, links)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {x: want[x] for a, b in links if a != b for x in (a, b)}


def test_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 400)] + [(500, i) for i in range(501, 900)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert set(got.values()) == {100, 500} and len(got) == 701


# vectors


def vectors_by_all_pairs(rows, cosine=0.98):
    rows = sorted(rows, key=lambda r: r[0])
    x = [np.array(v, np.float32).astype(float) for _, v, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][2] == rows[j][2] and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= cosine]
    n, r = np.zeros(len(rows), int), roots(len(rows), links)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {rows[i][0]: (int(n[i]), rows[r[i]][0]) for i in range(len(rows))}


@pytest.mark.parametrize("leaf, block, sample, oversize", [(512, 1024, 20_000, 8192), (16, 10, 300, 8192), (16, 30, 20, 40)])
def test_vectors_equal_all_pairs(spark, monkeypatch, leaf, block, sample, oversize):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(90):
        v = rng.normal(size=24)
        label = int(rng.integers(3))
        for _ in range(rng.choice([1, 1, 2, 5, 20])):
            rows.append((len(rows), v.astype(np.float32).tolist(), label))
            v = v + rng.normal(size=24) * rng.choice([0.0, 0.1, 0.2])
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), leaf=leaf, sample=sample, oversize=oversize, own_sample=60).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == vectors_by_all_pairs(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_large_leaves_are_split_again(spark):
    rng = np.random.default_rng(6)
    rows = [("g", 0, i, 1, rng.normal(size=48).tobytes()) for i in range(1500)] + [("h", 1, i, 1, np.ones(48).tobytes()) for i in range(200)]
    m = spark.createDataFrame(rows, "grp string, leaf long, rep long, size long, vec binary")
    got = embeddings.split_again(m, 0.02, 32, 100, 200, 6).groupBy("grp", "leaf").count().collect()
    assert max(r["count"] for r in got if r["grp"] == "g") <= 100 and len([r for r in got if r["grp"] == "g"]) > 15
    assert [(r["leaf"], r["count"]) for r in got if r["grp"] == "h"] == [(1, 200)]


def test_vector_query(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    want = vectors_by_all_pairs([(r["vec_id"], r["embedding"], r["label"]) for r in t])
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in queries.op4_vectors(spark, SF).collect()} == want


# fingerprints


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 400), max_size=200), st.sets(st.integers(0, 400), max_size=200)), min_size=1, max_size=4))
def test_peeling_recovers_the_difference(pairs):
    of = lambda s: np.array(sorted(minhash.mix(np.array([x], np.uint64))[0] for x in s), np.uint64)
    a, b = [of(x) for x, _ in pairs], [of(y) for _, y in pairs]
    assert fingerprints.differing(a, b).tolist() == [len(x ^ y) for x, y in pairs]


def test_peeling_tells_the_sides():
    x, y = np.array([11, 22, 33], np.uint64), np.array([22, 44], np.uint64)
    a, b = fingerprints.tables([x], 24), fingerprints.tables([y], 24)
    done, doc, sign, d = fingerprints.peel(a[0] - b[0], a[1] ^ b[1], a[2] ^ b[2], 1, 24)
    assert done.all() and dict(zip(d.tolist(), sign.tolist(), strict=True)) == {11: 1, 33: 1, 44: -1}


def likeness(x, y):
    a, b = set(fingerprints.digests(x).tolist()), set(fingerprints.digests(y).tolist())
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprint_query(spark):
    t = pq.read_table(f"{SF}/documents.parquet")
    rows = sorted(zip(t.column("doc_id").to_pylist(), (x or "" for x in t.column("text").to_pylist()), strict=True), reverse=True)
    got = {r["doc_id"]: r for r in queries.op6_fingerprints(spark, SF).collect()}
    assert len(got) == len(rows)
    by_text = {}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(likeness(text, new)) and r["near_next"] == pytest.approx(likeness(text, after))
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"] and by_text.setdefault(new, r["edited_fingerprint"]) == r["edited_fingerprint"]
    assert len(set(by_text.values())) == len(by_text)


@pytest.mark.parametrize("ids", [[5], [1, 2], [3, 3, 3], list(range(-40, 300, 7))])
def test_neighbours_over_ranges(spark, ids):
    rows = [(i, f"text number {n} of {i}. And more.") for n, i in enumerate(ids)]
    got = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), range_bytes=40).collect()
    assert len(got) == len(rows)
    if len(set(ids)) == len(ids):
        order = sorted(rows, reverse=True)
        for (i, x), (_, y) in zip(order, order[1:] + order[:1], strict=True):
            half = len(x) // 2
            assert next(r for r in got if r["doc_id"] == i)["edited_sha256"] == hashlib.sha256((x[: len(x) - half] + y[:half]).encode()).hexdigest()
