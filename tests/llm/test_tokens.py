"""Token files, BPE by automaton, packing: exact round trips and contracts against the library."""

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallystone.llm import packing, queries, token_store
from tallystone.llm.automaton import Automaton, Encoder, compiled
from tallystone.llm.common import tokenizer_path
from test_chunks import ODD, library

SF = "/root/testdata/sf0.001"


def texts():
    t = pq.read_table(f"{SF}/documents.parquet")
    return dict(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 255), max_size=700), max_size=6))
def test_any_token_is_addressable(docs):
    ids = np.array([x for d in docs for x in d], "<u4")
    keys = [None if i == 1 else i - 2 for i in range(len(docs))]
    f = token_store.TokenFile(token_store.pack(ids, keys, [len(d) for d in docs]))
    assert np.array_equal(f.ids(), ids) and f.doc_ids == keys
    assert [f.token(i) for i in range(len(ids))] == ids.tolist()
    assert f.starts.tolist() == [0, *np.cumsum([len(d) for d in docs], dtype=int).tolist()]
    with pytest.raises(IndexError):
        f.token(len(ids))


def test_store_query(spark):
    lib, at, want = library("word_bpe_49k.json"), 0, []
    for k, t in sorted(texts().items()):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((k, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, queries.op1_token_store(spark, SF).collect())) == want


def test_small_files_and_ties(spark):
    d = spark.createDataFrame([(2, "b c"), (1, "a"), (2, "d"), (None, "e"), (1, None)], "doc_id long, text string")
    m = token_store.write_store(d, token_store.scratch(spark, "few"), tokenizer_path("word_bpe_49k.json"), file_tokens=2)
    got = sorted(token_store.read_store(m).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 1, 2, 2]
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:i]) for i in range(5)]
    assert m.count() > 1


def test_automaton_equals_the_library():
    rng = random.Random(5)
    lib, enc = library("word_bpe_49k.json"), Encoder(tokenizer_path("word_bpe_49k.json"))
    letters = "abcdeéñ日 -'1,<|>"
    sample = ODD + ["".join(rng.choices(letters, k=rng.randrange(1, 50))) for _ in range(2000)] + list(texts().values())
    for t, ids in zip(sample, enc.encode_many(sample), strict=True):
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(t)
        assert enc.decode(ids) == lib.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_automaton_of_random_merges(data):
    """Against merging by rank, on vocabularies where merges overlap a lot."""
    vocab = {c: i for i, c in enumerate("ab")}
    merges = []
    for _ in range(data.draw(st.integers(1, 12))):
        pair = data.draw(st.tuples(st.sampled_from(sorted(vocab)), st.sampled_from(sorted(vocab))))
        if "".join(pair) not in vocab and len("".join(pair)) < 12:
            merges.append(list(pair))
            vocab["".join(pair)] = len(vocab)
    word = data.draw(st.text("ab", min_size=1, max_size=24))
    parts = list(word)
    rank = {tuple(m): i for i, m in enumerate(merges)}
    while True:
        found = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
        if not found:
            break
        i = min(found)[1]
        parts[i : i + 2] = ["".join(parts[i : i + 2])]
    a = Automaton({"model": {"vocab": vocab, "merges": merges}})
    assert a.spell(word) == [vocab[p] for p in parts]
    assert a.spell_many([word, word])[1] == a.spell(word)


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_compiled_table_equals_the_gadgets(data):
    """Every arc of the table, against states as sets of arcs to which the gadgets are applied one after the other."""
    vocab = {c: i for i, c in enumerate(["a", "b", "a$", "b$"])}
    merges = []
    for _ in range(data.draw(st.integers(1, 14))):
        u, v = data.draw(st.sampled_from(sorted(x for x in vocab if "$" not in x))), data.draw(st.sampled_from(sorted(vocab)))
        if u + v not in vocab and len(u + v) < 12:
            merges.append([u, v])
            vocab[u + v] = len(vocab)
    arcs = {u: {"a", "b", "a$", "b$"} for u in "ab"}
    for u, v in merges:
        if v not in arcs.get(u, ()):
            continue
        copy = set(arcs[v]) if v in arcs else None
        if copy is not None:
            arcs[u + v] = copy
        arcs[u].discard(v)
        for out in arcs.values():
            if u in out:
                out.add(u + v)
    model = {"vocab": vocab, "merges": merges, "end_of_word_suffix": "$"}
    order, table = compiled(model)
    name = {i: s for s, i in vocab.items()}
    made = [name[i] for i in order.tolist()]
    states = [s for s in made if not s.endswith("$")]
    a = Automaton({"model": model})
    for row, v in zip(table, made, strict=True):
        for k, u in enumerate(states):
            assert bool(row[k >> 3] >> (k & 7) & 1) == (v in arcs[u]) == a.open(vocab[u], vocab[v]), (u, v)


def test_bpe_query(spark):
    lib, got = library("word_bpe_49k.json"), queries.op9_bpe(spark, SF).collect()
    assert len(got) == len(texts())
    for r in got:
        ids = lib.encode(texts_once()[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


_once = {}


def texts_once():
    return _once or (_once.update(texts()) or _once)


def test_merges_of_the_file_are_whole():
    spec = json.load(open(tokenizer_path("word_bpe_49k.json")))
    a = Automaton(spec)
    for t, i in random.Random(1).sample(sorted(a.made.items()), 500):
        word = t.removesuffix("</w>")
        if t.endswith("</w>"):
            assert a.spell(word) == [i]


def test_pack_query(spark):
    lib = library("byte_bpe_50k.json")
    ids = {k: [*lib.encode(t or "", add_special_tokens=False).ids, 2] for k, t in texts().items()}
    got = queries.op8_pack(spark, SF).collect()
    by, bins = defaultdict(list), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by) == set(ids)
    for k, rows in by.items():
        rows.sort(key=lambda r: r["piece"])
        n = len(ids[k])
        assert len(rows) == -(-n // 1024) and all(r["length"] == 1024 for r in rows[1:])
        at = 0
        for i, r in enumerate(rows):
            assert (r["piece"], r["start"]) == (i, at) and r["ids_crc32"] == crc(ids[k][at : at + r["length"]])
            at += r["length"]
        assert at == n
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.02 * sum(map(len, ids.values())) / 1024 + 1


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 9), max_size=12), st.integers(0, 60))
def test_fullest_is_the_fullest(counts, room):
    got = packing.fullest(dict(counts), room)
    assert all(0 < n <= counts[k] for k, n in got)
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * i for s in sums for i in range(n + 1) if s + k * i <= room}
    assert sum(k * n for k, n in got) == max(sums)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_a_plan_packs_all(lengths):
    steps = packing.plan(dict(Counter(lengths)), 40)
    used = Counter()
    for bin_, times in steps:
        assert sum(k * n for k, n in bin_) <= 40
        for k, n in bin_:
            used[k] += n * times
    assert used == Counter(lengths)


def test_a_length_out_of_range():
    with pytest.raises(ValueError):
        packing.plan({41: 1}, 40)
