"""Operator 5: language ID by prediction by partial matching over bytes.

Each language has a tree of byte contexts up to ORDER long with the counts of what follows,
learned once and frozen.  The code length of a byte is -log2 of its PPM-C probability: from
the longest known context down, a context gives count / (total + distinct) to what it has
seen and distinct / (total + distinct) to the escape, and what it has seen is excluded
below; at the bottom all bytes left are alike.  A text's code length is the sum over its
bytes, and the shortest code wins.

What has been seen after a context has been seen after all shorter ones, so what is excluded
at a level depends only on the context one byte longer: its counts and a few numbers for
each context give every code length exactly, in space that grows with what was learned.  As
the statistics are frozen, a worker keeps the code lengths of grams that it has met.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, kept, ready

ORDER = 3
#: About so many training texts a language, drawn by a hash of doc_id; the only bound, and only on learning.
TRAIN_DOCS = 500
START = 0xFF  # no byte of UTF-8: stands before a text
#: Bytes of code lengths that a worker keeps, and most languages whose sizes are broadcast.
KEPT_BYTES, FEW_LANGUAGES = 32 << 20, 10_000


def grams(text: str) -> np.ndarray:
    """Codes of a text's bytes, each with the ORDER before it."""
    b = np.frombuffer(bytes([START] * ORDER) + text.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    code = np.zeros(len(b) - ORDER, np.uint32)
    for i in range(ORDER + 1):
        code = (code << np.uint32(8)) | b[i : len(b) - ORDER + i]
    return code


class Model:
    """Exact code lengths from (language, gram, count) triples.

    Sparse: an entry for each byte seen after a context in a language, and four numbers for
    each context.  Keys have the language and the context's length above the gram's bytes.
    """

    def __init__(self, languages: list[str], lang: np.ndarray, gram: np.ndarray, count: np.ndarray):
        self.languages = languages
        keys, counts = [], []
        for k in range(ORDER + 1):
            key, where = np.unique((lang.astype(np.uint64) * np.uint64(ORDER + 1) + np.uint64(k)) << np.uint64(32) | gram.astype(np.uint64) & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            keys.append(key)
            counts.append(np.bincount(where, count, len(key)))
        key, n = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key)
        self.seen, n = key[order], n[order]
        self.bits_of_seen = np.log2(n).astype(np.float64)
        # a context's key is that of its bytes' entries without the byte; ORDER + 1 of them for each language
        head = (self.seen >> np.uint64(32) << np.uint64(24)) | (self.seen & np.uint64(0xFFFFFFFF)) >> np.uint64(8)
        self.contexts, where = np.unique(head, return_inverse=True)
        total = np.bincount(where, n, len(self.contexts))
        distinct = np.bincount(where, minlength=len(self.contexts)).astype(np.float64)
        # what the context one byte shorter has seen, and how much of that this one has seen too
        length = (self.seen >> np.uint64(32)) % np.uint64(ORDER + 1)
        longer = np.flatnonzero(length > 0)
        shorter = self._shorter(self.seen[longer])
        excluded = np.bincount(where[longer], n[np.searchsorted(self.seen, shorter)], len(self.contexts))
        up = np.zeros(len(self.contexts), np.int64)
        up[where[longer]] = where[np.searchsorted(self.seen, shorter)]
        log = lambda x: np.log2(np.maximum(x, 1e-300))
        self.norm, self.escape = np.log2(total + distinct), np.log2(total + distinct) - np.log2(distinct)
        rest, kinds = total[up] - excluded, distinct[up] - distinct
        self.norm_below = log(rest + kinds)
        self.escape_below = np.where(kinds > 0, self.norm_below - log(kinds), 0.0)  # nothing is left there: no escape is coded
        self.bottom = np.zeros(len(languages))
        for i in range(len(languages)):
            at = np.searchsorted(self.contexts, np.uint64(i * (ORDER + 1) << 24))
            known = at < len(self.contexts) and self.contexts[at] == i * (ORDER + 1) << 24
            self.bottom[i] = np.log2(max(1, 256 - (distinct[at] if known else 0)))
        #: Grams met so far, by a hash of theirs, and their code lengths; a place holds the last gram put there.
        size = 1 << min(18, max(12, (KEPT_BYTES // (4 * max(1, len(languages)))).bit_length() - 1))
        self.met, self.costs = np.full(size, -1, np.int64), np.zeros((size, len(languages)), np.float32)
        self.shift = np.uint32(32 - size.bit_length() + 1)

    @staticmethod
    def _shorter(key: np.ndarray) -> np.ndarray:
        """The entry of the same byte after a context one byte shorter."""
        k = (key >> np.uint64(32)) % np.uint64(ORDER + 1)
        return ((key >> np.uint64(32)) - np.uint64(1) << np.uint64(32)) | key & ((np.uint64(1) << np.uint64(8) * k) - np.uint64(1))

    def lengths(self, gram: np.ndarray) -> np.ndarray:
        """Code lengths of grams: a row for each, a column for each language."""
        gram, out = gram.astype(np.uint64), np.empty((len(gram), len(self.languages)))
        for l in range(len(self.languages)):
            cost, live, child = np.zeros(len(gram)), np.arange(len(gram)), np.full(len(gram), -1, np.int64)
            for k in range(ORDER, -1, -1):
                if not len(live):
                    break
                base, g = np.uint64(l * (ORDER + 1) + k), gram[live] & np.uint64((1 << 8 * (k + 1)) - 1)
                key = base << np.uint64(32) | g
                at = np.minimum(np.searchsorted(self.seen, key), len(self.seen) - 1)
                found = self.seen[at] == key
                head = base << np.uint64(24) | g >> np.uint64(8)
                c = np.minimum(np.searchsorted(self.contexts, head), len(self.contexts) - 1)
                known, below = self.contexts[c] == head, child[live]
                norm = np.where(below >= 0, self.norm_below[below], self.norm[c])
                escape = np.where(below >= 0, self.escape_below[below], self.escape[c])
                cost[live] += np.where(found, norm - self.bits_of_seen[at], np.where(known, escape, 0.0))
                child[live] = np.where(known, c, below)
                live = live[~found]
            cost[live] += self.bottom[l]
            out[:, l] = cost
        return out

    def bits(self, texts: list[str]) -> np.ndarray:
        """Code lengths: a row for each text, a column for each language."""
        out = np.zeros((len(texts), len(self.languages)))
        raw = [t.encode("utf-8", "replace") for t in texts]
        pad, i = bytes([START] * ORDER), 0
        while i < len(raw):
            j, size = i, 0
            while j < len(raw) and (j == i or size + len(raw[j]) < 1 << 20):
                size += len(raw[j])
                j += 1
            data = np.frombuffer(b"".join(pad + r for r in raw[i:j]) + pad, np.uint8)
            for k, r in zip(range(i, j), raw[i:j], strict=True):
                if len(r) > 1 << 20:  # a very long text, in steps
                    for a in range(0, len(r), 1 << 20):
                        part = (pad + r)[a : a + ORDER + (1 << 20)]
                        out[k] += self._costs(np.frombuffer(part, np.uint8)).sum(0, dtype=np.float64)
            if size <= 1 << 20:
                cost = self._costs(data)
                starts = np.cumsum([0] + [len(r) + ORDER for r in raw[i:j]])
                full = np.concatenate([np.zeros((1, cost.shape[1])), np.cumsum(cost, 0, dtype=np.float64)])
                out[i:j] = full[starts[1:] - ORDER] - full[starts[:-1]]
            i = j
        return out

    def _costs(self, data: np.ndarray) -> np.ndarray:
        """Code lengths of data[ORDER:], each byte after those before it."""
        n = len(data) - ORDER
        code = np.zeros(n, np.uint32)
        for i in range(ORDER + 1):
            code = (code << np.uint32(8)) | data[i : n + i]
        at = (code * np.uint32(0x9E3779B1)) >> self.shift
        miss = np.flatnonzero(self.met[at] != code)
        if not len(miss):
            return self.costs[at]
        new = np.unique(code[miss])
        found, place = self.lengths(new).astype(np.float32), (new * np.uint32(0x9E3779B1)) >> self.shift
        out = self.costs[at]
        out[miss] = found[np.searchsorted(new, code[miss])]
        _, last = np.unique(place[::-1], return_index=True)  # one gram a place
        last = len(new) - 1 - last
        self.met[place[last]], self.costs[place[last]] = new[last], found[last]
        return out


def learn(train: DataFrame, train_docs: int = TRAIN_DOCS) -> dict:
    """Counts for Model from the rows of train (doc_id, text, lang; no nulls in text and lang).

    The driver gets the distinct grams of at most about train_docs texts a language.
    """
    sizes = train.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) * F.col("rows") < F.lit(train_docs * 1_000_000)
    sizes = F.broadcast(sizes) if sizes.limit(FEW_LANGUAGES + 1).count() <= FEW_LANGUAGES else sizes  # a row a language
    drawn = train.join(sizes, "lang").where(share).select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(rows):
        held: dict[str, list[np.ndarray]] = {}

        def close():
            for lang, parts in held.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], schema=schema)
            held.clear()

        size = 0
        for b in rows:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                held.setdefault(lang, []).append(grams(text))
                size += len(text)
                if size > 4_000_000:
                    yield from close()
                    size = 0
        yield from close()

    got = drawn.mapInArrow(freed(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    place = {x: i for i, x in enumerate(langs)}
    lang = np.array([place[x] for x in got.column("lang").to_pylist()], np.int64)
    order = np.lexsort((got.column("gram").to_numpy(), lang))
    return {"languages": langs, "lang": lang[order], "gram": got.column("gram").to_numpy()[order], "count": got.column("n").to_numpy()[order]}


def held_out(doc_id: str = "doc_id"):
    """Rows that nothing is learned from: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def predictor(docs: DataFrame, train_docs: int = TRAIN_DOCS):
    """Learn from docs; gives a function from texts to languages and scores, to run on executors."""
    ready(docs.sparkSession)
    train = docs.where(~held_out()).where("text is not null and lang is not null and length(text) > 0").select("doc_id", "text", "lang")
    learned = docs.sparkSession.sparkContext.broadcast(learn(train, train_docs))  # bounded by train_docs
    key = uuid.uuid4().hex

    def made() -> Model | None:
        got = learned.value
        return Model(got["languages"], got["lang"], got["gram"], got["count"]) if got["languages"] else None

    def predict(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        model = kept(("language", key), made)
        texts = [t if t and any(map(str.isalpha, t)) else "" for t in texts]
        pred, score = ["und"] * len(texts), np.zeros(len(texts))
        if model is not None and texts:
            bits = model.bits(texts)
            best = bits.argmin(1)
            share = 1 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000)).sum(1)
            for i, t in enumerate(texts):
                if t:
                    pred[i], score[i] = model.languages[best[i]], share[i]
        return pred, score

    return predict


OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, lang_pred, score for each row of doc_id, text, lang.

    Learns from rows with text and lang that aren't held out.  A text that is null, empty or
    without a letter is `und` with score 0, and so is every text if nothing could be learned.
    score is the winner's share of 2^-bits over all languages.  Ties go to the first
    language by name.  Rows are independent; null ids and repeated rows stay, other columns
    are not read.
    """
    predict = predictor(docs, train_docs)

    def run(rows):
        for b in rows:
            pred, score = predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], schema=OUT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(freed(run), "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, least: float = 0.5, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The rows whose language is one of those learned, with a score of at least `least`; all columns, unchanged."""
    predict = predictor(docs, train_docs)

    def run(rows):
        for b in rows:
            pred, score = predict(b.column("text").to_pylist())
            yield b.filter(pa.array([p != "und" and s >= least for p, s in zip(pred, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(freed(run), docs.schema)
