"""Operator 6: document fingerprints by invertible Bloom lookup tables.

A text is cut at line breaks and sentence ends; the k-th copy of a passage has a digest of
its own, so a text is a set of digests.  A table has three parts; each digest falls into
one cell of each, and a cell keeps a count, the xor of the digests and the xor of their
checks.  Tables of two versions subtract cell by cell, and what is left peels: a cell with
a count of one or minus one and a right check gives up its digest, which is then taken out
of its other cells.  If anything stays, both texts get a table four times as large.

Whole batches of documents are built and peeled side by side.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, ranges_of, ready
from .minhash import mix

#: Cells of a published fingerprint, and of the first table that is tried; a multiple of 3.
#: Two published tables subtract and peel for about 15 differing passages; likeness() makes larger tables from the texts for more.
CELLS = 24
#: Text that one range of documents should hold, as long as there aren't too many ranges.
RANGE_BYTES = 24 << 20
_CUT = re.compile(r"[\r\n]+|(?<=[.!?])[ \t]+")


def digests(text: str) -> np.ndarray:
    """The text's passages as 64-bit digests, repeats told apart."""
    seen: dict[str, int] = {}
    out = []
    for p in _CUT.split(text):
        if p:
            k = seen[p] = seen.get(p, -1) + 1
            out.append(xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass"), seed=k))
    return np.unique(np.array(out, np.uint64))


def _check(d: np.ndarray) -> np.ndarray:
    return mix(d ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)


def _places(d: np.ndarray, doc: np.ndarray, cells: int) -> np.ndarray:
    """The three cells of each digest, in the row of its document."""
    third = cells // 3
    h = [(mix(d ^ np.uint64(0xA0761D6478BD642F * (k + 1) + cells & 0xFFFFFFFFFFFFFFFF)) % np.uint64(third)).astype(np.int64) + k * third for k in range(3)]
    return doc * cells + np.stack(h)


def tables(sets: list[np.ndarray], cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """count, digest and check sums: a row of cells for each set."""
    d = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at, check = _places(d, doc, cells), _check(d)
    count, key, sums = np.zeros(len(sets) * cells, np.int64), np.zeros(len(sets) * cells, np.uint64), np.zeros(len(sets) * cells, np.uint64)
    for k in range(3):
        np.add.at(count, at[k], 1)
        np.bitwise_xor.at(key, at[k], d)
        np.bitwise_xor.at(sums, at[k], check)
    return count, key, sums


def peel(count: np.ndarray, key: np.ndarray, sums: np.ndarray, docs: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From subtracted tables (used up): done, and document, sign and digest of all that was recovered."""
    out = []
    look = np.flatnonzero(np.abs(count) == 1)
    while len(look):
        look = look[np.abs(count[look]) == 1]
        pure = look[sums[look] == _check(key[look])]
        if not len(pure):
            break
        doc, d, sign = pure // cells, key[pure], count[pure]
        _, once = np.unique(np.stack([doc.astype(np.uint64), d]), axis=1, return_index=True)
        doc, d, sign = doc[once], d[once], sign[once]
        out.append((doc, sign, d))
        at, check = _places(d, doc, cells), _check(d)
        for k in range(3):
            np.add.at(count, at[k], -sign)
            np.bitwise_xor.at(key, at[k], d)
            np.bitwise_xor.at(sums, at[k], check)
        look = np.unique(at.ravel())
    left = (count != 0) | (key != 0) | (sums != 0)
    done = ~left.reshape(docs, cells).any(1) if docs else np.zeros(0, bool)
    doc, sign, d = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))
    return done, doc, sign, d


def differing(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many digests each pair of sets doesn't share, by peeling; a table too small is tried again four times as large."""
    out, todo, cells = np.zeros(len(a), np.int64), np.arange(len(a)), CELLS
    while len(todo):
        x, y = tables([a[i] for i in todo], cells), tables([b[i] for i in todo], cells)
        done, doc, *_ = peel(x[0] - y[0], x[1] ^ y[1], x[2] ^ y[2], len(todo), cells)
        out[todo] = np.bincount(doc, minlength=len(todo))
        todo, cells = todo[~done], cells * 4
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> list[float]:
    """Shared digests by all of both; 1 for two empty sets."""
    d = differing(a, b).tolist()
    return [1.0 if not len(x) + len(y) else (len(x) + len(y) - n) / (len(x) + len(y) + n) for x, y, n in zip(a, b, d, strict=True)]


def published(sets: list[np.ndarray]) -> list[str]:
    """The table of CELLS cells as a string, after the number of passages."""
    count, key, sums = tables(sets, CELLS)
    cell = np.zeros(len(count), np.dtype([("n", "<u2"), ("d", "<u8"), ("c", "<u4")]))
    cell["n"], cell["d"], cell["c"] = count & 0xFFFF, key, sums
    w = CELLS * cell.itemsize
    raw = cell.tobytes()
    return [f"{len(s)}:{base64.b85encode(raw[i * w : (i + 1) * w]).decode()}" for i, s in enumerate(sets)]


def edited(text: str, after: str) -> str:
    """The last half of the code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


FIELDS = (("doc_id", pa.int64(), "long"), ("n_chars", pa.int64(), "long"), ("edited_sha256", pa.string(), "string"), ("fingerprint", pa.string(), "string"), ("edited_fingerprint", pa.string(), "string"), ("near_edited", pa.float64(), "double"), ("near_next", pa.float64(), "double"))
OUT = pa.schema([(n, t) for n, t, _ in FIELDS])


def report(ids: list[int], texts: list[str], after: list[str]) -> pa.RecordBatch:
    changed = [edited(t, x) for t, x in zip(texts, after, strict=True)]
    known: dict[str, np.ndarray] = {}

    def of(t: str) -> np.ndarray:
        if t not in known:
            known[t] = digests(t)
        return known[t]

    a, e, n = [of(t) for t in texts], [digests(t) for t in changed], [of(t) for t in after]
    sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]
    cols = (ids, [len(t) for t in texts], sha, published(a), published(e), likeness(a, e), likeness(a, n))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, OUT.types, strict=True)], schema=OUT)


def fingerprints(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """n_chars, edited_sha256, both fingerprints, near_edited and near_next for each row of doc_id, text.

    The next document is the one with the next smaller doc_id, for the smallest the largest.
    A null text is empty.  Null ids come last; rows that share an id follow a hash of their
    text.  A table of one row is its own next; an empty table gives an empty one.

    Texts are shuffled once, each range of ids to a task of its own; the first document of each range is also sent
    to the range before it, so that no neighbour is missing.
    """
    spark = docs.sparkSession
    ready(spark)
    d = docs.select("doc_id", "text")
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    stats = d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    ranges = min(ranges_of(spark, stats["b"] or 0, range_bytes), max(1, stats["n"]))
    at = [i / ranges for i in range(1, ranges)]
    cuts = d.select(F.percentile_approx(key, at, max(10_000, 10 * ranges)).alias("q")).first()["q"] if at and stats["n"] else []
    cuts = np.unique(np.array(cuts or [], np.int64))
    last = len(cuts)
    keyed = pa.schema([("part", pa.int32()), ("top", pa.int64())])

    def tops(rows):  # the largest key of each range, a row a range and task
        best = np.full(last + 1, np.iinfo(np.int64).min)
        any_ = np.zeros(last + 1, bool)
        for b in rows:
            k = b.column("k").to_numpy()
            p = last - np.searchsorted(cuts, k, "right")
            np.maximum.at(best, p, k)
            any_[p] = True
        i = np.flatnonzero(any_)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(best[i])], schema=keyed)

    found = d.select(key.alias("k")).mapInArrow(freed(tops), "part int, top long").groupBy("part").agg(F.max("top").alias("top")).collect()  # a row a range
    heads = sorted((r["part"], r["top"]) for r in found)
    before = {top: heads[i - 1][0] if i else heads[-1][0] for i, (_, top) in enumerate(heads)}  # who else needs a range's first document
    send = pa.schema([("part", pa.int32()), ("k", pa.int64()), ("turn", pa.int8()), ("doc_id", pa.int64()), ("text", pa.string())])

    def deal(rows):  # turn 1: a neighbour only, after all of the range
        for b in rows:
            k = b.column("k").to_numpy()
            p = (last - np.searchsorted(cuts, k, "right")).astype(np.int32)
            extra = [i for i, x in enumerate(k.tolist()) if x in before]
            take = pa.array([*range(len(k)), *extra])
            turn = np.zeros(len(take), np.int8)
            turn[len(k) :] = 1
            part = np.concatenate([p, np.array([before[int(k[i])] for i in extra], np.int32)])
            t = b.take(take)
            yield pa.RecordBatch.from_arrays([pa.array(part), t.column("k"), pa.array(turn), t.column("doc_id"), t.column("text")], schema=send)

    dealt = d.select(key.alias("k"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(freed(deal), "part int, k long, turn byte, doc_id long, text string")
    dealt = dealt.repartitionById(last + 1, F.col("part")).sortWithinPartitions("part", "turn", F.col("k").desc(), F.xxhash64("text"))

    def walk(rows):
        ids, texts, after, size = [], [], [], 0
        held = None  # the row before, without its next
        for b in rows:
            for part, turn, doc, text in zip(*(b.column(n).to_pylist() for n in ("part", "turn", "doc_id", "text")), strict=True):
                if held is not None and held[0] == part:
                    ids.append(held[1])
                    texts.append(held[2])
                    after.append(text)
                    size += len(text)
                    if len(ids) >= 400 or size > 4_000_000:
                        yield report(ids, texts, after)
                        ids, texts, after, size = [], [], [], 0
                held = None if turn else (part, doc, text)
        if ids:
            yield report(ids, texts, after)

    return dealt.mapInArrow(freed(walk), ", ".join(f"{n} {k}" for n, _, k in FIELDS))
