"""Operator 8: best-fit packing by minimum bin slack.

Pieces of one length are alike, so bins are planned on the histogram of lengths, which has
at most `size` entries however many documents there are.  Each plan step takes the longest
length left, finds by subset-sum over bitsets the fullest bin that holds it, and repeats
that bin as often as the lengths left allow.  A step uses up at least one length, so there
are at most `size` steps.  Pieces then find their place by their rank within their length,
which needs no step over all pieces of a length in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import encoder, split_spaced
from .common import few, freed, ready, tokenizer_path, written

SIZE = 1024
#: Pieces in a file of the result; a row has about 50 bytes.
FILE_ROWS = 2_000_000


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) of a largest sum of available lengths that is at most room; longer ones first."""
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for length in sorted(counts):
        if length > room or not counts[length]:
            continue
        left, k = min(counts[length], room // length), 1
        while left > 0:  # by powers of two, so many of one length take few steps
            take = min(k, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            left, k = left - take, k * 2
    want, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if want >= length * take and before >> want - length * take & 1:
            used[length] = used.get(length, 0) + take
            want -= length * take
    return sorted(used.items(), reverse=True)


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[list[tuple[int, int]], int]]:
    """(bin, times) steps; a bin is (length, times) pairs."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    if any(not 0 < k <= size for k in counts):
        raise ValueError("a length is out of range")
    out = []
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        rest = dict(fullest(counts, size - seed)) if size > seed else {}
        counts[seed] += 1
        rest[seed] = rest.get(seed, 0) + 1
        times = min(counts[k] // n for k, n in rest.items())
        for k, n in rest.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        out.append((sorted(rest.items(), reverse=True), times))
    return out


def runs(steps: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, first sequence, pieces a bin, offset): where the ranks of a length go."""
    out, rank, sequence = [], {}, 0
    for bin_, times in steps:
        offset = 0
        for length, n in bin_:
            out.append((length, rank.get(length, 0), sequence, n, offset))
            rank[length] = rank.get(length, 0) + n * times
            offset += length * n
        sequence += times
    return sorted(out)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def pieces(docs: DataFrame, vocab: str, end_id: int, size: int) -> DataFrame:
    """Cut doc_id, text into pieces of at most size tokens; nth counts the pieces of a length in its task."""
    ready(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(rows):
        from pyspark import TaskContext

        enc, task, seen = encoder(vocab, split_spaced), TaskContext.get().partitionId(), [0] * (size + 1)
        for b in rows:
            for i in range(0, b.num_rows, 200):
                c, out = b.slice(i, 200).to_pydict(), []
                for doc, ids in zip(c["doc_id"], enc.encode(c["text"]), strict=True):
                    ids = np.append(ids.astype("<u4"), np.uint32(end_id))
                    view, n = memoryview(ids).cast("B"), len(ids)
                    count = -(-n // size)
                    at = 0
                    for k in range(count):
                        to = n - (count - 1 - k) * size
                        length = to - at
                        out.append((doc, k, at, length, zlib.crc32(view[4 * at : 4 * to]), task, seen[length]))
                        seen[length] += 1
                        at = to
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(freed(run), PIECES)


def pack(docs: DataFrame, vocab: str = "byte_bpe_50k.json", end_id: int = 2, size: int = SIZE) -> DataFrame:
    """Pack doc_id, text into sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone.  Only documents of more than size tokens are
    cut; their first piece takes what is over.  Repeated rows and null ids are packed like
    any other; an empty table gives no row.  Other columns are not read.
    """
    ready(docs.sparkSession)
    p = written(pieces(docs, tokenizer_path(vocab), end_id, size), "pieces")
    own = p.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    own = own.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n"))
    histogram = {r["length"]: r["n"] for r in p.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    table = np.array(runs(plan(histogram, size)) or [(0, 0, 0, 1, 0)], np.int64)
    files = max(few(docs.sparkSession), -(-sum(histogram.values()) // FILE_ROWS))
    out = p.join(own.select("length", "task", "before"), ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "sequence_id", "offset"))])

    def place(rows):
        shift = np.int64(1 << 44)
        keys = table[:, 0] * shift + table[:, 1]
        for b in rows:
            if not b.num_rows:
                continue
            length, rank = (b.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            r = table[np.searchsorted(keys, length * shift + rank, "right") - 1]
            nth = rank - r[:, 1]
            cols = [b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(r[:, 2] + nth // r[:, 3]), pa.array(r[:, 4] + length * (nth % r[:, 3]))], schema=schema)

    return out.coalesce(files).mapInArrow(freed(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
