"""Operator 1: token ids in files of directly addressable codes.

An id is cut into 8-bit chunks, lowest first.  Level k holds the k-th chunk of every id
that has one, a bitmap says which ids go on to level k + 1, and a rank directory (set bits
before each 512-bit block) finds an id's place there.  Any token is read by touching one
byte, one bit and one directory entry a level; nothing else is decoded.

File: b"DAC8", levels (u32), tokens, documents (u64), document ids (i64), a byte for each
that is null, the documents' first tokens (u64, one more at the end), then each level:
entries (u64), chunks, bitmap padded to whole blocks, directory (u64).  Little-endian.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import encoder, split_words
from .common import MOST_RANGES, freed, ranges_of, ready, scratch, tokenizer_path, written

BLOCK = 512
MAGIC = b"DAC8"
#: Text that one range of documents should hold, as long as there aren't too many ranges, and tokens after which a file is closed.
RANGE_BYTES, FILE_TOKENS = 32 << 20, 6_000_000


def pack(ids: np.ndarray, doc_ids: list[int | None], sizes: list[int]) -> bytes:
    """One file's bytes."""
    ids = np.ascontiguousarray(ids, "<u4")
    levels, rest, n = [], ids, len(ids)
    while len(rest):
        more = rest > 255
        blocks = -(-len(rest) // BLOCK)
        bits = np.zeros(blocks * BLOCK // 8, np.uint8)
        packed = np.packbits(more, bitorder="little")
        bits[: len(packed)] = packed
        ones = np.bitwise_count(bits.view("<u8")).reshape(blocks, -1).sum(1, dtype=np.uint64)
        directory = (np.cumsum(ones, dtype=np.uint64) - ones).astype("<u8")
        levels.append(struct.pack("<Q", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + directory.tobytes())
        rest = rest[more] >> 8
    starts = np.zeros(len(sizes) + 1, "<u8")
    np.cumsum(sizes, out=starts[1:])
    head = MAGIC + struct.pack("<IQQ", len(levels), n, len(sizes))
    keys = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids)
    return head + keys + starts.tobytes() + b"".join(levels)


class TokenFile:
    """Reads a file's bytes (or a memory map of them)."""

    def __init__(self, data):
        self.data = data
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a token file")
        count, self.n, docs = struct.unpack_from("<IQQ", data, 4)
        at = 24
        keys = np.frombuffer(data, "<i8", docs, at)
        null = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [None if x else int(k) for k, x in zip(keys, null, strict=True)]
        at += 9 * docs
        self.starts = np.frombuffer(data, "<u8", docs + 1, at)
        at += 8 * (docs + 1)
        self.levels = []
        for _ in range(count):
            (m,) = struct.unpack_from("<Q", data, at)
            blocks = -(-m // BLOCK)
            chunks, bits, ranks = at + 8, at + 8 + m, at + 8 + m + blocks * BLOCK // 8
            self.levels.append((m, chunks, bits, ranks))
            at = ranks + 8 * blocks

    def token(self, i: int) -> int:
        """The i-th id of the file, without decoding any other."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for _, chunks, bits, ranks in self.levels:
            value |= self.data[chunks + i] << shift
            if not self.data[bits + i // 8] >> (i % 8) & 1:
                break
            block = i // BLOCK
            (rank,) = struct.unpack_from("<Q", self.data, ranks + 8 * block)
            before = int.from_bytes(self.data[bits + block * BLOCK // 8 : bits + i // 8 + 1], "little") & ((1 << (i - block * BLOCK)) - 1)
            i, shift = rank + before.bit_count(), shift + 8
        return value

    def ids(self) -> np.ndarray:
        """All ids, level by level."""
        out, where = np.zeros(self.n, "<u4"), slice(None)
        for k, (m, chunks, bits, _) in enumerate(self.levels):
            part = np.frombuffer(self.data, np.uint8, m, chunks).astype("<u4") << np.uint32(8 * k)
            out[where] |= part
            more = np.unpackbits(np.frombuffer(self.data, np.uint8, -(-m // 8), bits), bitorder="little", count=m).astype(bool)
            where = np.flatnonzero(more) if k == 0 else where[more]
        return out


def _file(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def _put(path: str, data: bytes) -> None:
    """Write under a name of this attempt's own, then rename: a retried or doubled task leaves one whole file."""
    where, name = _file(path)
    where.create_dir(name.rpartition("/")[0], recursive=True)
    own = f"{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(own) as f:
        f.write(data)
    where.move(own, name)


def read_file(path: str) -> TokenFile:
    where, name = _file(path)
    with where.open_input_stream(name) as f:
        return TokenFile(f.read())


MANIFEST = "range int, part int, path string, docs long, tokens long"
ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("file", pa.string())])


def write_store(docs: DataFrame, path: str, vocab: str, end_id: int = 1, range_bytes: int = RANGE_BYTES, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode doc_id, text into token files under path, in ascending doc_id order; returns the manifest.

    A null text is empty and so holds only the end id.  A null doc_id comes first.  Rows
    that share a doc_id are kept, ordered by a hash of their text.  An empty table writes
    no file.  Only these two columns are read.

    Texts are encoded where they are read; only ids are shuffled, each range of ids to a task of its own.
    """
    spark = docs.sparkSession
    ready(spark)
    d = docs.select("doc_id", "text")
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = ranges_of(spark, total, range_bytes)
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    cuts = d.select(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], max(10_000, 10 * ranges))).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))
    coded = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("wide", pa.bool_()), ("ids", pa.binary())])

    def encode(rows):
        enc = encoder(vocab, split_words)
        end = np.array([end_id], enc.kind if end_id < 65536 else "<u4")
        for b in rows:
            for i in range(0, b.num_rows, 200):
                c = b.slice(i, 200)
                part = np.searchsorted(cuts, c.column("k").to_numpy(), "right").astype(np.int32)
                ids = [np.concatenate((x, end)).astype(end.dtype).tobytes() for x in enc.encode(c.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(part), c.column("doc_id"), c.column("tie"), pa.array([end.itemsize > 2] * len(ids)), pa.array(ids, pa.binary())], schema=coded)

    d = d.select(key.alias("k"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text").mapInArrow(freed(encode), "part int, doc_id long, tie long, wide boolean, ids binary")
    d = d.repartitionById(ranges, F.col("part")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")

    def write(rows):
        from pyspark import TaskContext

        at, part = TaskContext.get().partitionId(), 0
        keys, parts, sizes, held = [], [], [], 0

        def close():
            nonlocal part, held
            name = f"{path}/{at:07d}-{part:05d}.dac"
            _put(name, pack(np.concatenate(parts), keys, sizes))
            out = pa.RecordBatch.from_pydict({"range": [at], "part": [part], "path": [name], "docs": [len(keys)], "tokens": [held]}, schema=pa.schema([("range", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))
            keys.clear(), parts.clear(), sizes.clear()
            part, held = part + 1, 0
            return out

        for b in rows:
            for k, wide, raw in zip(*(b.column(n).to_pylist() for n in ("doc_id", "wide", "ids")), strict=True):
                keys.append(k)
                parts.append(np.frombuffer(raw, "<u4" if wide else "<u2"))
                sizes.append(len(parts[-1]))
                held += sizes[-1]
                if held >= file_tokens:
                    yield close()
        if keys:
            yield close()

    return written(d.select("doc_id", "wide", "ids").mapInArrow(freed(write), MANIFEST), "token-manifest")


def read_store(manifest: DataFrame) -> DataFrame:
    """From the files themselves, for each document: doc_id, start, n_tokens, ids_crc32, file."""
    ready(manifest.sparkSession)
    n = min(MOST_RANGES, max(1, manifest.count()))
    # the tokens before a range, by one row a range; those before a file, within its range
    ranges = manifest.groupBy("range").agg(F.sum("tokens").alias("all"))
    ranges = ranges.select("range", (F.sum("all").over(Window.orderBy("range")) - F.col("all")).alias("before"))
    mine = F.sum("tokens").over(Window.partitionBy("range").orderBy("part")) - F.col("tokens")
    m = manifest.withColumn("mine", mine).join(ranges, "range").select("path", (F.col("before") + F.col("mine")).alias("base")).repartition(n)

    def read(rows):
        for b in rows:
            for path, base in zip(*b.to_pydict().values(), strict=True):
                f = read_file(path)
                ids, starts = f.ids(), f.starts.astype(np.int64)
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * s : 4 * e]) for s, e in zip(starts[:-1], starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip((f.doc_ids, starts[:-1] + base, np.diff(starts), crc, [path] * len(crc)), ROWS, strict=True)], schema=ROWS)

    return m.mapInArrow(freed(read), "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def token_store(docs: DataFrame, vocab: str = "word_bpe_49k.json", path: str | None = None) -> DataFrame:
    """Write a store and read it back."""
    spark = docs.sparkSession
    return read_store(write_store(docs, path or scratch(spark, "token-store"), tokenizer_path(vocab)))
