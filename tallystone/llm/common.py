"""What the operators share: the shared folder, written tables, Python batches, components."""

from __future__ import annotations

import atexit
import ctypes
import functools
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that cross to Python at once.  Small, because one document may hold megabytes; a larger row crosses alone.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20
#: Rows that a Parquet reader holds as columns at once, for the same reason; 4096 rows of documents are large arrays, and twice the heap.
READ_ROWS = 256
#: Bytes of written tables that give one more file of what is made from them.
FILE_BYTES = 8 << 20
#: Most ranges of a table that is dealt by ranges of its ids.
MOST_RANGES = 50_000

_shipped: set[str] = set()


def bounded(spark: SparkSession) -> None:
    """Bound what is read and sent to Python at once.

    These settings are the session's and stay, as plans are run after this returns; a
    smaller value of the caller's is kept.
    """
    for name, most in (("execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("execution.arrow.maxBytesPerBatch", ARROW_BYTES), ("parquet.columnarReaderBatchSize", READ_ROWS)):
        now = spark.conf.get(f"spark.sql.{name}", None)
        if not now or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.{name}", str(most))


def ready(spark: SparkSession) -> None:
    """Make this package importable on executors, and bounded()."""
    bounded(spark)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="tallystone-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    out = os.path.join(folder, f"{package.name}_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(out)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where unset, one of our own on a local master, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tallystone-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, below one folder for each application."""
    return f"{shared_dir(spark).rstrip('/')}/tallystone/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, *by: str, files: int | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back.  Survives lost executors.

    files bounds the number of files, and so of tasks, of a table that is known to be small
    beside the documents: narrow merging, no shuffle.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    w = (df.coalesce(files) if files else df).write
    w.partitionBy(*by).parquet(path) if by else w.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def bytes_of(df: DataFrame) -> int:
    """Size of a written table on disk."""
    sc = df.sparkSession.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(df._written_at)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def few(spark: SparkSession, *tables: DataFrame) -> int:
    """Files of a table of ids: as many tasks as run at once, twice; more where the written tables that it is made from are large.

    One for each FILE_BYTES of those, so that what a task reads doesn't grow with the input.
    """
    return ranges_of(spark, sum(map(bytes_of, tables)), FILE_BYTES)


def drop(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(df._written_at)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def ranges_of(spark: SparkSession, total: int, range_bytes: int) -> int:
    """How many ranges a table of so many bytes is dealt in: of range_bytes each, and larger ones beyond MOST_RANGES of them."""
    return max(2 * spark.sparkContext.defaultParallelism, min(MOST_RANGES, -(-total // range_bytes)))


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """run, and afterwards what a worker no longer uses goes back to the system, as it may idle beside other stages."""

    @functools.wraps(run)
    def whole(rows):
        try:
            yield from run(rows)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # not glibc

    return whole


#: Bits of one bitmap, and most bitmaps of a filter: 8 MB at most, however many ids it is made from.
MAP_BITS, MOST_MAPS = 32768, 2048


def split_by(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may be among ids, rows that surely aren't), so that only the first need a shuffle to be told apart.

    ids has the one column key.  A bitmap of hashed ids is broadcast, 8 MB at most; with more
    ids than that tells apart, more rows are in the first part, up to all of them.  Each row
    is in just one part; a null key is like any other.
    """
    maps = min(MOST_MAPS, 1 + 32 * ids.count() // MAP_BITS)
    bit = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(maps * MAP_BITS))
    whole = lambda b: F.floor(b / MAP_BITS).cast("int")
    built = ids.select(bit.alias("bit")).groupBy(whole(F.col("bit")).alias("at")).agg(F.bitmap_construct_agg(F.col("bit") % MAP_BITS).alias("map"))
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")  # so no name can clash
    d = df.select(own, bit.alias("bit"))
    d = d.join(F.broadcast(built), whole(d["bit"]) == built["at"], "left")
    place = F.col("bit") % MAP_BITS
    byte = F.conv(F.hex(F.substr("map", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    d = d.select("row", F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False)).alias("maybe"))
    back = [F.col("row").getField(c).alias(c) for c in df.columns]
    return d.where("maybe").select(*back), d.where("NOT maybe").select(*back)


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; found on each machine, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """What a worker keeps between tasks: one model or table at a time, so that stages of a pipeline don't pile theirs up."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def batches(rows: Iterator[pa.RecordBatch], schema: pa.Schema, f: Callable[[dict], dict]) -> Iterator[pa.RecordBatch]:
    """Apply f, from columns as lists to columns as lists or arrays, to each batch."""
    for b in rows:
        if b.num_rows:
            out = f(b.to_pydict())
            yield pa.RecordBatch.from_arrays([pa.array(out[n.name], type=n.type) for n in schema], schema=schema)


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """Connected components of an edge table, distributed: (id, component) for every id that has an edge.

    Alternating small-star and large-star steps; the fixed point is a star from each
    component's smallest id.  Every step is an equi-join on an id and a min() with map-side
    combine, so a hub's rows can be split among tasks.  Empty input gives an empty table.
    """
    before = None
    files = few(edges.sparkSession, *([edges] if hasattr(edges, "_written_at") else []))
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v")
    for _ in range(rounds):
        m = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v")))
        both = small.unionByName(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = written(large, "cc", files=files)
        if before is not None:
            drop(before)
        before = e
        # done when every edge goes from an id with no other edge to one that is no such id
        twice = e.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("w")).where("v <> w").select("u")
        inner = e.join(e.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        if twice.unionByName(inner).isEmpty():
            break
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


__all__ = ["ARROW_BYTES", "ARROW_ROWS", "batches", "bounded", "bytes_of", "components", "drop", "few", "freed", "kept", "ranges_of", "ready", "scratch", "shared_dir", "split_by", "tokenizer_path", "written"]
