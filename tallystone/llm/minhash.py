"""Operator 10: near duplicates by fast similarity sketches, bands and exact checks.

A sketch has T coordinates.  In round i < T every shingle falls into one hashed bin with a
value of round i; a bin keeps its least (round, value).  Rounds end once all bins are full;
from round T on, round T + j puts every shingle into bin j, so every bin fills.  Two
sketches agree in a coordinate with about the sets' similarity, concentrated as for T
independent hashes.

Documents with equal shingle sets form a class first and only its smallest doc_id goes on.
Bands of equal coordinates give buckets.  A bucket's hub is its most central member, the
one with the most company over all its buckets, and is compared with all others.  Buckets
that then still join several components go on: small ones by their pairs, larger ones by
clusters of all buckets with one hub.  A cluster is dealt in blocks, what its largest part
already joins apart from the rest, and each task compares a block of the rest with another
block by sketches and then by full sets, and returns a forest of links, not its pairs.  A
pair of several clusters is compared in the first.  So no two members of a bucket are left
uncompared unless they are joined already, and every link is confirmed on both full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop, few, freed, ready, split_by, written

T, ROWS, BANDS = 128, 4, 32
#: Pairs whose sketches agree in fewer coordinates than this share are not compared; true pairs of 0.8 fall below it about once in 1e7.
LEAST = 0.60
#: Buckets up to this size are finished by comparing all their pairs, larger ones in blocks of about so many documents and bytes of shingle sets.
SMALL, BLOCK, BLOCK_BYTES = 8, 1024, 16 << 20
M = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash; starts anew when large."""

    def __missing__(self, w: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_hashes = WordHashes()


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words one of all; none without words.

    A-Z count as lower case; words are runs without the six ASCII white-space characters.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - k + 1)
    h = np.full(n, min(k, len(w)), np.uint64)
    for i in range(min(k, len(w))):
        h = (h * M) + w[i : i + n]
    return np.unique(mix(h))


def sketch(s: np.ndarray, t: int = T) -> np.ndarray:
    """The t coordinates of a set of hashes, not empty."""
    best = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, -(-6 * t // len(s)))  # so many rounds at once fill most sketches
    for first in range(0, t, step):
        rounds = np.arange(first, min(t, first + step), dtype=np.uint64)[:, None]
        h = mix(s[None, :] ^ mix((rounds + np.uint64(1)) * M))
        value = (rounds << np.uint64(48)) | (h >> np.uint64(16))
        np.minimum.at(best, (h & np.uint64(t - 1)).astype(np.int64).ravel(), value.ravel())
        if best.max() >> np.uint64(48) < t:
            return best
    for j in np.flatnonzero(best == np.iinfo(np.uint64).max):
        best[j] = (np.uint64(t + int(j)) << np.uint64(48)) | (mix(s ^ mix(np.uint64([t + int(j) + 1]) * M)) >> np.uint64(16)).min()
    return best


def band_keys(best: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key a band, the band's number hashed in."""
    v = best[: rows * bands].reshape(bands, rows)
    h = np.arange(1, bands + 1, dtype=np.uint64) * M
    for i in range(rows):
        h = mix(h ^ v[:, i]) * M
    return mix(h).view(np.int64)


SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("sketch", pa.binary()), ("keys", pa.list_(pa.int64()))])


def signatures(docs: DataFrame, k: int) -> DataFrame:
    def run(rows):
        for b in rows:
            c = b.to_pydict()
            sets = [shingles(t, k) for t in c["text"]]
            best = [sketch(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(c["doc_id"], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([None if x is None else (x & np.uint64(0xFFFF)).astype("<u2").tobytes() for x in best], pa.binary()),
                    pa.array([None if x is None else band_keys(x) for x in best], pa.list_(pa.int64())),
                ],
                schema=SIGNED,
            )

    return docs.select("doc_id", "text").mapInArrow(freed(run), "doc_id long, n_shingles long, set_hash binary, sketch binary, keys array<long>")


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id and set: the sorted shingle hashes, 8 bytes each.  Verified sets are made once from each text, not once a pair."""

    def run(rows):
        for b in rows:
            sets = [shingles(t, k).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.binary())], names=["doc_id", "set"])

    return docs.select("doc_id", "text").mapInArrow(freed(run), "doc_id long, set binary")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Are two sorted sets alike enough?  Sets whose sizes alone forbid it are not merged."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def verified(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (hub, doc) whose full sets are similar enough, as (a, b) with a < b.

    The sketches of a pair are compared first.  A hub's partners are dealt in blocks, and
    its own set goes once to each block, however many partners it has.
    """

    def likely(rows):
        for b in rows:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(n).to_pylist()), "<u2").reshape(b.num_rows, T) for n in ("sx", "sy"))
            keep = pa.array((x == y).mean(1) >= LEAST)
            yield b.select(["hub", "doc"]).filter(keep)

    def same(rows):
        at, known = None, None
        for b in rows:
            out = []
            for hub, part, doc, s in zip(*(b.column(n).to_pylist() for n in ("hub", "part", "doc")), b.column("set"), strict=True):
                x = np.frombuffer(s.as_buffer(), "<u8")
                if doc is None:  # comes first in its block
                    at, known = (hub, part), x
                else:
                    assert at == (hub, part)
                    if similar(known, x, percent):
                        out.append((min(hub, doc), max(hub, doc)))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], schema=PAIR)

    near = pairs.join(sketches.select(F.col("doc_id").alias("doc"), F.col("sketch").alias("sy")), "doc").join(sketches.select(F.col("doc_id").alias("hub"), F.col("sketch").alias("sx")), "hub")
    spark = pairs.sparkSession
    near = written(near.select("hub", "doc", "sx", "sy").mapInArrow(freed(likely), "hub long, doc long"), "likely-pairs", files=few(spark, sketches))
    own = sets.select(F.col("doc_id").alias("doc"), "set")
    # partners are read one by one, so a task holds a hub's set and one other, however long a block is
    blocks = near.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = near.join(blocks, "hub").withColumn("part", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).select("hub", "part", "doc")
    partners = dealt.join(own, "doc").select("hub", "part", "doc", "set")
    heads = dealt.select("hub", "part").distinct().join(own.withColumnRenamed("doc", "hub"), "hub").select("hub", "part", F.lit(None).cast("long").alias("doc"), "set")
    both = partners.unionByName(heads).repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("doc").asc_nulls_first())
    return both.mapInArrow(freed(same), "a long, b long")


def compared(many: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A forest of the links between different components c among the docs of each hub; many: distinct (hub, doc, c)."""
    many = many.join(sets.select(F.col("doc_id").alias("doc"), F.octet_length("set").alias("bytes")), "doc")
    parts = many.groupBy("hub", "c").agg(F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("bytes"))
    most = lambda size, bytes_: F.ceil(F.greatest(size / BLOCK, bytes_ / BLOCK_BYTES)).cast("int")
    largest = parts.groupBy("hub").agg(F.max(F.struct("size", "bytes", "c")).alias("top"), F.sum("size").alias("all"), F.sum("bytes").alias("heft"))
    largest = largest.select("hub", F.col("top.c").alias("top"), most(F.col("top.size"), F.col("top.bytes")).alias("main"), most(F.col("all") - F.col("top.size"), F.col("heft") - F.col("top.bytes")).alias("rest")).where("rest > 0")
    m = many.join(written(largest, "hubs", files=few(many.sparkSession, sets)), "hub")  # written, so that a hub of very many rows can be split
    own = F.pmod(F.xxhash64("doc"), F.when(F.col("c") == F.col("top"), F.col("main")).otherwise(F.col("rest"))).cast("int")
    m = m.withColumn("block", F.when(F.col("c") == F.col("top"), own).otherwise(F.col("main") + own))
    hubs = many.groupBy("doc").agg(F.sort_array(F.collect_set("hub")).alias("hubs"))  # one a band at most
    blocks = F.when(F.col("c") == F.col("top"), F.sequence("main", F.col("main") + F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("main") + F.col("rest") - 1))
    m = m.select("hub", "doc", "c", "block", F.explode(blocks).alias("other")).select("hub", "doc", "c", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    m = m.join(hubs, "doc").join(sketches.select(F.col("doc_id").alias("doc"), "sketch"), "doc").join(sets.select(F.col("doc_id").alias("doc"), "set"), "doc")

    def block(t: pa.Table) -> pa.Table:
        doc, c, where = (t.column(n).to_numpy() for n in ("doc", "c", "block"))
        here, i, j = t.column("hub")[0].as_py(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
        s = np.frombuffer(b"".join(t.column("sketch").to_pylist()), "<u2").reshape(len(doc), T)
        hubs, raw = [set(x) for x in t.column("hubs").to_pylist()], t.column("set")
        a, b = np.flatnonzero(where == i), np.flatnonzero(where == j)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := root.get(x, x)) != x:
                root[x] = root.get(y, y)
                x = y
            return x

        def of(x: int) -> np.ndarray:
            return np.frombuffer(raw[x].as_buffer(), "<u8")

        out: list[tuple[int, int]] = []
        for x in a.tolist():
            alike = (s[b] == s[x]).mean(1)
            for y in b[(alike >= LEAST) & (c[b] != c[x]) & ((doc[b] > doc[x]) | (i != j))].tolist():
                u, v = find(int(c[x])), find(int(c[y]))
                if u == v or min(hubs[x] & hubs[y]) < here:
                    continue
                if similar(of(x), of(y), percent):
                    root[max(u, v)] = min(u, v)
                    out.append((min(int(doc[x]), int(doc[y])), max(int(doc[x]), int(doc[y]))))
        return pa.Table.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], schema=PAIR)

    return m.groupBy("hub", "i", "j").applyInArrow(block, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of doc_id, text.

    Texts link when 100 * intersection >= percent * union of their k-word shingle sets.
    Null and empty texts, and those without words, have no set and link with nothing; a row
    with a null doc_id gets a null component and isn't kept.  Rows that share a doc_id are
    one node.  An empty table gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    ready(spark)
    docs = docs.select("doc_id", "text")
    sig = written(signatures(docs, k), "signatures")
    small = few(spark, sig)
    nodes = sig.where("doc_id is not null and n_shingles > 0")
    classes = nodes.groupBy("set_hash").agg(F.min("doc_id").alias("rep"))
    reps = written(nodes.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "sketch", "keys"), "representatives")
    rows = reps.select(F.explode("keys").alias("key"), F.col("doc_id").alias("doc"))
    shared = written(rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key"), "shared-keys", files=small)
    central = shared.groupBy("doc").agg(F.sum("n").alias("company"))
    hubs = shared.join(central, "doc").groupBy("key").agg(F.max(F.struct("company", F.bitwise_not("doc").alias("d"))).alias("h")).select("key", F.bitwise_not("h.d").alias("hub"))
    member = written(shared.join(hubs, "key"), "members", files=small)
    named = member.select(F.col("doc").alias("doc_id")).distinct()
    sets = split_by(docs, "doc_id", named)[0].join(named, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = written(shingle_sets(sets, k), "shingle-sets")
    wide = few(spark, reps, sets)  # of what is made by comparing sketches and sets

    star = member.where("doc <> hub").select("hub", "doc").distinct()
    first = written(verified(star, reps, sets, percent), "links", files=wide)
    comp = components(first, "a", "b").withColumnRenamed("id", "doc")
    state = member.join(comp, "doc", "left").select("key", "doc", "hub", "n", F.coalesce("component", "doc").alias("c"))
    several = state.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    state = written(state.where("n > 2").join(several, "key", "left_semi"), "open", files=small)
    pairs = state.where(F.col("n") <= SMALL).groupBy("key").agg(F.collect_list(F.struct("doc", "c")).alias("x"))
    pairs = pairs.select(F.explode("x").alias("l"), "x").select("l", F.explode("x").alias("r")).where("l.doc < r.doc and l.c <> r.c").select(F.col("l.doc").alias("hub"), F.col("r.doc").alias("doc"))
    many = state.where(F.col("n") > SMALL).select("hub", "doc", "c").distinct()
    found = verified(pairs.distinct(), reps, sets, percent).unionByName(compared(many, reps, sets, percent))
    links = written(first.unionByName(found), "links", files=wide)
    comp = components(links, "a", "b")
    drop(shared, member, sets, state, first, reps)

    # written, so that the join below stands alone in its stage and a class of very many rows can be split
    of = classes.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("set_hash", F.coalesce("component", "rep").alias("component"))
    of = written(of, "classes", files=small)
    out = sig.select("doc_id", "n_shingles", "set_hash").join(of, "set_hash", "left")
    mine = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", mine.alias("component_id"), F.coalesce(F.col("doc_id") == mine, F.lit(False)).alias("kept"))
