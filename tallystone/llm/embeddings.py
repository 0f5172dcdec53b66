"""Operator 4: near-duplicate vectors by a forest of random-projection trees.

Equal vectors of a label form a class, which goes on once with its size.  Each tree splits
a label's vectors by random directions at the median of a bounded sample; a vector near a
split goes to both sides.  The spill is as wide as the spread that a linked pair's
difference has along a random direction, so one tree keeps a pair together but for about
one in a hundred, and TREES independent ones lose about one in 1e8.

The first splits are learned from one sample of all vectors.  A leaf that still holds more
than OVERSIZE vectors is split again by a tree learned from a sample of its own, all such
leaves side by side, until none is left or no split gains anything; so leaves don't grow
with the input.

Vectors are compared within leaves, in blocks of bounded size, in double precision.  A pair
found in several leaves counts in the smallest one the two share.  A block returns a sum of
links and a spanning star for each vector, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, few, freed, ready, written

TREES, LEAF, BLOCK = 4, 512, 1024
#: Vectors from which the first splits are learned; every vector is then routed.
SAMPLE = 20_000
#: Vectors from which a leaf is split again, about so many of it learned from, and most rounds of that.
OVERSIZE, OWN_SAMPLE, ROUNDS = 8192, 2048, 12
COSINE = 0.98


NODE = np.dtype([("direction", "<i2"), ("cut", "<f8"), ("left", "<i4"), ("right", "<i4")])


class Tree:
    """Nodes of one group's tree; a leaf has direction -1 and its number as left child."""

    __slots__ = ("cut", "direction", "left", "right")

    @classmethod
    def of(cls, nodes: np.ndarray) -> Tree:
        tree = cls()
        for name in cls.__slots__:
            setattr(tree, name, nodes[name].tolist())
        return tree

    def __init__(self):
        self.direction, self.cut, self.left, self.right = [], [], [], []

    def add(self, direction=-1, cut=0.0) -> int:
        for x, v in ((self.direction, direction), (self.cut, cut), (self.left, -1), (self.right, -1)):
            x.append(v)
        return len(self.cut) - 1


def grow(x: np.ndarray, leaf: float, spill: float, directions: np.ndarray, rng: np.random.Generator, leaves: list[int]) -> Tree:
    """Split the sampled unit vectors until a node has at most `leaf` of them or spills too much to gain."""
    tree = Tree()
    todo = [(tree.add(), np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        done = True
        if len(rows) > leaf:
            for d in rng.permutation(len(directions))[:6]:
                p = x[rows] @ directions[d]
                cut = float(np.median(p))
                low, high = rows[p <= cut + spill], rows[p >= cut - spill]
                if max(len(low), len(high)) <= 0.8 * len(rows):
                    tree.direction[node], tree.cut[node] = int(d), cut
                    tree.left[node], tree.right[node] = tree.add(), tree.add()
                    todo += [(tree.left[node], low), (tree.right[node], high)]
                    done = False
                    break
        if done:
            tree.left[node] = leaves[0]
            leaves[0] += 1
    return tree


def route(tree: Tree, projected: np.ndarray, spill: float, into: list[list[int]], rows: np.ndarray) -> None:
    """Append to into[row] every leaf that the row reaches."""
    todo = [(0, rows)]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        d = tree.direction[node]
        if d < 0:
            for r in rows.tolist():
                into[r].append(tree.left[node])
        else:
            p = projected[rows, d]
            todo += [(tree.left[node], rows[p <= tree.cut[node] + spill]), (tree.right[node], rows[p >= tree.cut[node] - spill])]


def axes(d: int, seed: int) -> np.ndarray:
    """256 random unit vectors."""
    u = np.random.default_rng([d, seed]).standard_normal((256, d))
    return u / np.linalg.norm(u, axis=1, keepdims=True)


def _drawn(share, *key: str):
    """Rows that a hash of their key draws, with the given probability."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 53)).cast("double") < share * float(1 << 53)


def unit(vecs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


PLACED = pa.schema([("grp", pa.string()), ("leaf", pa.int64()), ("rep", pa.int64()), ("size", pa.int64()), ("vec", pa.binary())])
PLACED_SQL = "grp string, leaf long, rep long, size long, vec binary"


def split_again(members: DataFrame, gap: float, leaf: int, oversize: int, own_sample: int, rounds: int) -> DataFrame:
    """members with every leaf of more than `oversize` vectors replaced by the leaves of a tree of its own.

    A leaf whose sample can't be split, as when all its vectors lie within the spill of each
    other, stays as it is.
    """
    sizes = members.groupBy("grp", "leaf").agg(F.count(F.lit(1)).alias("n"))
    whole = None
    for turn in range(1, rounds + 1):
        big = sizes.where(F.col("n") > oversize)
        if whole is not None:
            big = big.join(whole, ["grp", "leaf"], "left_anti")
        big = written(big, "large-leaves")
        if big.isEmpty():
            break
        sampled = members.join(big, ["grp", "leaf"]).where(_drawn(F.lit(float(own_sample)) / F.col("n"), "rep", "leaf")).select("grp", "leaf", "n", "vec")

        def learn(t: pa.Table) -> pa.Table:
            x = unit(t.column("vec").to_pylist())
            rng = np.random.default_rng([turn, t.column("leaf")[0].as_py() & 0xFFFFFFFF])
            least = max(8.0, leaf * len(x) / t.column("n")[0].as_py())
            tree = grow(x, least, gap / np.sqrt(x.shape[1]), axes(x.shape[1], turn), rng, [0])
            node = np.zeros(len(tree.cut), NODE)
            node["direction"], node["cut"], node["left"], node["right"] = tree.direction, tree.cut, tree.left, tree.right
            return pa.table({"grp": t.column("grp").slice(0, 1), "leaf": t.column("leaf").slice(0, 1), "tree": pa.array([node.tobytes()], pa.binary())})

        trees = written(sampled.groupBy("grp", "leaf").applyInArrow(learn, "grp string, leaf long, tree binary"), "leaf-trees")
        # a leaf of one node, or without a sample, can't be split
        stuck = big.select("grp", "leaf").join(trees.where(F.length("tree") > NODE.itemsize), ["grp", "leaf"], "left_anti")
        whole = written(stuck if whole is None else whole.unionByName(stuck), "whole-leaves")

        def deal(rows):
            known: dict[bytes, Tree] = {}
            for b in rows:
                vec, told, leaves = b.column("vec").to_pylist(), b.column("tree").to_pylist(), b.column("leaf").to_pylist()
                into: list[list[int]] = [[] for _ in vec]
                by: dict[bytes | None, list[int]] = {}
                for i, x in enumerate(told):
                    by.setdefault(x, []).append(i)
                for raw, rows_ in by.items():
                    if raw is None:
                        for i in rows_:
                            into[i].append(-1)
                        continue
                    if raw not in known:
                        known.clear() if len(known) > 64 else None
                        known[raw] = Tree.of(np.frombuffer(raw, NODE))
                    x = unit([vec[i] for i in rows_])
                    at = np.array(rows_)
                    p = np.zeros((len(vec), 256))
                    p[at] = x @ axes(x.shape[1], turn).T
                    route(known[raw], p, gap / np.sqrt(x.shape[1]), into, at)
                take = np.repeat(np.arange(len(vec)), [len(x) for x in into])
                t = b.select(["grp", "rep", "size", "vec"]).take(pa.array(take))
                new = [leaves[i] if y < 0 else xxhash.xxh3_64_intdigest(f"{leaves[i]}:{turn}:{y}") >> 1 for i, x in enumerate(into) for y in x]
                yield pa.RecordBatch.from_arrays([t.column(0), pa.array(new, pa.int64()), t.column(1), t.column(2), t.column(3)], schema=PLACED)

        usable = trees.where(F.length("tree") > NODE.itemsize)
        members = written(members.join(usable, ["grp", "leaf"], "left").select("grp", "leaf", "rep", "size", "vec", "tree").mapInArrow(freed(deal), PLACED_SQL), "leaves")
        sizes = members.groupBy("grp", "leaf").agg(F.count(F.lit(1)).alias("n"))
    return members


def near_vectors(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, oversize: int = OVERSIZE, own_sample: int = OWN_SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vec_id, embedding, label.

    Vectors link when labels (and lengths) are equal and their cosine is at least `cosine`.
    A vector that is null, empty, zero or has a null or non-finite component, and one with
    a null label, links with nothing.  A null vec_id gets a null component and isn't kept;
    such a row doesn't link.  Repeated rows link as equal vectors.  An empty table gives an
    empty one; other columns are not read.
    """
    spark = vectors.sparkSession
    ready(spark)
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    schema = pa.schema([("vec_id", pa.int64()), ("grp", pa.string()), ("vec", pa.binary()), ("same", pa.binary())])

    def clean(rows):
        for b in rows:
            ids, groups, vecs, same = b.column("vec_id").to_pylist(), [], [], []
            for i, x, g in zip(ids, b.column("embedding"), b.column("label").to_pylist(), strict=True):
                a = None
                if x.is_valid and g is not None and i is not None and len(x.values) and not x.values.null_count:
                    a = x.values.to_numpy(zero_copy_only=False)
                    if not np.isfinite(a).all() or not a.any():
                        a = None
                groups.append(None if a is None else f"{len(a)}:{g}")
                a = None if a is None else (a + 0.0).tobytes()  # -0.0 and 0.0 are equal
                vecs.append(a)
                same.append(None if a is None else xxhash.xxh3_128_digest(a))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(groups, pa.string()), pa.array(vecs, pa.binary()), pa.array(same, pa.binary())], schema=schema)

    rows = written(v.mapInArrow(freed(clean), "vec_id long, grp string, vec binary, same binary"), "vectors")
    valid = rows.where("grp is not null")
    own = valid.groupBy("grp", "same").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    reps = valid.join(own, ["grp", "same"]).where("vec_id = rep").dropDuplicates(["grp", "rep"]).select("grp", "same", "rep", "size", "vec")
    reps = written(reps, "vector-classes")

    total = reps.count()
    share = min(1.0, sample / max(1, total))
    drawn = reps.where(_drawn(F.lit(share), "rep")).select("grp", "rep", "vec").toArrow()  # about `sample` rows
    order = np.argsort(drawn.column("rep").to_numpy(), kind="stable") if drawn.num_rows else []
    groups, by = drawn.column("grp").to_pylist(), {}
    raw = drawn.column("vec").to_pylist()
    for i in order:
        by.setdefault(groups[i], []).append(np.frombuffer(raw[i], np.float64))
    rng, count, forest, directions = np.random.default_rng(7), [0], {}, {}
    gap = np.sqrt(max(0.0, 2 - 2 * cosine))
    for g in sorted(by):
        x = np.array(by[g])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        d = x.shape[1]
        if d not in directions:
            directions[d] = axes(d, 0)
        forest[g] = [grow(x, max(8.0, leaf * share), gap / np.sqrt(d), directions[d], rng, count) for _ in range(trees)]
    learned = spark.sparkContext.broadcast((forest, directions))  # bounded by the sample

    def place(rows):
        forest, directions = learned.value
        for b in rows:
            g, vec = b.column("grp").to_pylist(), b.column("vec").to_pylist()
            into: list[list[int]] = [[] for _ in g]
            for name in set(g):
                at = np.array([i for i, y in enumerate(g) if y == name])
                if name not in forest:
                    for i in at.tolist():
                        into[i].append(-1)  # a group too small for the sample is one leaf
                    continue
                x = unit([vec[i] for i in at])
                d = x.shape[1]
                p = np.zeros((len(g), len(directions[d])))
                p[at] = x @ directions[d].T
                for tree in forest[name]:
                    route(tree, p, gap / np.sqrt(d), into, at)
            n = [len(x) for x in into]
            take = np.repeat(np.arange(len(g)), n)
            t = b.select(["grp", "rep", "size", "vec"]).take(pa.array(take))
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array([y for x in into for y in x], pa.int64()), t.column(1), t.column(2), t.column(3)], schema=PLACED)

    members = written(reps.select("grp", "rep", "size", "vec").mapInArrow(freed(place), PLACED_SQL), "leaves")
    members = split_again(members, gap, leaf, oversize, own_sample, ROUNDS)
    reached = members.groupBy("grp", "rep").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))  # a vector's few leaves
    members = members.join(reached, ["grp", "rep"])
    sizes = members.groupBy("grp", "leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    m = members.join(sizes, ["grp", "leaf"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    m = m.select("grp", "leaf", "rep", "size", "vec", "leaves", "block", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    found = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def compare(t: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(t.column("vec").to_pylist()), np.float64).reshape(t.num_rows, -1)
        norm, size, rep, block = np.sqrt((x * x).sum(1)), t.column("size").to_numpy(), t.column("rep").to_numpy(), t.column("block").to_numpy()
        here, i, j = t.column("leaf")[0].as_py(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
        lists = t.column("leaves").to_pylist()
        wide = max(map(len, lists))
        leaves = np.full((len(lists), wide), -2, np.int64)
        for r, y in enumerate(lists):
            leaves[r, : len(y)] = y
        a, b = (np.arange(len(x)), np.arange(len(x))) if i == j else (np.flatnonzero(block == i), np.flatnonzero(block == j))
        near = (x[a] @ x[b].T) / (norm[a][:, None] * norm[b][None, :]) >= cosine
        if i == j:
            near = np.triu(near, 1)
        p, q = np.nonzero(near)
        p, q = a[p], b[q]
        links, keep = np.zeros(len(x), np.int64), np.ones(len(p), bool)
        for s in range(0, len(p), 20_000):
            l, r = leaves[p[s : s + 20_000]], leaves[q[s : s + 20_000]]
            keep[s : s + 20_000] = ~((l[:, :, None] == r[:, None, :]) & (l[:, :, None] >= -1) & (l[:, :, None] < here)).any((1, 2))
        np.add.at(links, p[keep], size[q[keep]])
        np.add.at(links, q[keep], size[p[keep]])
        root = rep.copy()
        while len(p):
            low = np.minimum(root[p], root[q])
            new = root.copy()
            np.minimum.at(new, p, low)
            np.minimum.at(new, q, low)
            if (new == root).all():
                break
            root = new
        some = (links > 0) | (root != rep)
        return pa.Table.from_arrays([pa.array(rep[some]), pa.array(links[some]), pa.array(root[some])], schema=found)

    told = written(m.groupBy("grp", "leaf", "i", "j").applyInArrow(compare, "rep long, links long, root long"), "links")
    comp = components(told.where("rep <> root"), "rep", "root").withColumnRenamed("id", "rep")
    links = told.groupBy("rep").agg(F.sum("links").alias("links"))
    of = reps.select("grp", "same", "rep", "size").join(links, "rep", "left").join(comp, "rep", "left")
    out = rows.select("vec_id", "grp", "same").join(of, ["grp", "same"], "left")
    n_links = F.coalesce(F.col("size") - 1 + F.coalesce("links", F.lit(0)), F.lit(0))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "rep", "vec_id"))
    return out.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
