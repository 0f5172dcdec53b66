"""Operator 7: quality by regularised quadratic discriminant analysis.

Each text becomes a few statistics, transformed towards a normal shape.  A class has a mean
and a covariance, shrunk towards the pooled one and a multiple of the identity; the score is
the posterior of label 1, from the difference of two log densities, each by the Mahalanobis
distance through a Cholesky factor worked out once.  Sums, not rows, reach the driver.
"""

from __future__ import annotations

import operator
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, ready, split_by, written
from .language import held_out

NAMES = ("length", "word", "upper", "mark", "distinct", "top", "again", "line_again", "marked_words", "bars", "triple", "capital_words", "ends", "spread")
#: Shares of the pooled covariance and of the identity in a class's covariance.
POOL, RIDGE = 0.1, 0.02
#: Usual words added to every text, so that a short one isn't odd for being short.
PRIOR = 15
#: Longer words count as this long: one key or address doesn't make a short text odd.
LONGEST = 20
THRESHOLD = 0.7
_KIND = np.zeros(256, np.int64)  # 1 upper, 2 lower, 3 digit, 4 mark, 5 white space, 0 other bytes
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 1, 2, 3
_KIND[[i for i in range(33, 127) if not chr(i).isalnum()]] = 4
_KIND[[9, 10, 11, 12, 13, 32]] = 5
_PLAIN = ".,;:'\"?()-"
_RARE = np.array([i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in _PLAIN])


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a text; null is empty."""
    b = (text or "").encode("utf-8", "replace")
    words = b.split()
    n, w = max(1, len(b)), max(1, len(words))
    each = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, each, 6)
    letters = kinds[1] + kinds[2] + kinds[0]
    counts = Counter(words)
    lines = [x for x in b.split(b"\n") if x]
    sizes = np.minimum(np.fromiter(map(len, words), np.float64, len(words)), LONGEST) if words else np.zeros(1)
    rare = each[_RARE].sum()
    ends = each[[46, 63, 33]].sum()
    low = lambda x: float(np.log(x + 0.002))
    caps = sum(map(bytes.isupper, words))
    adjacent = sum(map(operator.eq, words, words[1:]))
    marked = sum(x[-1:] in _TAIL for x in words)
    share = lambda x, usual=0.0: low((x + PRIOR * usual) / (w + PRIOR))
    chars = 6 * PRIOR
    return [
        float(np.log(n + 300)),
        float(np.log((sizes.sum() + 6 * PRIOR) / (w + PRIOR))),
        low((kinds[1] + 0.03 * chars) / (letters + chars)),
        low(rare / (n + chars)),
        float(np.log((len(counts) + PRIOR) / (w + PRIOR))),
        share(max(counts.values(), default=0)),
        share(adjacent),
        low((len(lines) - len(set(lines))) / (len(lines) + 3)),
        share(marked),
        low(each[124] / (w + PRIOR)),
        share(sum(len(x) > 2 and x[-1] == x[-2] == x[-3] for x in words)),
        share(caps),
        share(ends, 0.1),
        float(np.log((sizes.var() * w + 9 * PRIOR) / (w + PRIOR))),
    ]


_TAIL = {bytes([i]) for i in _RARE}
D = len(NAMES)


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and at, the transformed statistics."""

    def run(rows):
        for b in rows:
            at = [statistics(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(at, pa.list_(pa.float64()))], names=["doc_id", "at"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(freed(run), "doc_id long, at array<double>")


class Discriminant:
    """Two shrunk Gaussians; also what is sent to executors."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pool: float = POOL, ridge: float = RIDGE):
        sums = {c: s for c, s in sums.items() if s[0] > 0}
        self.classes = sorted(sums)
        n = sum(s[0] for s in sums.values())
        if len(self.classes) < 2:
            self.only = float(self.classes[0]) if self.classes else 0.5
            return
        mean = {c: s[1] / s[0] for c, s in sums.items()}
        cov = {c: s[2] / s[0] - np.outer(mean[c], mean[c]) for c, s in sums.items()}
        pooled = sum(s[0] * cov[c] for c, s in sums.items()) / n
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        unit = np.outer(self.scale, self.scale)
        self.mean, self.factor, self.base = {}, {}, {}
        for c, s in sums.items():
            weight = min(1.0, pool + D / (D + s[0]))  # a small class leans on the pooled covariance
            x = (1 - weight) * cov[c] / unit + weight * pooled / unit
            x = (1 - ridge) * x + ridge * np.trace(x) / D * np.eye(D)
            low = np.linalg.cholesky(x)
            self.mean[c] = mean[c]
            self.factor[c] = np.linalg.inv(low)  # the cached factor, ready to apply
            self.base[c] = np.log(s[0] / n) - np.log(np.diag(low)).sum()

    def score(self, at: np.ndarray) -> np.ndarray:
        if len(self.classes) < 2:
            return np.full(len(at), self.only)
        log = {}
        for c in self.classes:
            z = ((at - self.mean[c]) / self.scale) @ self.factor[c].T
            log[c] = self.base[c] - (z * z).sum(1) / 2
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def _sums(rows: DataFrame, model: Discriminant | None) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Weighted count, sum and products of each class, summed on executors.

    With a model, a label counts as right with the probability that the model and a fixed
    rate of wrong labels give it, so that wrong labels don't widen a class.
    """
    schema = pa.schema([("c", pa.int32()), ("i", pa.int32()), ("v", pa.float64())])
    wrong = 0.1

    def run(batches):
        total = {0: np.zeros(1 + D + D * D), 1: np.zeros(1 + D + D * D)}
        for b in batches:
            if not b.num_rows:
                continue
            at = np.array(b.column("at").to_pylist(), np.float64).reshape(-1, D)
            y = b.column("quality").to_numpy(zero_copy_only=False)
            one = model.score(at) if model is not None else None
            for c in (0, 1):
                weight = (y == c).astype(np.float64)
                if one is not None:
                    p = one if c else 1 - one
                    weight *= p / (p + wrong * (1 - p))
                total[c] += np.concatenate([[weight.sum()], weight @ at, ((at * weight[:, None]).T @ at).ravel()])
        for c, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(t), pa.int32()), pa.array(range(len(t)), pa.int32()), pa.array(t)], schema=schema)

    got = rows.select("at", "quality").mapInArrow(freed(run), "c int, i int, v double").groupBy("c", "i").agg(F.sum("v").alias("v")).collect()  # 2 (1 + D + D^2) rows
    out = {c: np.zeros(1 + D + D * D) for c in (0, 1)}
    for r in got:
        out[r["c"]][r["i"]] = r["v"]
    return {c: (t[0], t[1 : 1 + D], t[1 + D :].reshape(D, D)) for c, t in out.items()}


def fit(features: DataFrame, labels: DataFrame) -> Discriminant:
    """From all labelled rows (doc_id, quality) that aren't held out; each label row counts."""
    rows = features.join(labels.where("quality in (0, 1)").where(~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality")), "doc_id")
    rows = written(rows.select("at", "quality"), "labelled")
    model = Discriminant(_sums(rows, None))
    for _ in range(2):
        model = Discriminant(_sums(rows, model)) if len(model.classes) == 2 else model
    return model


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for each row of doc_id, text.

    Null and empty texts have statistics like any other and get a score.  With one class or
    none among the labels every score is that class, or 0.5.  Rows are independent; labels
    without a document, null labels and other columns are not used.
    """
    ready(docs.sparkSession)
    features = written(with_statistics(docs), "statistics")
    model = fit(features, labels)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(rows):
        for b in rows:
            if b.num_rows:
                s = model.score(np.array(b.column("at").to_pylist(), np.float64).reshape(-1, D))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema=schema)

    return features.mapInArrow(freed(run), "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows that score at least `least`; all columns, unchanged.

    Lower than the threshold of a report: what is doubtful stays.
    """
    ready(docs.sparkSession)
    ids = written(labels.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "labelled-ids")
    labelled, _ = split_by(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", ids)  # no statistics of other rows are needed here
    model = fit(with_statistics(labelled), labels)

    def run(rows):
        for b in rows:
            if b.num_rows:
                s = model.score(np.array([statistics(t) for t in b.column("text").to_pylist()], np.float64))
                yield b.filter(pa.array(s >= least))

    return docs.mapInArrow(freed(run), docs.schema)
