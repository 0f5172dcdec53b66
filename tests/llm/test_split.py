"""Splitting by a bitmap of ids: parts that add up, and no id in the wrong one."""

import pytest
from pyspark.sql import functions as F

from tallystone.llm import common


@pytest.mark.parametrize("n, most", [(0, 2048), (1, 2048), (3000, 2048), (3000, 1)])
def test_split_by(spark, monkeypatch, n, most):
    monkeypatch.setattr(common, "MOST_MAPS", most)
    d = spark.range(20_000).select(F.when(F.col("id") % 97 > 0, F.col("id") - 5000).alias("doc_id"), F.lit("x").alias("__x"))
    ids = spark.range(n).select((F.col("id") * 5 - 5000).alias("doc_id"))
    maybe, rest = common.split_by(d, "doc_id", ids)
    assert maybe.columns == rest.columns == d.columns
    assert maybe.count() + rest.count() == 20_000
    assert rest.join(ids, "doc_id", "left_semi").isEmpty()
    if most > 1:
        assert maybe.count() <= 1.1 * maybe.join(ids, "doc_id", "left_semi").count() + 0.04 * 20_000
    assert maybe.join(ids, "doc_id", "left_semi").count() == d.join(ids, "doc_id", "left_semi").count()
