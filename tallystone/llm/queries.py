"""The thin queries of the contract: each reads its whole table and applies one operator with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table; spread over the cores where it has fewer partitions."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import token_store

    return token_store(documents(spark, sf_dir)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import report

    return report(documents(spark, sf_dir))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_vectors

    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import held_out, identify

    return identify(documents(spark, sf_dir)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprints

    return fingerprints(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import held_out
    from .quality import quality

    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .automaton import bpe

    return bpe(documents(spark, sf_dir), digest=True)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir), k=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_token_store, op2_secrets, op3_main_text, op4_vectors, op5_language, op6_fingerprints, op7_quality, op8_pack, op9_bpe, op10_minhash)}


#: Both compare all pairs, of a label or of a common shingle, and walk the links.
REACH = """both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach(id, r) AS (SELECT id, id FROM ids UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r),
  component AS (SELECT id, min(r) AS c FROM reach GROUP BY id)"""
VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e)
    WHERE list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e)) >= 0.98), ids AS (SELECT vec_id AS id FROM embeddings), {REACH},
  n AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a)
  SELECT component.id AS vec_id, coalesce(n, 0) AS n_links, c AS component_id, component.id = c AS kept FROM component LEFT JOIN n USING (id)"""
MINHASH = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS s FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
  links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)), ids AS (SELECT doc_id AS id FROM documents), {REACH}
  SELECT component.id AS doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, component.id = c AS kept FROM component LEFT JOIN n ON n.doc_id = component.id"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can express the whole result; the others are tested against brute force."""
    return {"op4_vectors": VECTORS, "op10_minhash": MINHASH}
