"""The contract queries over the driver's tables; __spark_entry__.py registers what is here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    return lm.score(_table(spark, sf_dir, "documents"), vocabulary())


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.join(_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.digests(_table(spark, sf_dir, "documents"), vocabulary())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity
    from .common import remainder

    docs = _table(spark, sf_dir, "documents")
    found = toxicity.tag(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), "spans")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html

    return html.extract(_table(spark, sf_dir, "pages"))


def op6_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    return neardup.near(_table(spark, sf_dir, "embeddings"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses

    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import urls

    return urls.judge(_table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.packed(_table(spark, sf_dir, "documents"), vocabulary())


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    counted = cut(quality.statistics(_table(spark, sf_dir, "documents")))
    model = quality.learn(counted, _table(spark, sf_dir, "labels"))
    wanted = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    return quality.verdicts(counted, model).select(*wanted)


#: Links in doubles; components by a walk over links, which UNION ends.
NEARDUP_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM v LEFT JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_lm_scoring, op2_ngram_jaccard, op3_bpe, op4_toxicity, op5_html, op6_embedding_neardup, op7_licenses, op8_urls, op9_packing, op10_quality)}


def oracle_sql() -> dict[str, str]:
    from . import licenses, urls

    return {"op7_licenses": licenses.duckdb(), "op8_urls": urls.duckdb(), "op6_embedding_neardup": NEARDUP_SQL}
