"""The registered queries of this subpackage, on the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmill.llm import ann, conversations, histogram, htmltext, importance, langmodel, mixing, packing, pii, simhash, spotsigs, toxicity
from tabmill.llm import quality as quality_rules
from tabmill.llm.text import in_fold, read


def fitted_toxicity(docs: DataFrame, labels: DataFrame) -> dict:
    return toxicity.fit(docs, labels, where=~in_fold(F.col("doc_id"), 5, 0))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted_toxicity(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted", "spans")


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = langmodel.fit_and_score(read(spark, sf_dir, "documents").select("doc_id", "text"), in_fold(F.col("doc_id"), 7, 2))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules.quality(read(spark, sf_dir, "documents"), trusted)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op5_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.histogram(read(spark, sf_dir, "documents"))


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, exact=False)


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read(spark, sf_dir, "pages").select("page_id", "html"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.fit(docs))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    return conversations.report(rows, conversations.damaged(rows))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compared(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_toxicity": op1_toxicity, "op2_language_model": op2_language_model, "op3_quality_rules": op3_quality_rules, "op4_source_mix": op4_source_mix, "op5_mixture_packing": op5_mixture_packing, "op6_simhash_groups": op6_simhash_groups, "op7_token_counts": op7_token_counts, "op8_nearest_vectors": op8_nearest_vectors, "op9_personal_data": op9_personal_data, "op10_page_text": op10_page_text, "op11_conversation_repair": op11_conversation_repair, "op12_importance_resampling": op12_importance_resampling, "op13_document_fingerprints": op13_document_fingerprints}


NEAREST_SQL = """
WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
v AS (SELECT row_number() OVER () AS uid, id, v FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
n AS (SELECT uid, id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda x, y: x + y)) AS norm FROM v),
p AS (SELECT q.uid, q.id AS query_id, c.id AS vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]), lambda x, y: x + y) / (q.norm * c.norm) AS score
      FROM n q JOIN n c ON q.id % 50 = 0 AND q.uid <> c.uid AND len(q.v) = len(c.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 5"""


def oracle_sql() -> dict[str, str]:
    """Only where SQL can express the whole query: the others are learned, or hash as DuckDB can't, or encode tokens. The tests
    hold them against plain versions."""
    return {"op8_nearest_vectors": NEAREST_SQL}
