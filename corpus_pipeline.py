"""The corpus pipeline: toxic documents go, one of each near-duplicate group stays, personal data is masked, sources are mixed
to target weights, and what is left is packed into token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared folder and rereads
as the next one's docs, deleting what a stage wrote for itself. All but the
last return the columns of documents.

Cases, in every stage: null and empty texts pass as documents without words (the mix takes none of them); null ids, repeated
rows and very long texts are treated as the operators' own texts say; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabmill.llm import mixing, packing, pii, queries, simhash, toxicity
from tabmill.llm.text import read, settled


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that op1's model, learned from the labels of those given, predicts toxic."""
    return toxicity.without_toxic(docs, queries.fitted_toxicity(docs.select("doc_id", "text"), read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each of op6's components."""
    return simhash.first_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, op9's spans replaced by their kinds."""
    return pii.redacted(docs, pii.fit(docs.select("doc_id", "text")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What op4's mix takes of each document, a row per pass that takes any of it."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """op5's pieces."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("personal data", mask_personal_data),
    ("source mix", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the learned stages; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole of documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(spark, name.replace(" ", "-"), lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return docs
