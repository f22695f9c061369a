"""A corpus from documents, in five stages; each works on all that the one before it kept.

language ID: documents without a recognised language go.
near duplicates: of each group that the n-gram Jaccard join links, the smallest doc_id stays.
PII: personal data is replaced by placeholders, disguised or not.
mixing: documents are taken, once, twice or not at all, so that sources come to their target weights.
tokens: the text as SentencePiece ids with seeded merge-dropout, copies of a document each by draws of its own.

Defined results of every stage: a null text has no letters, so it goes with the first one; a null source mixes as a source of its own, last; rows with a
null doc_id are linked with nothing and stay; rows that share a doc_id are one document for the near duplicates and are kept or dropped together, and elsewhere are rows of
their own; texts of any length are read whole; ties go to the smaller doc_id; no rows give no rows; further columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadscape.llm import jaccard_join, language_id, mixing, pii, sentencepiece_dropout
from loadscape.llm.common import kept, table, word_count

#: Classifiers, sketches and merge-dropout have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs, language_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard_join.components_of(docs)
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text = docs.withColumn("text", pii.redact("text"))
    return text.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, word_count("text"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # mixing repeats a row in place, and each copy draws for itself
    return sentencepiece_dropout.encode(docs, adjacent=True).withColumn("n_ids", F.size("ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mixture),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
