"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` applies
them to the documents table. Stages learn only from the documents they are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirstream.llm import digest_index, langid, mixing, neardup, pieces
from weirstream.llm.common import staged
from weirstream.llm.queries import default_model_file


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; texts that are null or without a letter go."""
    profiles = langid.learn(docs)
    if not profiles.langs:  # nothing to learn from: only texts without a letter can be told
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return langid.predict(docs, profiles).filter(F.col("lang_pred") != langid.UNKNOWN).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return digest_index.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 percent of their five-word shingles or more, over any path, the one with the least id stays.

    Rows without id are no nodes of the links and all stay.
    """
    kept = neardup.near_duplicates(docs, neardup.NearDup(words=5, similarity=80)).filter("kept")
    with_id = docs.join(kept.filter("doc_id IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi")
    return with_id.union(docs.filter("doc_id IS NULL")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix takes it (the last of a source if half of it or more is taken)."""
    return mixing.training_order(docs, mixing.Curriculum())


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``ids`` and ``n_bytes`` (ids that spell bytes)."""
    return pieces.encoded(docs, pieces.load(default_model_file(spark)))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", tokenize),
]

#: SQL can express neither the language profiles nor the segmentation; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
