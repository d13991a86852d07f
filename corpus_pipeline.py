"""The corpus pipeline: a list of stages, each over what the stage before it kept.

Language ID drops documents without a language or with a score under one half; exact
dedup keeps one row of each text; near-dedup starts from the links of SimHash prints by trie
join and keeps one row of each component of texts whose five-word shingles have a Jaccard
similarity of 0.8 or more; mixing takes each source's documents up to its target, some of them twice and the one
at the cut in part; SentencePiece encodes what was taken.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioforge.llm.exact_dedup import drop_exact_copies
from folioforge.llm.language_id import keep_identified
from folioforge.llm.mixing import mix_documents
from folioforge.llm.near_dedup import drop_similar
from folioforge.llm.sentencepiece_nbest import encode_documents
from folioforge.session import remove_path, shared_dir, texts


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_similar(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: Language models, fingerprints' components and segmentation are beyond SQL; tests/llm holds
#: the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is written as Parquet in the shared folder and read
    again by the next one; it goes when the next one's is there."""
    docs, base = texts(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
        if k:
            remove_path(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
