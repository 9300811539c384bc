"""From documents to token ids: toxic texts go, then copies, then near copies; the
rest is mixed to target weights and encoded. Every stage is written as Parquet
and read again by the next one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from recordloom.llm import bpe, exact_dedup, mixing, near_dedup, queries, toxicity
from recordloom.llm.shared import read
from recordloom.session import materialise

REJECTED = 0.5  # toxicity score from which a document goes


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents below the score, all their columns, empty texts included."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.below(docs, model, REJECTED)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    return exact_dedup.drop_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the row with the smallest id."""
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their leaf's budget takes them: not at all, once or twice."""
    taken = mixing.epochs(
        docs, queries.domain(), queries.MIXTURE, None, queries.MIXTURE_EPOCHS, queries.MIXTURE_SEED
    )
    return mixing.mixture(taken)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, their count, and digests of the ids and of what they
    decode to."""
    ranks = queries.rank_file()
    narrow = docs.select("doc_id", "source", "text")
    encoded = bpe.encode(narrow, ranks, public_tokenizers.PATTERN, decoded="decoded")
    return bpe.with_digests(encoded).drop("decoded")


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: SQL has no Kneser-Ney models, sketches or BPE; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
