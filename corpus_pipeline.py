"""Training-corpus pipeline: stages that each take the documents the one before kept.

A stage gets the documents as a DataFrame read from what the stage before has written, works
on all of them and returns those it keeps, with the columns of ``documents``; the last returns
packed sequences. Nulls, empty texts and repeated rows are handled as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strikeline.llm import exact_dedup, jaccard_join, packing, pii, toxicity
from strikeline.llm.common import ship, table
from strikeline.session import shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counterfactual-regularised classifier scores 0.5 or more go."""
    labels = table(spark, sf_dir, "labels")
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for the case of A-Z, the one with the largest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by Jaccard 0.8 of five-word shingles, the smallest doc_id stays."""
    ship(spark)
    return jaccard_join.one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind; n_chars is that of the new text."""
    return pii.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become sequences of power-of-two lengths."""
    ship(spark)
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    # workers that have run the other stages have less memory to spare
    return packing.pack(docs, tokenizer, entries=300_000)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: Classifiers and tokenizers have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and reread as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
