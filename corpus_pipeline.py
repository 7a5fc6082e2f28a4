"""The corpus pipeline: toxicity, exact and near de-duplication, mixing, packing.

Each stage is (name, function of (spark, docs, sf_dir)); its result is the next one's
``docs``. All but the last return the columns of ``documents``, whatever these are called;
``doc_id`` and ``text`` are read, by mixing ``lang`` and ``source``, too. An empty table
gives an empty result in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import toxicity
from lectern.llm.exact_dedup import drop_exact_duplicates
from lectern.llm.minhash import drop_near_duplicates
from lectern.llm.mixing import mix_documents
from lectern.llm.packing import pack
from lectern.llm.shared import materialise, release, working_tables


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold, by a model of this corpus and its labels.

    Null and empty texts are scored as an empty sentence; rows that repeat a text go or
    stay alike, whatever their ids; without labels of both classes no document goes,
    unless the only class is the toxic one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, white space aside: the longest original, then the smallest doc_id, null last.

    Null and blank texts are one group. Of rows that repeat id and text any one stays.
    """
    return drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component: that of the smallest doc_id, null last.

    Rows without words all stay. Rows that share an id are told apart by their texts.
    """
    return drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many words as the corpus has, by the target weights, from four epochs of a source at most.

    Null languages and sources are named 'unknown'; rows without words are never taken; a
    row comes once for each epoch that takes it; rows that repeat id and text share theirs.
    """
    return mix_documents(docs, budget_percent=100)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of 1024 tokens; a null or empty text is the end id alone, a null id stays null."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages' models and tokenizer can't be stated in SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's working tables go when its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), working_tables()
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        release(spark, docs, before)
    return STAGES[-1][1](spark, docs, sf_dir)
