"""A corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept.
``docs`` has the columns of the table ``documents``; every stage but the last
returns the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tiercast.llm import decontamination, language, packing, simhash, toxicity
from tiercast.llm.common import read
from tiercast.sources.storage import write_through


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, trained on ``labels``, does not call toxic.

    Null and empty texts are scored like any other; repeated rows share their fate; without labels of both classes all stay.
    """
    return toxicity.clean(docs, read(spark, sf_dir, "labels"))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language; null, empty and other texts without any letter go, repeated rows alike."""
    return language.with_language(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that SimHash links: the one with the smallest doc_id.

    Different texts under one id stay; rows without an id are reduced, too; of
    repeated rows one stays. Null and empty texts are one group.
    """
    return simhash.first_of_groups(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark passages.

    Null and empty texts have no words and stay; an empty benchmark keeps all; repeated rows share their fate.
    """
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with the checksum of their ids; null and empty texts hold the end id alone."""
    return packing.piece_digests(packing.pack(docs, with_ids=False))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("packing", pack_sequences),
]

#: Trained classifiers and tokenizers have no SQL form; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_through(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
