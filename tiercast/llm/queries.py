"""One query per operator over its whole table, and SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    alignment, decontamination, embeddings, extraction, language, packing, quality, records, simhash, toxicity, urls, warc,
    whitening,
)
from .common import read


def op1_cumulative_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ratings(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.record_digests(records.write_records(read(spark, sf_dir, "documents")))


def op3_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(read(spark, sf_dir, "documents"))


def op4_simhash_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op5_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op6_boosted_dom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_texts(read(spark, sf_dir, "pages"))


def op7_nb_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_digest_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(read(spark, sf_dir, "pages"))


def op9_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(read(spark, sf_dir, "documents"), with_ids=False))


def op10_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_digests(warc.write_archives(read(spark, sf_dir, "pages")))


def op12_lockstep_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_digests(read(spark, sf_dir, "documents"))


def op13_spectrum_slicing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_cumulative_link, op2_binary_records, op3_cross_parsing, op4_simhash_gray_index, op5_pivot_permutation,
        op6_boosted_dom, op7_nb_ngrams, op8_digest_array, op9_concat_and_cut, op10_wu_manber,
        op11_dictionary_warc, op12_lockstep_alignment, op13_spectrum_slicing,
    )
}

ORACLES: dict[str, str] = {"op8_digest_array": urls.ORACLE, "op10_wu_manber": decontamination.ORACLE}
