"""From raw documents to packed token sequences: STAGES, and ``run`` over the documents of a data folder.

Each stage works on all that the one before it kept, and is written as Parquet before the next one reads it.

In every stage other columns than text and doc_id go through unread, whatever their names and nulls, and an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tailglass.llm.block_anchors import cut_repeats
from tailglass.llm.common import stored, table
from tailglass.llm.compression_bands import keep_good
from tailglass.llm.cutting_stock import pack
from tailglass.llm.prob_minhash import one_of_each
from tailglass.llm.qgram_lemma import drop_leaks


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the compression bands keep.

    Null, empty and short texts fail the base rule and go; each row is judged alone, whole, repeated rows alike.
    """
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates.

    The one of the smallest doc_id stays, a null doc_id comes last.  Rows that repeat both doc_id and text are one
    document; texts without words are in no group and stay.
    """
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the words that repeated windows of 35 words cover.

    Every row stays; null texts stay null, and a text whose words are all covered is left empty.  A passage that
    repeats goes everywhere, its first place too, and n_chars follows the text.
    """
    return cut_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item.

    Null and empty texts hold none and stay; equal rows go or stay together; an empty benchmark lets all stay.
    """
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its token sequence and its offset there.

    A null or empty text is its end token alone; equal rows are packed each for itself.
    """
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Compression ratios, edit distances and token ids are beyond SQL; tests/llm/test_corpus_pipeline.py has brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
