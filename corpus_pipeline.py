"""The corpus pipeline: language ID, near copies, substring dedup and packing, each on all that the stage before kept.

A stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of `documents`. Defined cases are those of the operators; an empty table goes
through all stages and packs nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framefold.llm import language, packing, repeats, simhash
from framefold.llm.common import materialize, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is known; those without a letter go, and so do those that fit no language well."""
    return language.keep_known(docs, language.training_rows(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, that with the least id."""
    return simhash.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words and more that an earlier document has; every document stays."""
    return repeats.cut_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every document in a bin of 2,048 words, with no two of one source or one duplicate cluster together."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("simhash_near_dedup", without_near_copies),
    ("substring_dedup", without_repeats),
    ("best_fit_packing", packed),
]
#: Naive Bayes, gear chunks and best fit can't be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
