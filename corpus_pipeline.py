"""From raw documents to packed training sequences, in five stages.

Each stage is (name, function) with function(spark, docs, sf_dir) -> DataFrame; its result is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kerbline.llm.common import Scratch, scratch_released, table
from kerbline.llm.decontaminate import without_leaks
from kerbline.llm.line_dedup import keep_first_lines
from kerbline.llm.minhash_dedup import without_copies
from kerbline.llm.packing import pack
from kerbline.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first_lines(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_copies(docs, percent=80)  # op9 has its own threshold


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each on all that the one before kept.

    Rows without doc_id pass through; null and empty texts, repeated rows, very long texts and extra
    columns are handled as each stage's operator says. An empty table gives no rows.
    """
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    done = None
    for name, stage in STAGES[:-1]:
        with scratch_released():
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        if done is not None:
            scratch.drop(done)
        done = docs
    return STAGES[-1][1](spark, docs, sf_dir)
