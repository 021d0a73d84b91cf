"""A corpus pipeline: language, exact copies, near copies, benchmark passages, packing.

Each stage gets what its predecessor kept; all but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from tidelake.llm import decontam, exact, langid, neardup, packing
from tidelake.llm.common import documents, materialise
from tidelake.llm.queries import benchmark, tokenizer_file


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, langid.fit(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, benchmark(spark, sf_dir))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("language", language), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("decontamination", benchmark_passages), ("packing", packed)]

#: Centroids, MinHash components and tokens are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


log = logging.getLogger(__name__)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what all stages keep; how many rows each stage drops is logged."""
    docs = documents(spark, sf_dir)
    n = docs.count()
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        before, n = n, docs.count()
        log.info("%s drops %d of %d rows", name, before - n, before)
    return STAGES[-1][1](spark, docs, sf_dir)
