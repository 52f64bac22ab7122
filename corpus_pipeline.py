"""Corpus pipeline: quality, near-duplicates, benchmark passages, mixture, token ids.

Each stage takes all that the one before has kept; ``run`` writes each stage's rows as Parquet to the shared folder and rereads
them.  All stages but the last return the columns of ``documents``; the last returns the token store's documents, as
the store's files give them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowlens.llm import decontaminate, mixture, near_dups, quality, token_store
from flowlens.llm.common import scratch_path, written
from flowlens.llm.queries import END_ID, table, tokenizer_path
from flowlens.sources.tables import scratch_run


#: Bytes of words that a Python worker of the last stage remembers: less than by default, as executors that ran the stages before hold more.
CACHE_BYTES = 48 << 20


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier scores at its threshold or more."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return near_dups.deduplicated(docs, width=5, threshold=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources come to their target weights."""
    return mixture.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token store and returns its documents as read back."""
    return token_store.token_output(docs, tokenizer_path(), END_ID, CACHE_BYTES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixture_stage),
    ("token-ID binary output", token_stage),
]

#: The classifier's scores are beyond SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages.  A stage's own tables go when its rows are written, but for the last one's, whose store is what the pipeline is run for."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        with scratch_run(spark):
            rows = stage(spark, docs, sf_dir)
            rows.write.parquet(path)
        docs = spark.read.schema(rows.schema).parquet(path)
    name, stage = STAGES[-1]
    return written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
