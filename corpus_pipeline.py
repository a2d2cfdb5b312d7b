"""The corpus pipeline: five stages, each applying one text operator to all that the last one kept.

Every filtering stage returns rows of its input with all their columns, whatever their names, and an empty
table gives no rows. Texts that are null, empty or blank, and texts of any length, go through each stage as its
operator says: a null or empty text is scored as one without terms, counts as equal to other empty ones (of
which one stays), has no near copies and no leaks, and is packed as the end token alone. Rows without a
doc_id stay where their own text doesn't make them go. Rows that repeat a doc_id are documents of their own
until a stage rejects one of them: rows are dropped by doc_id, so all of that id go then.
"""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import decontam, exact, neardup, packing, toxicity
from ledgerlens.llm.common import documents, scratch_path


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but for the doc_ids of ``gone``; columns stay as they are."""
    return docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out the documents that the classifier rejects (score 0.5 or more)."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return without(docs, exact.exact_dedup(docs).where("NOT kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a component of near duplicates the least doc_id stays."""
    return without(docs, neardup.near_dedup(docs).where("NOT kept"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents with a passage of a benchmark item."""
    return without(docs, decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack_rest(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack_rest),
]

#: SQL can't express the classifier, the latent space or the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, writing and rereading each one's result."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
