"""The corpus pipeline: STAGES in order, each a function of (spark, docs, sf_dir) over all that the one before kept.

Rows with a null id and rows that repeat an id take part like others, told apart by their texts; null and empty texts are
neither toxic nor copies nor leaks and are encoded as no tokens. Empty tables give empty results, and columns that
documents has besides its own reach the stage before the last unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxara.llm import bpe, common, decontam, ngram_join, secrets, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more go."""
    return toxicity.accepted(docs, common.read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one of least id stays."""
    return ngram_join.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    return decontam.decontaminated(docs, common.read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets in texts become <secret>."""
    return secrets.redact(spark, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as token ids, with their number and the hashes of ids and decoded text."""
    return bpe.encode_documents(docs, bpe.tokenizer_path(), with_ids=True)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark_leaks), ("secrets", redact_secrets), ("bpe", encode)]
#: SQL can't express the label model, the classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage but the last is a table in the shared folder, removed once the next is written."""
    docs, before = common.read_table(spark, sf_dir, "documents"), None
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs, path = common.stash(docs, name)
            if before:
                common.drop_path(spark, before)
            before = path
    return docs
