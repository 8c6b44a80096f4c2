"""A training-data pipeline over documents: toxicity, line dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. The first and the last need a trained machine and a merge table, so no single SQL statement gives run()'s
rows; tests/llm holds every stage's rows, and run()'s, against a plain restatement.

In all stages rows decide, not numbers: a doc_id may be null or stand at several texts, extra columns come through as they
are, and an empty table gives an empty one. run() leaves the stages' files in its folder under spark.checkpoint.dir, as the
result reads the last of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm.byte_bpe import bpe_digest
from docquarry.llm.common import shared_folder, table
from docquarry.llm.line_dedup import dedup_lines
from docquarry.llm.mixing import apply_mix
from docquarry.llm.simhash import keep_one_of_each
from docquarry.llm.toxicity import drop_toxic


def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine rejects go; it learns from the labelled documents that arrive.

    Null and empty texts are judged as texts without a striking sentence; repeated rows are judged alike; labels that are
    null or of absent documents don't count, and without labels of both classes every row stays.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that came before, or nearly so, leave the texts; every document stays, be its text empty then.

    Rows with a null doc_id or text are left as they are; rows equal in doc_id and text keep the same lines.
    """
    return dedup_lines(docs)


def keep_one_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group stays: that of the smallest doc_id, null last, ties by a digest of all columns.

    Null and empty texts are one group; rows that repeat another are of its group.
    """
    return keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix takes them, each row with its own columns.

    A null source is a source of its own; null and empty texts have no words and aren't taken.
    """
    return apply_mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts, a row for each row; a null text is an empty one."""
    return bpe_digest(docs)


STAGES = [
    ("toxicity", drop_toxic_documents),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", keep_one_near_duplicate),
    ("source mixing", mix_sources),
    ("byte-level bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what a stage returns is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
