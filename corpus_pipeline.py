"""A cleaned, mixed and tokenised corpus from `documents`, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All stages but the last return the columns of documents; rows that a stage drops are gone for
the later ones, and a document that the mix takes twice has two rows from then on.

Rejections: quality and toxicity learn from the labels of `sf_dir` for the rows of their own input, by the same folds as the
queries of these operators. Near duplicates: one row stays for each group of linked documents, one of the smallest doc_id
that is not null; documents without words all stay. The mix takes no document without words.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdict.functions.checkpoints import shared_folder
from verdict.llm import byte_bpe, jaccard_join, mixing, quality_mil, toxicity_crf
from verdict.llm.common import fold, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality_mil.keep_good(docs, quality_mil.fit(docs, table(spark, sf_dir, "labels"), ~fold(F.col("doc_id"), 3, 1)))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field does not reject."""
    return toxicity_crf.keep_clean(docs, toxicity_crf.fit(docs, table(spark, sf_dir, "labels"), ~fold(F.col("doc_id"), 5, 0)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    return mixing.apply_mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids_sha256 and decoded_sha256 of each row of the mix."""
    keep = ("doc_id", "source")
    encoded = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=keep)
    return byte_bpe.digests(encoded, keep=keep)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("tokenise", tokenise),
]

#: SQL can express neither classifier, so the rows are tested against a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Stages are written under the folder in spark.checkpoint.dir (a new one where unset); a stage's
    folder is removed once the next one is written, the last stays for the caller."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{before}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = name
    return docs
