"""A training-corpus pipeline: quality classifier, near duplicates, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
stage's docs. All but the last return the columns of documents, others that docs may have among them.

Defined results for odd rows are those of each stage's operator: null and empty texts get the score of an empty text, are near
duplicates of nothing, never contaminated and never mixed in; rows that share a doc_id are documents of their own, and of repeated
rows one stays; very long texts are taken whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bitplanes, chosen_path, curriculum, gam_classifier, phrase_index
from codeloom.llm.common import Workspace, table
from codeloom.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It learns from labels of documents that are there; without any
    labels all stay."""
    model = gam_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return gam_classifier.with_score(docs, model, "__cl_score").where("__cl_score >= 0.5").drop("__cl_score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of its smallest doc_id; texts without words all stay."""
    return chosen_path.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items; all, if there are no items."""
    return phrase_index.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in training order; documents without words are never taken."""
    return curriculum.training_order(docs, position_column="__cl_position").drop("__cl_position")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in shards; returns what they hold per document."""
    return bitplanes.tokens_to_shards(docs, tokenizer_path(), end_id=1).drop("shard")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: Scores, sketches and token ids are beyond SQL; tests hold the stages against plain restatements.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder and reread."""
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = space.write(stage(spark, docs, sf_dir), name)
    return docs
