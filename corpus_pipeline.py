"""Corpus preparation: quality rules, language identification, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. `run` writes what a stage returns
as Parquet in the shared folder and gives it to the next one, and removes what stages before wrote;
all but the last return the columns of documents.

Defined cases of every stage: texts are read whole, whatever their length; a null id stays null;
no rows give no rows; columns besides doc_id, text and lang, whatever their names, are kept by all
stages but the last, which ignores them. The cases of single stages are stated with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haplomill.llm import language, near_dup, packing, quality
from haplomill.llm.common import mark, settle, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null and empty texts, too, which have no words. A divergence
    at the bound passes. Equal rows are judged alike; a null label feeds no reference."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: null texts and texts without letters, too. A score
    at the bound passes; of equal languages the first by name is taken. Equal rows are judged alike."""
    return language.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (word 5-shingles, similarity 0.8) stays: that with the
    smallest id, a null id last; of rows that repeat it any one. Null and empty texts are in no group
    and stay."""
    return near_dup.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, with their places in sequences. Null and empty texts are one
    piece of the end id; rows that repeat are packed each."""
    import public_tokenizers

    return packing.best_fit_pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_dedup", near_dedup), ("best_fit_packing", pack)]

#: Tokenizing and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name, since)
    return docs
