"""Training-data pipeline: the documents that are worth training on, as token ids.

Each stage is written as Parquet in the shared folder and read again as the documents of the next
one, so a lost executor repeats one stage's tasks at most.  Every stage works on all that its
predecessor kept, and learns anew from it where it learns.

1. language_id: documents without a language (null text or no letter) go.
2. line_dedup: later copies of repeated runs of lines are deleted; documents left without a line go.
3. simhash_near_dedup: one document of each component of near-duplicates stays.
4. mix_sources: documents are repeated or left out so that sources reach their target weights.
5. sentencepiece: ids, their number, and the text decoded from them are added.

Stages keep every column of the documents, extra ones included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keysift.llm import langid, linededup, mixing, pieces, simhash
from keysift.llm.common import materialize, read_table

#: No SQL gives hashes of shingles, cosines of random vectors or BPE ids; the tests compare the stages
#: with brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.drop_undetermined(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.drop_later_copies(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.tokenize(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
