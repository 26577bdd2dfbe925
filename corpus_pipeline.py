"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing and packing.

Each stage takes documents (doc_id, text, lang, source, n_chars, and any other columns, which are carried
along) and works on all rows that the stage before it kept. An empty table gives an empty result in every
stage. Texts of any length are taken whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rastrum.llm.mixing import mixed
from rastrum.llm.packing import pack
from rastrum.llm.quality import keep_good
from rastrum.llm.simhash import keep_one
from rastrum.llm.suffix_dedup import without_repeats
from rastrum.session import checkpoint


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    Null, empty and blank texts go, as they have fewer than ten words. Null ids and metadata don't matter;
    repeated rows are judged each for itself, so all of them stay or go.
    """
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id.

    A null id comes after all others; of a tie the smaller hash of the text decides, and of rows equal in id
    and text one stays. All null, empty and blank texts are one group.
    """
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; all documents stay.

    A null id sorts before all others; rows with equal ids don't cut each other; null texts become empty, as do
    texts of which nothing is left. n_chars is made anew.
    """
    return without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken in part, once or up to twice, to meet the weights.

    Null is a source of its own. Documents without words, null and empty texts among them, take no part and
    go. Repeated rows and null ids are documents like any other. n_chars is made anew.
    """
    return mixed(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 2048 tokens.

    A null text is empty and gives the end id alone; rows with equal or null ids are packed each for itself.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing to target weights", source_mix),
    ("best-fit packing", packed_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents; each result is written to the shared checkpoint folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if (name, stage) != STAGES[-1]:
            docs = checkpoint(docs)
    return docs
