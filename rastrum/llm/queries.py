"""The thin queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rastrum.llm import chosenpath, fixity, licenses
from rastrum.llm.conversations import damaged, repair
from rastrum.llm.cotraining import score
from rastrum.llm.mixing import ORACLE as MIXING_SQL, mixture
from rastrum.llm.packing import pack
from rastrum.llm.quality import ORACLE as QUALITY_SQL, quality
from rastrum.llm.sharding import shard
from rastrum.llm.simhash import hex_of, near_duplicates
from rastrum.llm.spotsigs import edit_robustness
from rastrum.llm.suffix_dedup import cut_repeats
from rastrum.llm.yinyang import compress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_robustness(table(spark, sf_dir, "documents"))


@_query
def op2_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


@_query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")


@_query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


ORACLES["op5_mixing"] = MIXING_SQL


@_query
def op6_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against a replica with planted faults."""
    return fixity.report(table(spark, sf_dir, "pages"))


ORACLES["op6_merkle_fixity"] = fixity.ORACLE


@_query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


ORACLES["op7_quality"] = QUALITY_SQL


@_query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents"))


@_query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


ORACLES["op9_licenses"] = licenses.oracle()


@_query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair of all conversations after planted faults."""
    return repair(damaged(table(spark, sf_dir, "conversations")), copies_col="copies")


@_query
def op12_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.near_duplicates(table(spark, sf_dir, "documents"))


@_query
def op13_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))
