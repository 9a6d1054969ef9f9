"""From raw documents to token ids in training order: quality rules, exact and near duplicates, mixing, encoding.

Every stage works on all rows that the one before it kept; what it returns is written as Parquet and read again. All but the
last return the columns of documents. A scan packs its files by size, so the order of training is not left to it: the last stage
numbers the rows by the files that mixing has written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenhand.llm.bpe import BytePairs
from evenhand.llm.common import text_of
from evenhand.llm.exact_dedup import drop_exact_duplicates
from evenhand.llm.mixing import arrange
from evenhand.llm.near_dedup import drop_near_duplicates
from evenhand.llm.quality import drop_low_quality
from evenhand.plans.runtime import attach, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule, or whose host fails, go."""
    return drop_low_quality(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, the one with the largest id stays."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar sets of five-word shingles, the one with the smallest id stays."""
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, sorted by their position in training."""
    return arrange(docs)


def numbered(docs: DataFrame) -> DataFrame:
    """Rows read from files, with ``position``: their number from 0 in the order in which they were written.

    Part files are in the order of the partitions that wrote them, and a partition may write several; only the counts of
    files are sorted.
    """
    name = F.col("file")
    order = [F.regexp_extract(name, p, 1).try_cast("long").asc_nulls_first() for p in (r"^part-(\d+)", r"-c(\d+)\.")] + [name]
    placed = docs.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    counts = stage(docs.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n")), "files")
    ahead = F.coalesce(F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = counts.select(name.alias("__file"), ahead.alias("__ahead"))
    return attach(placed, files, ["__file"], 2 * counts.count(), ["__row"]).withColumn(
        "position", F.col("__ahead") + F.col("__row")).drop("__file", "__ahead", "__row")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Id, source, number of tokens, packed ids and position in training of every row: its place among the rows before."""
    pairs = BytePairs(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = numbered(docs).select("doc_id", "source", pairs.encode(text_of(), streamed=True).alias("ids"), "position")
    return coded.select("doc_id", "source", F.shiftright(F.octet_length("ids"), 2).cast("long").alias("n_tokens"), "ids", "position")


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("encoding", encode)]
#: Hashes of circulant permutations and merges of byte pairs are beyond SQL; the tests rebuild the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of a folder of tables; the rows are sorted by their position in training."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs.orderBy("position").drop("position")
