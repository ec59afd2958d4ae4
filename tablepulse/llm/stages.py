"""The stages of the corpus pipeline. Each takes documents and returns documents; the last returns token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablepulse.llm import bpe, decontamination, line_dedup, quality_rules, simhash_pivots
from tablepulse.llm.common import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. The raw corpus is this stage's input, the target its rows of label 1."""
    return quality_rules.reject(docs, quality_rules.fit(docs, quality_rules.trusted_ids(table(spark, sf_dir, "labels"))))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of later copies; n_chars follows. One of which no word is left is dropped."""
    found = line_dedup.dedup_lines(docs)
    emptied = (F.col("_n_deleted") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    length = F.when(F.col("_n_deleted") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.where(~emptied).select(*(length.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each near-duplicate group; documents without doc_id come after all others, and of
    several with that doc_id one stays, by hash. A document is its doc_id and text, as in line dedup: of rows equal in both
    one stays, and rows that share only their doc_id are told apart."""
    key = [x.alias(f"_{i}") for i, x in enumerate(line_dedup.doc_key(F.col("text")))]
    keyed = docs.withColumn("_key", F.xxhash64(*key))
    groups = simhash_pivots.near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), "component_id")
    ids = keyed.select("_key", key[0]).groupBy("_key").agg(F.min("_0").alias("_0"))
    first = groups.join(ids.hint("merge"), "_key").groupBy("component_id").agg(F.min(F.struct("_0", "_key"))["_key"].alias("_key")).select("_key")
    rank = F.row_number().over(Window.partitionBy("_key", "doc_id", "text").orderBy("_key"))
    # always a sorted join, at any size: what is kept grows with the corpus
    return keyed.join(first.hint("merge"), "_key", "left_semi").withColumn("_rank", rank).where("_rank = 1").select(*docs.columns)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the text decoded from them."""
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)
