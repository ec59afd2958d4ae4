"""The corpus pipeline (part of tablepulse.llm): quality rules, line dedup, near-dedup, decontamination, token ids.

No stage but line dedup and decontamination can be told in SQL (hashed n-grams, XXH64 fingerprints, byte-pair merges), so
ORACLE_SQL is None; tests/llm/test_pipeline.py holds every stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablepulse.llm import stages
from tablepulse.llm.common import Relay

STAGES = [
    ("quality rules", stages.quality),
    ("line dedup", stages.lines),
    ("near-dedup", stages.near_copies),
    ("benchmark decontamination", stages.benchmarks),
    ("token ids", stages.tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs, relay = spark.read.parquet(f"{sf_dir}/documents.parquet"), Relay(spark)
    for _, stage in STAGES[:-1]:
        docs = relay(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
