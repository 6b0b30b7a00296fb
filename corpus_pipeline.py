"""Five stages from raw documents to packed sequences. Each is written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panveil.llm.common import stored
from panveil.llm.stages import exact_copies, mixed, near_copies, packed, quality_rules

STAGES = [("quality", quality_rules), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("mix", mixed), ("pack", packed)]
#: Neither the join, the mixture nor the tokenizer can be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
