from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panveil.functions import shared_text

SHARES = "action string, mime string, payload string"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of a data folder; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_texts(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Text files as column text: a row for each line, or for each file if whole."""
    return spark.read.text(path, wholetext=whole).withColumnRenamed("value", "text")


def read_shares(spark: SparkSession, path: str) -> DataFrame:
    """Share events as JSON lines (action, mime, payload) with column text: what was shared, NULL if nothing usable."""
    return spark.read.schema(SHARES).json(path).withColumn("text", shared_text(F.col("action"), F.col("mime"), F.col("payload")))


def write_masked(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Writes rows, masked by an operator before; fmt is parquet, json, orc, csv, or text for a single string column."""
    df.write.format(fmt).mode(mode).save(path)
