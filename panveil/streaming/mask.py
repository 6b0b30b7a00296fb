from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from panveil.functions import MaskMode
from panveil.operators import mask_columns


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """New text files in a folder as they come, a row for each line, in column text."""
    return spark.readStream.text(path).withColumnRenamed("value", "text")


def mask_stream(stream: DataFrame, columns: Sequence[str], path: str, checkpoint: str, mode: MaskMode | str = MaskMode.LAST, keep_n: int = 4) -> StreamingQuery:
    """Masks what the stream holds now and appends it to parquet files; the checkpoint makes it exactly once."""
    masked = mask_columns(stream, columns, mode, keep_n)
    return masked.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
