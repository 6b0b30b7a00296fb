"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panveil.llm.common import col, cut, ranked, whole


def shuffle_key(row_id: Column, seed: int) -> Column:
    """Where a row stands in its source's shuffle: an MD5 of seed and id, so any engine can repeat it."""
    return F.unhex(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit("null")))))


def interleave(df: DataFrame, id_col: str, text_col: str, source_col: str, shards: int = 8, seed: int = 0) -> DataFrame:
    """One row for each input row: doc_id, source, size, text_crc32, position, shard, slot.

    Rows are shuffled within each source by shuffle_key, given the fractional rank (rank + 0.5) / rows of the source,
    sorted by that, and cut into shards of equal counts. So every shard holds each source's share to within a row,
    and shard sizes differ by one at most. Ranks come from sorted ranges and their counts; no source meets in a task.

    Null text counts as empty, null sources form a source of their own. Rows with the same id are ordered by source,
    CRC and size, and equal ones of those freely. Fewer rows than shards leave shards empty. No rows, no result.
    """
    text = whole(text_col)
    rows = df.select(
        col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("="), col(source_col).cast("string")), F.lit("")).alias("stratum"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("crc"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("key", shuffle_key(F.col("id"), seed))
    rows = cut(rows)
    total = rows.count()
    within = cut(ranked(rows, ["stratum", "key", "id", "crc", "size", "row"], "rank", "stratum"))
    sizes = within.groupBy("stratum").agg(F.count("*").alias("of"))
    fraction = (F.col("rank") + 0.5) / F.col("of")
    placed = ranked(within.join(sizes, "stratum").withColumn("fraction", fraction).drop("of", "key", "row"), ["fraction", "stratum", "rank"], "position")
    shard = F.expr(f"position * {shards} div {max(total, 1)}")
    return placed.withColumn("shard", shard).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("stratum") != "", F.expr("substring(stratum, 2)")).alias("source"),
        "size",
        F.col("crc").alias("text_crc32"),
        "position",
        F.col("shard").cast("int").alias("shard"),
        (F.col("position") - F.expr(f"(shard * {total} + {shards - 1}) div {shards}")).alias("slot"),
    )
