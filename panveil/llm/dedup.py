"""Exact deduplication by 128-bit content hash, with bytes compared inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panveil.llm.common import col, cut, row_key, sifted, whole

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else."""
    return F.translate(text, UPPER, LOWER)


def sha128(digest: Column, _: Column) -> Column:
    return F.unhex(F.substring(digest, 1, 32))


def exact_dedup(
    df: DataFrame,
    id_col: str,
    text_col: str,
    keep: str = "smallest",
    normalise: Callable[[Column], Column] = ascii_lower,
    content_hash: Callable[[Column, Column], Column] = sha128,
) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256, and the input row's row_key.

    Rows are grouped by a 128-bit hash of the normalised text; keep, smallest or largest, says which id of a group
    stays. Another job groups the texts of hashes that two rows or more share by hash and text together, copies
    combined before the shuffle, and finds hashes under which two texts differ. For those, if any, groups are formed by
    the bytes themselves. A text whose hash is alone is not shuffled, but for the few that sifted() lets through.

    Null text is empty text. A null id stays only if its group has no other; ids are of any type that sorts. Of rows with
    the same id and text, the one with the greatest row_key stays (the least, if the smallest id does), and of rows equal
    in every column one, chosen freely. Texts of any length count as a whole. No rows, no result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    norm = normalise(whole(text_col))
    texts = df.select(row_key(df).alias("key"), col(id_col).alias("id"), norm.alias("norm")).withColumn("sha", F.sha2("norm", 256))
    texts = texts.withColumn("hash", content_hash(F.col("sha"), F.col("norm"))).withColumn("row", F.monotonically_increasing_id())
    narrow = cut(texts.drop("norm"))
    shared = cut(narrow.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("hash").alias("h")))
    compared = sifted(texts.select("hash", "norm"), F.xxhash64("hash"), shared).groupBy("hash", "norm").agg(F.count("*").alias("n"))
    mixed = cut(compared.groupBy("hash").agg(F.count("*").alias("texts")).where("texts > 1").select("hash"))
    if mixed.isEmpty():
        return _grouped(narrow, ["hash"], keep)
    apart = cut(texts.join(mixed, "hash", "left_semi"))
    return _grouped(narrow.join(mixed, "hash", "left_anti"), ["hash"], keep).unionByName(_grouped(apart, ["hash", "norm"], keep))


def _grouped(rows: DataFrame, by: list[str], keep: str) -> DataFrame:
    # A null sorts below all else, so among the smallest it has to be put last.
    best = F.max(F.struct("id", "key", "row")) if keep == "largest" else F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "row"))
    # A cut, so that the join shuffles for itself and a large group's rows can be split over tasks.
    groups = cut(rows.groupBy(*by).agg(best.alias("best"), F.count("*").alias("n")).where("n > 1"))
    return rows.join(groups, by, "left").select(
        F.col("id").alias("doc_id"),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("row") == F.col("best.row"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.col("key").alias("row_key"),
    )


def drop_copies(df: DataFrame, id_col: str, text_col: str, keep: str = "smallest") -> DataFrame:
    """The input rows that exact_dedup keeps, with all their columns."""
    kept = exact_dedup(df, id_col, text_col, keep).where("kept").select(F.col("row_key").alias("key"))
    return rows_of(df, kept)


def rows_of(df: DataFrame, keys: DataFrame, distinct: bool = True) -> DataFrame:
    """The rows of df whose row_key is in keys; of rows equal in every column one only, if distinct."""
    packed = df.select(row_key(df).alias("key"), F.struct(*(col(c) for c in df.columns)).alias("row"))
    found = packed.join(keys.select("key"), "key", "left_semi")
    if distinct:
        found = found.groupBy("key").agg(F.first("row").alias("row"))
    return found.select("row.*")


def rows_drawn(df: DataFrame, draws: DataFrame) -> DataFrame:
    """A row of df for each row of draws with its row_key in column key. Equal rows of df are one another's stand-ins.

    If draws has epoch and position too, rows are sorted by position and, within one, by a hash. They are sorted by ranges,
    so no position meets in one task, nor do the draws of rows that are equal: those are counted before they are shuffled,
    and written out one by one.
    """
    ordered = "position" in draws.columns
    at = [F.col("position"), F.xxhash64("epoch", "key").alias("turn")] if ordered else []
    packed = df.select(row_key(df).alias("key"), F.struct(*(col(c) for c in df.columns)).alias("row"))
    packed = packed.groupBy("key").agg(F.first("row").alias("row"))
    times = draws.select("key", *at).groupBy("key", *(["position", "turn"] if ordered else [])).agg(F.count("*").alias("times"))
    placed = packed.join(times, "key").withColumn("copy", F.explode(F.expr("sequence(1L, times)")))
    if ordered:
        n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        by = ["position", "turn", "copy"]
        placed = placed.select("row", *by).repartitionByRange(n, *by).sortWithinPartitions(*by)
    return placed.select("row.*")
