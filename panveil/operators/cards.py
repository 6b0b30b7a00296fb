from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panveil.functions import MaskMode, brand, contains_run, count_runs, keep_counts, luhn_ok, mask_runs, runs


def mask_columns(df: DataFrame, columns: Sequence[str], mode: MaskMode | str = MaskMode.LAST, keep_n: int = 4, glyph: str = "*") -> DataFrame:
    """The rows with every run in these columns masked; works on a stream as well."""
    lead, trail = keep_counts(mode, keep_n)
    return df.withColumns({c: mask_runs(F.col(c), glyph, lead, trail) for c in columns})


def screen_texts(df: DataFrame, text: str, keep: Sequence[str], mode: MaskMode | str = MaskMode.LAST, keep_n: int = 4) -> DataFrame:
    """Rows whose text holds a run: the columns to keep, n_cards and masked_text."""
    lead, trail = keep_counts(mode, keep_n)
    found = df.where(contains_run(text))
    return found.select(*keep, count_runs(text).alias("n_cards"), mask_runs(text, "*", lead, trail).alias("masked_text"))


def run_inventory(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """One row for each run: its position among the text's runs, the run, its brand and check digit."""
    return df.select(*keep, F.posexplode(runs(text)).alias("run_no", "run")).select(
        *keep, F.col("run_no").cast("long").alias("run_no"), "run", brand("run").alias("brand"), luhn_ok("run").alias("luhn")
    )

