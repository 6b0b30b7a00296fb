"""Quality rules: counts of words, symbols and repeats in a text, and lines that too many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panveil.llm.common import col, cut, hash128, let, row_key, whole

# What separates words, and which characters are symbols.
SPACE = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: A column of our own beside those of the input.
GONE = "__gone_lines"


def words_of(text: Column) -> Column:
    """Its words; empty for a text without any."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more.

    Windows are sorted by 64-bit hash and place, neighbours compared, and the places of equal ones spread to the three
    words each covers.
    """
    windows = let(words, lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.struct(F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)).alias("h"), i.alias("i"))))
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    twice = let(F.sort_array(windows), lambda s: F.filter(
        F.transform(s, lambda x, k: F.when(same(x, F.get(s, k + 1)) | F.when(k > 0, same(x, F.get(s, k - 1))).otherwise(False), x["i"])), lambda i: i.isNotNull(),
    ))
    covered = let(twice, lambda t: F.size(F.array_distinct(F.concat(t, F.transform(t, lambda i: i + 1), F.transform(t, lambda i: i + 2)))))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(covered).cast("long")


def without(text: Column, places: Column) -> Column:
    """The text without the lines at places, which are ascending and count from 0."""

    def between(lines: Column) -> Column:
        ends = F.concat(places, F.array(F.size(lines)))
        begins = F.concat(F.array(F.lit(0)), F.transform(places, lambda p: p + 1))
        return F.flatten(F.zip_with(begins, ends, lambda b, e: F.slice(lines, b + 1, e - b)))

    return F.array_join(let(F.split(text, "\n"), between), "\n")


def line_rules(
    df: DataFrame, id_col: str, text_col: str, host_col: str, min_words: int = 50, max_repeat_percent: int = 50,
    min_documents: int = 50, max_percent: float | None = None, min_left_percent: int = 20,
) -> DataFrame:
    """One row for each input row: doc_id, the counts, base_failed, kept, n_left_chars, gone_lines and row_key.

    A line, in lower case and with white space collapsed, is above the limit of its host if more than min_documents
    of the host's documents hold it, however large the host; documents with equal texts count as one. max_percent, if
    given, asks for more than that share of the host's documents besides, so the limit grows with the host. Such lines
    are removed from all documents of the host but one: the smallest id of those that pass the rules of their own, or
    of all if none does. gone_lines has their places in the text, ascending from 0, and clean() writes the text without
    them. A document of whose line characters less than
    min_left_percent is left is depleted and rejected, and so is one that fails a rule of its own: fewer than min_words
    words, or more than max_repeat_percent of them in repeated 3-word windows.

    Texts and lines are told apart by 128 bits. Null text has no words and fails; null hosts are one host; null ids come
    first. No group of a host or line meets in one task: counts are combined before each shuffle. Rows that are equal get
    equal results. A very long text is held with its words and lines by the task that reads it. No rows, no result.
    """
    text = whole(text_col)
    solid = lambda line: F.trim(line, F.lit(SPACES)) != ""
    read = df.select(
        row_key(df).alias("row_key"), col(id_col).alias("doc_id"), F.coalesce(F.concat(F.lit("="), col(host_col).cast("string")), F.lit("")).alias("host"),
        text.alias("text"), words_of(text).alias("words"),
        F.split(text, "\n").alias("all_lines"), F.filter(F.split(text, "\n"), solid).alias("lines"),
    )
    c1, c2 = hash128(F.col("text"))
    flat = lambda line: F.regexp_replace(F.trim(F.lower(line), F.lit(SPACES)), f"[{SPACE}]+", " ")
    counted = read.select(
        "row_key", "doc_id", "host", c1.alias("c1"), c2.alias("c2"), F.monotonically_increasing_id().alias("row"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        # Of all lines, so that places count blank ones too, which have neither hash nor size.
        F.transform("all_lines", lambda x: F.when(solid(x), let(flat(x), lambda f: F.struct(*(h.alias(n) for h, n in zip(hash128(f), ("h1", "h2"), strict=True)))))).alias("hashes"),
        F.transform("all_lines", lambda x: F.when(solid(x), F.length(x)).otherwise(0)).alias("sizes"),
    )
    documents = cut(counted)
    line = F.posexplode(F.arrays_zip(F.col("hashes").alias("hash"), F.col("sizes").alias("size"))).alias("place", "line")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    lines = documents.select("row", "doc_id", "host", "c1", "c2", failed.alias("failed"), line).where("line.hash IS NOT NULL")
    lines = lines.select("row", "doc_id", "host", "c1", "c2", "failed", "place", "line.hash.h1", "line.hash.h2", "line.size")
    held = lines.groupBy("host", "h1", "h2", "c1", "c2").agg(F.min(F.struct("failed", "doc_id", "c1", "c2")).alias("first"))
    spread = held.groupBy("host", "h1", "h2").agg(F.count("*").alias("documents"), F.min("first").alias("first"))
    frequent = spread.where(F.col("documents") > min_documents)
    if max_percent is not None:
        hosts = documents.groupBy("host", "c1", "c2").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("of"))
        frequent = frequent.join(hosts, "host").where(F.col("documents") * 100 > F.col("of") * max_percent)
    gone = lines.join(frequent.select("host", "h1", "h2", "first"), ["host", "h1", "h2"]).where("c1 != first.c1 OR c2 != first.c2")
    gone = gone.groupBy("row").agg(F.sum("size").alias("gone"), F.sort_array(F.collect_list("place")).alias("gone_lines"))
    all_chars = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    left = documents.join(gone, "row", "left").withColumn("n_line_chars", all_chars).withColumn("n_left_chars", F.col("n_line_chars") - F.coalesce("gone", F.lit(0)))
    depleted = F.col("n_left_chars") * 100 < F.col("n_line_chars") * min_left_percent
    return left.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "n_left_chars",
        F.coalesce("gone_lines", F.array().cast("array<int>")).alias("gone_lines"), "row_key",
    )


def clean(df: DataFrame, id_col: str, text_col: str, host_col: str, chars_col: str | None = None, **limits) -> DataFrame:
    """The input rows that line_rules keeps, with all their columns; texts are without the lines that are removed.

    Null texts and those without words fail its rules and go; of rows that are equal all stay or none. Text without a line
    to remove is not touched. No rows, no result. chars_col, if given and there, is the length of the new text where lines are removed. limits are those of line_rules.
    """
    kept = line_rules(df, id_col, text_col, host_col, **limits).where("kept").select(F.col("row_key").alias("key"), "gone_lines")
    # Equal rows share a key and lose the same lines. A cut, so that the join shuffles for itself and can be split.
    kept = cut(kept.groupBy("key").agg(F.first("gone_lines").alias("gone_lines")))
    packed = df.select(row_key(df).alias("key"), F.struct(*(col(c) for c in df.columns)).alias("row"))
    found = packed.join(kept, "key").select("row.*", F.col("gone_lines").alias(GONE))
    some = F.size(GONE) > 0
    found = found.withColumn(text_col, F.when(some, without(whole(text_col), F.col(GONE))).otherwise(col(text_col)))
    if chars_col in df.columns:
        found = found.withColumn(chars_col, F.when(some, F.length(col(text_col)).cast(df.schema[chars_col].dataType)).otherwise(col(chars_col)))
    return found.drop(GONE)
