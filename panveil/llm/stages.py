"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir); all but the last return the columns of docs.

All of them read docs alone, by the columns doc_id, text, source and n_chars, and pass any other columns through whatever
their names. Ids are of any type that sorts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panveil.llm import dedup, jaccard, mixing, pack, quality
from panveil.llm.queries import END_ID, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules of their own and are not depleted of lines that others share, without those lines.

    n_chars, if there, is that of the new text. Null, empty and blank texts have too few words and go, as do very short ones; a very long text is
    judged as a whole. A null source is a host. Of rows that are equal all stay or none. No documents, no result.
    """
    return quality.clean(docs, "doc_id", "text", "source", "n_chars")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, letter case of A-Z aside, the one with the smallest id.

    Null and empty texts are one text, of which one document stays. Of rows with the same id and text one stays, so of
    equal rows one; a null id stays only if no other has the text. Very long texts are compared as a whole. No documents,
    no result.
    """
    return dedup.drop_copies(docs, "doc_id", "text", keep="smallest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a similarity of 0.8 or more of their five-word shingles, the one with the smallest id.

    Null, empty and blank texts are alike, and one of them stays. Texts of fewer than five words are alike if all their
    words are. Of equal rows one stays; a null id stays only if its class has no other. Very long texts count with all
    their shingles. No documents, no result.
    """
    kept = jaccard.similar(docs, "doc_id", "text").where("kept").select(F.col("row_key").alias("key"))
    return dedup.rows_of(docs, kept)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture draws them, in its order.

    Sources count by the tokens that packing will give their texts. Null and empty texts have one, for the end; a null source is a source;
    equal rows are drawn each; a very long text may exceed its source's quota, by less than its own length. Sources of
    equal tokens can't meet a target entropy, which is an error. No documents, no result.
    """
    tokens = pack.token_count(F.col("text"), tokenizer_path())
    drawn = mixing.mix(docs, "doc_id", "text", "source", tokens=tokens).select(F.col("row_key").alias("key"), "epoch", "position")
    return dedup.rows_drawn(docs, drawn)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are a piece of one token, their end. Equal rows and ids are documents each, null ids stay, and a
    very long text is cut into as many pieces as it takes. No documents, no result.
    """
    pieces = pack.concatenate_and_cut(docs, "doc_id", "text", tokenizer_path(), 2048, END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
