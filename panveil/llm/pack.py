"""Packing by concatenate and cut: token totals of partitions, prefix sums, fixed windows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panveil.llm.common import col, cut, stored, whole

# Fixed value: the piece pattern of a lower-casing word BPE whose words end in </w>.
_WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# Text that lower-cases, composes and splits alike here and in the tokenizer: ASCII and most Latin letters.
_PLAIN_TEXT = "^[\\t\\n\\r -~À-ÖØ-öø-įı-ž]*$"
_PIECE = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^\\sa-zß-öø-ž0-9]+)"
_BATCH_BYTES = 16 << 20
_COUNT_BYTES = 4 << 20  # where only counts are wanted, beside whatever else the task does


def _byte_letters() -> dict[int, str]:
    """The letter for each byte in byte-level BPE: printable ones stand for themselves, others from 256 on; no piece holds a space."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in shown) if b != 32}


def _gather(index, starts, sizes, data):
    """The items of each index one after another, and how many each has."""
    n = sizes[index]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[index] - ends + n, n)
    return data[at], n


class Encoder:
    """Token ids of texts as unsigned 32-bit little-endian bytes.

    A word BPE that lower-cases and drops white space takes each text to the ids of its pieces, one after another. So
    plain Latin text is cut into pieces and each distinct piece of a batch is encoded once, unless it is among those
    used last, of which between cache and twice cache are kept. Any other text or tokenizer is encoded whole.
    """

    def __init__(self, path: str, cache: int = 300_000):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        config = json.loads(self.tokenizer.to_str())
        self.by_piece, self.cache, self.known, self.old = self._splits_words(config), cache, {}, {}
        if self.by_piece:
            vocab, merges = config["model"]["vocab"], config["model"]["merges"]
            pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in merges]
            self.pieces = Tokenizer(models.BPE(vocab=vocab, merges=pairs, end_of_word_suffix="</w>", cache_capacity=0))
            self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.letters, self.special = _byte_letters(), [t["content"] for t in config["added_tokens"]]
            self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.ends[[k for token, k in vocab.items() if token.endswith("</w>")]] = True

    @staticmethod
    def _splits_words(config: dict) -> bool:
        steps = [(x["type"], x.get("pattern")) for x in (config["normalizer"] or {}).get("normalizers", [])]
        cuts = [(x["type"], x.get("pattern"), x.get("behavior")) for x in (config["pre_tokenizer"] or {}).get("pretokenizers", [])]
        return (
            steps == [("NFC", None), ("Replace", {"Regex": "\\s+"}), ("Lowercase", None)]
            and cuts == [("Split", {"Regex": _WORD_PATTERN}, "Removed"), ("ByteLevel", None, None)]
            and config["model"]["type"] == "BPE"
            and config["model"]["end_of_word_suffix"] == "</w>"
            and not config["model"]["dropout"]
            and not config["post_processor"]
        )

    def _learn(self, pieces: list[str]) -> None:
        """Encodes new pieces as one text; an id that ends a word ends a piece."""
        text = " ".join(pieces)
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.letters)
        ids = np.array(self.pieces.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        data, ends = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        self.known.update(zip(pieces, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def _look_up(self, pieces: list[str]) -> list[bytes]:
        if len(self.known) > self.cache:
            self.known, self.old = {}, self.known
        self.known[""] = b""  # what an empty text splits into
        new = [p for p in pieces if p not in self.known]
        self.known.update({p: v for p in new if (v := self.old.get(p)) is not None})
        new = sorted((p for p in new if p not in self.known), key=str.isascii)
        for i in range(0, len(new), 5000):
            self._learn(new[i : i + 5000])
        return list(map(self.known.__getitem__, pieces))

    def _plain(self, texts: pa.Array) -> list[bytes]:
        by_text = pc.ascii_split_whitespace(pc.utf8_trim(pc.utf8_lower(texts), "\t\n\r "))
        words = by_text.flatten().dictionary_encode()
        cut_up = pc.ascii_split_whitespace(pc.utf8_rtrim(pc.replace_substring_regex(words.dictionary, _PIECE, "\\1 "), " "))
        pieces = cut_up.flatten().dictionary_encode()
        found = self._look_up(pieces.dictionary.to_pylist())
        data, sizes = np.frombuffer(b"".join(found), dtype="<u4"), np.array([len(x) // 4 for x in found], dtype=np.int64)
        ids, sizes = _gather(pieces.indices.to_numpy(), np.cumsum(sizes) - sizes, sizes, data)
        ends = np.concatenate([[0], np.cumsum(sizes)])[cut_up.offsets.to_numpy()]  # of the distinct words
        ids, sizes = _gather(words.indices.to_numpy(), ends[:-1], np.diff(ends), ids)
        ends = np.concatenate([[0], np.cumsum(sizes)])[by_text.offsets.to_numpy()].tolist()
        return [ids[i:j].tobytes() for i, j in zip(ends, ends[1:])]

    def __call__(self, texts: pa.Array) -> list[bytes]:
        plain = pc.match_substring_regex(texts, _PLAIN_TEXT) if self.by_piece else pa.array([False] * len(texts))
        for special in self.special if self.by_piece else ():
            plain = pc.and_not(plain, pc.match_substring(texts, special))
        fast = iter(self._plain(texts.filter(plain)))
        return [next(fast) if p else np.array(self.tokenizer.encode(t.as_py(), add_special_tokens=False).ids, dtype="<u4").tobytes() for p, t in zip(plain.to_pylist(), texts, strict=True)]


def _slices(batch: pa.RecordBatch, column: int, most: int = _BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about so many bytes of that column, a row at least."""
    sizes, begin, held = pc.binary_length(batch.column(column)).to_pylist(), 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if batch.num_rows:
        yield batch.slice(begin)


def _encoder(path: str, pieces: int = 300_000) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, pieces)


def token_count(text: Column, tokenizer: str) -> Column:
    """How many ids tokenized() gives a text, the one for its end included; a null text is empty."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(tokenizer, 150_000)
        for texts in batches:
            parts = _slices(pa.RecordBatch.from_arrays([texts], names=["text"]), 0, _COUNT_BYTES)
            yield pa.array([len(ids) // 4 + 1 for part in parts for ids in encoder(part.column(0))], pa.int64())
            pa.default_memory_pool().release_unused()

    return count(F.coalesce(text.cast("string"), F.lit("")))


def tokenized(df: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int) -> DataFrame:
    """First pass: part, at (ids before it in its part), doc_id, n, ids; stored, since no later pass repeats it."""
    kind = df.select(col(id_col)).schema[0].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("doc_id", kind), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, at, end = _encoder(tokenizer), TaskContext.get().partitionId(), 0, end_id.to_bytes(4, "little")
        for batch in batches:
            for piece in _slices(batch, 1):
                ids = [x + end for x in encoder(piece.column(1))]
                sizes = [len(x) // 4 for x in ids]
                starts = []
                for n in sizes:
                    starts.append(at)
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), piece.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], names=["part", "at", "doc_id", "n", "ids"])

    return stored(df.select(col(id_col).alias("doc_id"), whole(text_col).alias("text")).mapInArrow(encode, schema), "tokens")


def concatenate_and_cut(df: DataFrame, id_col: str, text_col: str, tokenizer: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """One row for each piece of a document in a sequence: doc_id, start, length, ids (bytes), doc_tokens, sequence_id, offset.

    Each document is its ids and then end_id. The documents follow one another in the order in which partitions were
    read, and every length ids make a sequence, so that only the last one has room left. A partition's first id comes
    after the totals of those before it, a row for each partition; a document that crosses a boundary gives a record
    on either side.

    Null text is empty text, of which end_id alone remains. Null and repeated ids stay as they are, a document for
    each row. tokenizer is a path that every executor can read. No rows, no result.
    """
    tokens = tokenized(df, id_col, text_col, tokenizer, end_id)
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = cut(totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("begin")))  # a row for each partition read
    placed = tokens.join(F.broadcast(begins), "part").withColumn("first", F.col("begin") + F.col("at"))
    last = F.expr(f"(first + n - 1) div {length}")
    pieces = placed.withColumn("sequence_id", F.explode(F.sequence(F.expr(f"first div {length}"), last)))
    start = F.greatest(F.col("sequence_id") * length - F.col("first"), F.lit(0))
    end = F.least((F.col("sequence_id") + 1) * length - F.col("first"), F.col("n"))
    pieces = pieces.withColumns({"start": start, "length": end - start})
    return pieces.select(
        "doc_id", "start", "length",
        F.expr("substring(ids, cast(start * 4 + 1 as int), cast(length * 4 as int))").alias("ids"),
        F.col("n").alias("doc_tokens"), "sequence_id", (F.col("first") + F.col("start") - F.col("sequence_id") * length).alias("offset"),
    )
