"""Chat formatting from event logs: fold each message's events, render it, and read the output back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panveil.llm.common import col

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Breaks up control strings: a backslash more in each "<", backslashes, "|". unescape() takes it out again."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: Column) -> Column:
    """As escape, and newlines and backslashes written out, since a newline ends the role."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def reconstruct(events: DataFrame, conv_col: str, message_col: str, seq_col: str, kind_col: str, role_col: str, text_col: str) -> DataFrame:
    """Final messages of an event log: conv_id, first (their place), role, text.

    Kinds: start opens a message and names its role; delta appends text; edit replaces all text so far; regenerate
    drops it, so that later deltas begin anew; delete drops the message. Other kinds, null included, change nothing.
    seq_col is any sortable column; messages follow in the order of their first event. Groups are messages, not
    conversations, so a long conversation is spread over tasks; a message's events, which make up one text, meet in one.

    Null text is empty, a null role or one never named is empty, of several roles the greatest holds, null conversations are
    one conversation, as are null messages of one a message. Events with equal seq are taken in the order of kind and text,
    and equal events count each. A message without start still counts. No events, no result. Extra columns are left out.
    """
    one = F.struct(col(seq_col).alias("seq"), col(kind_col).alias("kind"), col(text_col).alias("text"), col(role_col).alias("role"))
    grouped = events.groupBy(col(conv_col).alias("conv_id"), col(message_col).alias("message")).agg(F.sort_array(F.collect_list(one)).alias("log"))
    resets = F.transform("log", lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i + 1).otherwise(0))
    folded = grouped.select(
        "conv_id",
        "message",
        F.element_at("log", 1)["seq"].alias("first"),
        F.array_max(F.transform("log", lambda e: e["role"])).alias("role"),
        F.exists("log", lambda e: F.coalesce(e["kind"] == "delete", F.lit(False))).alias("deleted"),
        "log",
        F.array_max(resets).alias("reset"),
    ).where(~F.col("deleted"))
    live = F.filter(F.slice("log", F.greatest("reset", F.lit(1)), F.size("log")), lambda e: e["kind"].isin("delta", "edit"))
    return folded.select(
        "conv_id", "first", "message", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform(live, lambda e: F.coalesce(e["text"], F.lit(""))), "").alias("text")
    )


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """A formatted segment for each message; a conversation's output is its segments in order, nothing between.

    Columns conv_id, first, message, segment, and mask_start and mask_end: the code points of the segment that
    training learns from, which is the text of messages by learn; equal for others. Control strings in texts and roles are
    broken up, reversibly, so only those written here stand in the output. Messages are as reconstruct() gives them, without
    nulls in role and text; texts of any length become one segment each, and equal messages a segment each. No messages, no result.
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    begin = F.length("head").cast("long")
    return messages.select("conv_id", "first", "message", "role", head.alias("head"), body.alias("body")).select(
        "conv_id", "first", "message", F.concat("head", "body", F.lit(f"{END}\n")).alias("segment"), begin.alias("mask_start"),
        F.when(F.col("role") == learn, begin + F.length("body")).otherwise(begin).alias("mask_end"),
    )


class Reader:
    """Turns of one conversation from its formatted text, which may come in pieces cut anywhere.

    Only control strings tell where a turn begins and ends: START, a role up to a newline, text up to END, and a newline.
    Anything else raises ValueError, a control string within a text included.
    """

    def __init__(self) -> None:
        self.held, self.searched = "", 0

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """Role and text, unescaped, of each turn that ends with this piece."""
        self.held += piece
        while (end := self.held.find(END + "\n", self.searched)) >= 0:
            turn, self.held, self.searched = self.held[:end], self.held[end + len(END) + 1 :], 0
            role, newline, text = turn.removeprefix(START).partition("\n")
            if not turn.startswith(START) or not newline or any(mark in part for mark in (START, END) for part in (role, text)):
                raise ValueError("formatted text is damaged")
            yield unescape_role(role), unescape(text)
        self.searched = max(len(self.held) - len(END), 0)

    def close(self) -> None:
        if self.held:
            raise ValueError("formatted text ends within a turn")


def read_back(segments: DataFrame, learn: str = "assistant") -> DataFrame:
    """A row for each conversation, parsed from the formatted output alone: counts and digests of turns and learnt text.

    Columns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Of segments, only the text is read, as
    one run of characters: Reader finds the turns in it, wherever segments are cut, and what learn says is learnt. A
    text that broke out of its turn would show as more turns, or as damage, which raises an error.

    Segments are sorted by conversation and place and read as a stream, so that a task holds a batch, a turn and two
    running digests, however long a conversation is. Both digests run through a conversation in order, so one task reads
    it. A null conversation is one, and ids are of any type. No segments, no result.
    """
    kind = segments.select("conv_id").schema[0].dataType
    fields = [("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType())]
    schema = T.StructType([T.StructField("conv_id", kind), *(T.StructField(n, t) for n, t in fields)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        conv, state, ids, rows = None, None, [], []

        def done() -> None:
            if state:
                state[0].close()
                ids.append(conv)
                rows.append((state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def batch(of: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(ids, of), *map(pa.array, columns, kinds)], names=schema.names)

        for part in batches:
            of = part.column(0).type
            for c, segment in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if state is None or c != conv:
                    done()
                    conv, state = c, [Reader(), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[5] += len(segment)
                for role, text in state[0].feed(segment):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                    if role == learn:
                        state[3] += len(text)
                        state[4].update(text.encode())
            yield batch(of)
            ids, rows = [], []
        if state:
            done()
            yield batch(of)

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "first", "message")
    return ordered.select("conv_id", "segment").mapInArrow(read, schema)


def as_events(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, chunk: int = 256) -> DataFrame:
    """An event log that amounts to these turns: drafts that are regenerated or edited, then text streamed in deltas.

    Columns conv_id, message, seq, kind, role, text. Turns of the same number are ordered by role and MD5 of the text; null
    numbers come first. Null roles and texts are empty, rows that are equal are turns each, and a long text becomes deltas of
    chunk characters. No rows, no events.
    """
    role, text = F.coalesce(col(role_col), F.lit("")), F.coalesce(col(text_col), F.lit(""))
    base = rows.select(col(conv_col).alias("conv_id"), col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("message"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(chunk))
    parts = F.transform(starts, lambda s: F.struct(F.lit("delta").alias("kind"), F.substr("text", s, F.lit(chunk)).alias("text")))
    fixed = lambda kind, t: F.struct(F.lit(kind).alias("kind"), F.lit(t).alias("text"))
    draft = F.when(F.col("role") == "assistant", F.array(fixed("start", None), fixed("delta", "A draft."), fixed("regenerate", None)))
    draft = draft.otherwise(F.array(fixed("start", None), fixed("delta", "A typo"), fixed("edit", "")))
    place = F.struct("turn", "role", F.md5("text").alias("tie"), "message")
    return base.select("conv_id", "message", "role", place.alias("place"), F.posexplode(F.concat(draft, parts)).alias("k", "event")).select(
        "conv_id", "message", F.struct("place", "k").alias("seq"), "event.kind", "role", "event.text"
    )
