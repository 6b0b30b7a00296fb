"""Grouping, glyph classes, offsets and captions for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panveil.functions.digits import DIGIT, ColumnLike, as_col
from panveil.functions.keep import MaskMode


def group4(number: ColumnLike) -> Column:
    """A space before every fourth character but the first."""
    return F.regexp_replace(as_col(number), r"(?s)(.{4})(?=.)", "$1 ")


def hero_compact(number: ColumnLike) -> Column:
    return F.regexp_replace(as_col(number), "[- ]", "")


def hero(number: ColumnLike) -> Column:
    """Separators dropped, then grouped by four."""
    return group4(hero_compact(number))


def digit_glyphs(number: ColumnLike) -> Column:
    """array<struct<pos,ch,kept>>: a character is kept if it is a digit of any script; empty for an empty text."""
    c = as_col(number)
    marked = F.transform(F.split(c, ""), lambda ch, i: F.struct(i.alias("pos"), ch.alias("ch"), F.rlike(ch, F.lit(f"^{DIGIT}$")).alias("kept")))
    return F.filter(marked, lambda g: g["ch"] != "")


def _offset(n: ColumnLike | int) -> Column:
    return F.lit(n) if isinstance(n, int) else as_col(n)


def to_grouped_offset(offset: ColumnLike | int) -> Column:
    """Cursor offset in the plain text -> offset in the grouped text."""
    offset = _offset(offset)
    return F.when(offset <= 0, F.lit(0)).otherwise(offset + F.floor((offset - 1) / 4)).cast("int")


def to_plain_offset(offset: ColumnLike | int) -> Column:
    """Cursor offset in the grouped text -> offset in the plain text."""
    offset = _offset(offset)
    return F.when(offset <= 0, F.lit(0)).otherwise(offset - F.floor(offset / 5)).cast("int")


def layout_x(number: ColumnLike, start: float = 90.0, width: float = 1.0) -> Column:
    """digit_glyphs with the pen position of each glyph: 0.6 widths more before each fourth but the first."""
    return F.transform(
        digit_glyphs(number),
        lambda g: F.struct(g["pos"].alias("pos"), g["ch"].alias("ch"), g["kept"].alias("kept"), (F.lit(start) + F.lit(width) * (g["pos"] + 0.6 * F.floor(g["pos"] / 4))).alias("x")),
    )


def reveal_caption(mode: Column | MaskMode, keep_n: Column | int) -> Column:
    # The captions.
    m = mode if isinstance(mode, Column) else F.lit(mode.value)
    n = keep_n if isinstance(keep_n, Column) else F.lit(keep_n)
    return (
        F.when(m == "FIRST6_LAST4", "Showing first 6 + last 4")
        .when(n == 0, "Masking every digit")
        .when(m == "LAST", F.concat(F.lit("Keeping last "), n.cast("string")))
        .when(m == "FIRST", F.concat(F.lit("Keeping first "), n.cast("string")))
    )


def detected_caption(count: Column) -> Column:
    # Fixed value: the caption.
    return F.concat(count.cast("string"), F.lit(" card number(s) detected"))
