"""Digit classes, the card-run pattern, and glyph checks shared by all functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a card-like run, the limits, and the glyphs a user may pick.
RUN = r"[0-9](?:[ \-]?[0-9]){11,18}"
MAX_SHOWN = 10
MAX_TYPED = 19
GLYPHS = ("*", "•", "#", "x", "$", "!", "@", "%", "^", "&")

# Counting and masking treat any decimal digit of the basic plane as a digit; detection is ASCII only.
DIGIT = r"[\p{Nd}&&[\x{0}-\x{FFFF}]]"
OTHER = r"[\P{Nd}\x{10000}-\x{10FFFF}]"
# One character of the basic plane, and one that is no digit.
ANY_GLYPH = r"(?s)\A[\x{0}-\x{FFFF}]\z"
GLYPH = r"(?s)\A[\x{0}-\x{FFFF}&&[^\p{Nd}]]\z"

# Digits of the basic plane beyond ASCII, and what each is worth.
WIDE = "".join(chr(c) for c in range(128, 0x10000) if unicodedata.category(chr(c)) == "Nd")
WORTH = "".join(str(unicodedata.decimal(c)) for c in WIDE)

ColumnLike = Column | str


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_int(n: Column | int) -> Column:
    """A literal keep count may exceed 32 bits or be negative; clamping comes later."""
    return n if isinstance(n, Column) else F.lit(max(-(2**31), min(n, 2**31 - 1)))


def checked_glyph(glyph: str, allow_digit: bool = False) -> str:
    if len(glyph) != 1 or ord(glyph) > 0xFFFF:
        raise ValueError(f"a glyph is one character of the basic plane, not {glyph!r}")
    if glyph.isdecimal() and not allow_digit:
        raise ValueError("a digit as glyph could not be told from a digit that is shown")
    return glyph


def glyph_fits(glyph: Column, allow_digit: bool = False) -> Column:
    """What checked_glyph asks of a literal, for a column; false for NULL."""
    return F.coalesce(F.rlike(glyph, F.lit(ANY_GLYPH if allow_digit else GLYPH)), F.lit(False))


def glyph_offered(glyph: ColumnLike) -> Column:
    """Whether the glyph is one of GLYPHS, those that a user may pick; masking itself takes any that fits. NULL for NULL."""
    return as_col(glyph).isin(*GLYPHS)


def replacement(glyph: Column | str, allow_digit: bool = False) -> Column:
    """The glyph as replacement text for regexp_replace, in which $ and \\ have a meaning of their own. NULL for a column's unfit glyphs."""
    if isinstance(glyph, Column):
        return F.when(glyph_fits(glyph, allow_digit), F.regexp_replace(glyph, r"([\\$])", r"\\$1"))
    g = checked_glyph(glyph, allow_digit)
    return F.lit("\\" + g if g in "\\$" else g)


def let(value: Column, body) -> Column:
    """Evaluates value once and gives it to body; a plain reuse may be computed once for each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def contains_run(text: ColumnLike) -> Column:
    """Whether the text holds a run of 12 to 19 digits; NULL for NULL."""
    return F.rlike(as_col(text), F.lit(RUN))


def runs(text: ColumnLike) -> Column:
    """All runs, leftmost first, not overlapping; an empty array without any, NULL for NULL."""
    return F.regexp_extract_all(as_col(text), F.lit(f"({RUN})"), F.lit(1))
