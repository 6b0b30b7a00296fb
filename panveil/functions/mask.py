"""Masking one number, and every run within a text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from panveil.functions.digits import DIGIT, MAX_SHOWN, OTHER, RUN, ColumnLike, as_col, as_int, checked_glyph, glyph_fits, let, replacement
from panveil.functions.keep import clamp_keep, clamp_run


def _head(c: Column, lead: int) -> Column:
    return F.regexp_extract(c, f"^(?:{OTHER}*{DIGIT}){{{lead}}}", 0)


def _covered(rest: Column, repl: Column, trail: int) -> Column:
    return F.regexp_replace(rest, F.lit(f"{DIGIT}(?=(?:{OTHER}*{DIGIT}){{{trail}}})"), repl)


def _hide(c: Column, repl: Column, lead: int, trail: int) -> Column:
    """Digits become the glyph, but for the first lead and the last trail ones."""
    head = _head(c, lead)
    return F.concat(head, _covered(F.substr(c, F.length(head) + 1), repl, trail))


def _choice(n: Column, of: Callable[[int], Column]) -> Column:
    out = F.when(n == 0, of(0))
    for k in range(1, MAX_SHOWN + 1):
        out = out.when(n == k, of(k))
    return out


def _hide_each(c: Column, repl: Column, lead: Column, trail: Column) -> Column:
    """The same for clamped counts that differ from row to row. Each has a constant pattern: one made of a row would be compiled for it."""
    covered = lambda rest, k: _choice(k["trail"], lambda n: _covered(rest, repl, n))
    parts = lambda k: let(_choice(k["lead"], lambda n: _head(c, n) if n else F.lit("")), lambda h: F.concat(h, let(F.substr(c, F.length(h) + 1), lambda rest: covered(rest, k))))
    return let(F.struct(lead.alias("lead"), trail.alias("trail")), parts)


def mask_number(
    number: ColumnLike, glyph: Column | str = "*", lead: Column | int = 0, trail: Column | int = 4, allow_digit: bool = False
) -> Column:
    """One number with all but its first lead and last trail digits replaced by glyph.

    Keep counts are clamped to ten digits and to one less than there are. Other characters stay, so the length
    does. Text without a digit stays as it is, and NULL gives NULL, as does a glyph of a column that is not one
    character of the basic plane or, unless allow_digit, a digit. Not idempotent: masked digits count no more.
    """
    c, repl = as_col(number), replacement(glyph, allow_digit)
    n = F.regexp_count(c, F.lit(DIGIT))
    few = lambda n: F.when(n > 0, _hide_each(c, repl, *clamp_keep(n, lead, trail))).otherwise(c)
    if isinstance(lead, Column) or isinstance(trail, Column):
        masked = let(n, few)
    else:  # beyond ten digits the clamp no longer depends on the row, so one compiled pattern serves them all
        masked = F.when(n > MAX_SHOWN, _hide(c, repl, *clamp_run(lead, trail))).otherwise(let(n, few))
    return F.when(glyph_fits(glyph, allow_digit), masked) if isinstance(glyph, Column) else masked


def _mask_run(run: Column, glyph: Column | str, lead: Column, trail: Column) -> Column:
    parts = F.concat(F.lit("^((?:[^0-9]*[0-9]){"), lead, F.lit("})(.*?)((?:[^0-9]*[0-9]){"), trail, F.lit("})$"))
    part = lambda k: F.call_function("regexp_extract", run, parts, F.lit(k))
    hidden = F.translate(part(2), "0123456789", glyph * 10) if isinstance(glyph, str) else F.regexp_replace(part(2), F.lit("[0-9]"), replacement(glyph))
    return F.concat(part(1), hidden, part(3))


def mask_runs(
    text: ColumnLike, glyph: Column | str = "*", lead: Column | int = 0, trail: Column | int = 4, allow_digit: bool = False
) -> Column:
    """Every run in the text masked like mask_number; all other text stays, and NULL gives NULL, as does a column's unfit glyph.

    A run has 12 digits at least, so its clamp is the same for every run. The ten-digit limit holds for each run
    that the pattern finds, not for longer stretches of digits, of which what follows the 19th digit may stay.
    """
    c = as_col(text)
    if isinstance(glyph, str):
        checked_glyph(glyph, allow_digit)
    if isinstance(lead, Column) or isinstance(trail, Column):
        t = F.greatest(F.least(as_int(trail), F.lit(MAX_SHOWN)), F.lit(0))
        keep = (F.greatest(F.least(as_int(lead), F.lit(MAX_SHOWN) - t), F.lit(0)).cast("string"), t.cast("string"))
    else:
        keep = tuple(F.lit(str(x)) for x in clamp_run(lead, trail))
    pieces = F.zip_with(
        F.split(c, RUN, -1),
        F.regexp_extract_all(c, F.lit(f"({RUN})"), F.lit(1)),
        lambda gap, run: F.concat(gap, F.coalesce(_mask_run(run, glyph, *keep), F.lit(""))),
    )
    masked = F.when(F.rlike(c, F.lit(RUN)), F.array_join(pieces, "")).otherwise(c)
    return F.when(glyph_fits(glyph, allow_digit), masked) if isinstance(glyph, Column) else masked
