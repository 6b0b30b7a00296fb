"""How many leading and trailing digits stay visible."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from panveil.functions.digits import MAX_SHOWN, as_int


class MaskMode(Enum):
    # The names of the modes.
    LAST = "LAST"
    FIRST = "FIRST"
    FIRST6_LAST4 = "FIRST6_LAST4"


def keep_counts(mode: MaskMode | str = MaskMode.LAST, keep_n: int = 4) -> tuple[int, int]:
    """(leading, trailing) for a mode; not clamped."""
    return {MaskMode.LAST: (0, keep_n), MaskMode.FIRST: (keep_n, 0), MaskMode.FIRST6_LAST4: (6, 4)}[MaskMode(mode)]


def keep_columns(mode: Column, keep_n: Column | int = 4) -> Column:
    """struct<lead,trail> for a column of mode names; NULL fields for an unknown mode."""
    n = as_int(keep_n)
    by_mode = lambda last, first, both: F.when(mode == "LAST", last).when(mode == "FIRST", first).when(mode == "FIRST6_LAST4", both)
    return F.struct(by_mode(F.lit(0), n, F.lit(6)).alias("lead"), by_mode(n, F.lit(0), F.lit(4)).alias("trail"))


def clamp_keep(digits: Column | int, lead: Column | int, trail: Column | int) -> tuple[Column, Column]:
    """At most ten digits and never all of them are shown; leading ones give way first."""
    most = F.greatest(F.least(F.lit(MAX_SHOWN), as_int(digits) - 1), F.lit(0))
    t = F.greatest(F.least(as_int(trail), most), F.lit(0))
    return F.greatest(F.least(as_int(lead), most - t), F.lit(0)), t


def clamp_run(lead: int, trail: int) -> tuple[int, int]:
    """clamp_keep for 11 digits or more, worked out while the plan is built."""
    t = max(min(trail, MAX_SHOWN), 0)
    return max(min(lead, MAX_SHOWN - t), 0), t


def slider(n: Column | int | float) -> Column:
    """A slider position: rounded half up to a whole number within 0 to 10."""
    c = n if isinstance(n, Column) else F.lit(n)
    return F.least(F.greatest(F.floor(c + 0.5), F.lit(0)), F.lit(MAX_SHOWN)).cast("int")
