"""The older tail mask. It counts characters, not digits, and may show a whole number; prefer mask_number."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from panveil.functions.digits import ColumnLike, as_col, checked_glyph, replacement

# Fixed value: what follows an account that is too short.
TOO_SHORT = " \n\nUnable to Masked due to limit of Card Number"

#: Up to this many characters are counted by a pattern at each place, which is fastest for short accounts but takes stack for each; beyond it from the end, once.
COUNTED = 64


def tail_mask(account: ColumnLike, keep: int, glyph: str = "*", ignored: str = "-") -> Column:
    """All but the last keep characters replaced, ignored ones passed through and not counted.

    An account with fewer than keep characters, hyphens apart, comes back with a message appended. keep may be as large
    as an int is.
    """
    if keep < 0:
        raise ValueError("keep is 0 or more")
    c, skip = as_col(account), re.escape(checked_glyph(ignored, allow_digit=True))
    repl = replacement(glyph, allow_digit=True)
    has = lambda ch: F.contains(c, F.lit(ch))
    if keep <= COUNTED:
        hidden = F.regexp_replace(c, F.lit(f"[^{skip}](?=(?:{skip}*[^{skip}]){{{keep}}})"), repl)
    else:
        # Possessive, so that it neither goes back nor takes stack, and from the end, so that it is one pattern for all rows.
        shown = F.regexp_extract(F.reverse(c), f"(?:{skip}*+[^{skip}]){{0,{keep}}}+", 0)
        cover = F.regexp_replace(F.substr(c, F.lit(1), F.length(c) - F.length(shown)), F.lit(f"[^{skip}]"), repl)
        # Most have nothing to ignore, and then lengths tell all.
        plain = F.repeat(F.regexp_replace(F.lit("x"), F.lit("x"), repl), F.length(c) - keep)
        hidden = F.when(has(ignored), F.concat(cover, F.reverse(shown))).otherwise(F.concat(plain, F.substr(c, F.length(c) - keep + 1)))
    # Hyphens are counted only where they can make a difference.
    short = (F.length(c) < keep) | (has("-") & (F.length(F.replace(c, F.lit("-"), F.lit(""))) < keep))
    return F.when(short, F.concat(c, F.lit(TOO_SHORT))).otherwise(hidden)
