"""Counting runs, extracting digits, brand and check digit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panveil.functions.digits import MAX_TYPED, OTHER, RUN, WIDE, WORTH, ColumnLike, as_col


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, OTHER, "")


def count_runs(text: ColumnLike) -> Column:
    """How many runs the text holds; NULL for NULL."""
    return F.regexp_count(as_col(text), F.lit(RUN)).cast("long")


def first_digits(text: ColumnLike) -> Column:
    """The digits of the first run, or of the whole text if it has none; 19 at most."""
    c = as_col(text)
    run = F.regexp_extract(c, RUN, 0)
    return F.substring(_digits(F.when(run != "", run).otherwise(c)), 1, MAX_TYPED)


def brand(number: ColumnLike) -> Column:
    """Issuer label by leading digits; CARD if none fits, NULL for NULL. Neither length nor check digit matters.

    Prefixes that are ranges are numbers, for which a digit of any script counts; the others are ASCII text.
    """
    c = as_col(number)
    d = _digits(c)
    two, four = F.substring(d, 1, 2), F.substring(d, 1, 4)
    value = F.translate(four, WIDE, WORTH)
    head = F.substring(value, 1, 2)
    # The labels and the prefixes of each, first match first.
    label = (
        F.when(d.startswith("4"), "VISA")
        .when(head.between("51", "55") & (F.length(head) == 2), "MASTERCARD")
        .when((F.length(value) == 4) & value.between("2221", "2720"), "MASTERCARD")
        .when(two.isin("34", "37"), "AMEX")
        .when((four == "6011") | (two == "65"), "DISCOVER")
        .otherwise("CARD")
    )
    return F.when(c.isNotNull(), label)


def luhn_ok(number: ColumnLike) -> Column:
    """Whether there are 12 digits or more and the mod-10 check holds; NULL for NULL.

    A digit beyond ASCII counts by its distance from "0" in code points, as in the reference.
    """
    d = _digits(as_col(number))
    doubled = lambda n: n * 2 - F.when(n > 4, 9).otherwise(0)
    terms = F.transform(F.split(F.reverse(d), ""), lambda ch, i: F.when(i % 2 == 1, doubled(F.ascii(ch) - 48)).otherwise(F.ascii(ch) - 48))
    wide = F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0
    return (F.length(d) >= 12) & F.when(F.rlike(d, F.lit("^[0-9]*$")), F.call_function("luhn_check", d)).otherwise(wide)
