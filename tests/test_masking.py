"""Known vectors, exhaustive grids and an independent model for the column functions."""

import random

import pytest
from pyspark.sql import functions as F

from panveil import MaskMode, brand, count_runs, first_digits, group4, hero, keep_counts, luhn_ok, mask_number, mask_runs, tail_mask
from panveil.functions import GLYPHS, accept_typed, clamp_keep, digit_glyphs, keep_columns, route_shared, slider

# Known vectors, which any implementation has to meet.
NUMBERS = [
    ("4111111111111111", "*", 0, 10, "******1111111111"),
    ("4111111111111111", "*", 0, 16, "******1111111111"),
    ("4111111111111111", "*", 16, 0, "4111111111******"),
    ("4111111111111111", "*", 0, 2147483647, "******1111111111"),
    ("4111111111111111", "*", -3, -1, "****************"),
    ("7", "*", 4, 4, "*"),
    ("1234", "*", 0, 9, "*234"),
    ("12", "*", 2, 0, "1*"),
    ("4111111111111111", "*", 0, 4, "************1111"),
    ("4111111111111111", "*", 6, 4, "411111******1111"),
    ("378282246310005", "*", 6, 4, "378282*****0005"),
    ("123456787890", "*", 6, 4, "123456**7890"),
    ("4111 1111 1111 1111", "*", 6, 4, "4111 11** **** 1111"),
    ("4111-1111-1111-1111", "*", 6, 4, "4111-11**-****-1111"),
    ("no card here", "*", 4, 4, "no card here"),
    ("4111111111111111", "•", 0, 16, "••••••1111111111"),
    ("************1111", "*", 0, 4, "*" * 13 + "111"),
    ("٤١١١١١١١١١١١١١١١", "*", 0, 4, "************١١١١"),
    ("\U0001d7d8\U0001d7d9 12", "*", 0, 1, "\U0001d7d8\U0001d7d9 *2"),
    ("", "*", 0, 4, ""),
    (None, "*", 0, 4, None),
]
TEXTS = [
    ("pay 4111111111111111 or 378282246310005 today", "*", 0, 10, "pay ******1111111111 or *****2246310005 today"),
    ("ref 42 card 4111111111111111", "*", 0, 4, "ref 42 card ************1111"),
    ("4111111111111111 378282246310005", "*", 0, 4, "***************1 378********0005"),
    ("1" * 22, "*", 0, 10, "*" * 9 + "1" * 13),
    ("1" * 30, "*", 0, 10, "*" * 9 + "1" * 21),
    ("4111111111111111", "$", 0, 4, "$" * 12 + "1111"),
    ("4111111111111111", "\\", 0, 4, "\\" * 12 + "1111"),
    ("4111  1111 1111 1111", "*", 0, 4, "4111  **** **** 1111"),
    ("", "*", 0, 4, ""),
    (None, "*", 0, 4, None),
]


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("text", "glyph", "lead", "trail", "expected"), NUMBERS)
def test_number(spark, text, glyph, lead, trail, expected):
    assert one(spark, text, lambda c: mask_number(c, glyph, lead, trail)) == expected


@pytest.mark.parametrize(("text", "glyph", "lead", "trail", "expected"), TEXTS)
def test_text(spark, text, glyph, lead, trail, expected):
    assert one(spark, text, lambda c: mask_runs(c, glyph, lead, trail)) == expected
    assert one(spark, text, lambda c: mask_runs(c, F.lit(glyph), F.lit(lead), F.lit(trail))) == expected


def test_clamp(spark):
    rows = [(16, 8, 4, 6, 4), (16, 9, 6, 4, 6), (16, 6, 16, 0, 10), (16, -3, -1, 0, 0)]
    df = spark.createDataFrame(rows, "n int, l int, t int, el int, et int")
    lead, trail = clamp_keep(F.col("n"), F.col("l"), F.col("t"))
    assert df.where((lead != F.col("el")) | (trail != F.col("et"))).count() == 0


def test_keep_counts_match_their_columns(spark):
    df = spark.createDataFrame([(m.value, n) for m in MaskMode for n in range(11)], "m string, n int")
    for r in df.select("m", "n", keep_columns(F.col("m"), F.col("n")).alias("k")).collect():
        assert (r.k.lead, r.k.trail) == keep_counts(r.m, r.n)
    assert [one(spark, "", lambda _, n=n: slider(n)) for n in (-1, 0, 3.5, 10, 99)] == [0, 0, 4, 10, 10]


def test_grids(spark):
    rows = [("4" * length, *keep_counts(m, n)) for length in range(1, 20) for n in range(11) for m in MaskMode]
    assert len(rows) == 627
    df = spark.createDataFrame(rows, "s string, l int, t int").withColumn("y", mask_number("s", "*", F.col("l"), F.col("t")))
    assert df.where(~F.col("y").contains("*") | (F.col("y") == F.col("s"))).count() == 0
    assert df.where((F.length("s") == 16) & (F.length(F.regexp_replace("y", "[^*]", "")) < 6)).count() == 0


def test_inspection(spark):
    assert [one(spark, x, count_runs) for x in ("1234", "4111 1111 1111 1111", "4111111111111111 and 378282246310005", None)] == [0, 1, 2, None]
    assert [one(spark, x, first_digits) for x in ("card: 4111-1111-1111-1111!", "1234567890123456789012", "ref 42", None)] == ["4111111111111111", "1234567890123456789", "42", None]
    brands = {"": "CARD", "4": "VISA", "5": "CARD", "55": "MASTERCARD", "56": "CARD", "34": "AMEX", "37x": "AMEX", "65": "DISCOVER", "6011": "DISCOVER", "2220": "CARD", "27209": "MASTERCARD", "2721": "CARD", "222": "CARD", "٥١": "MASTERCARD", "5٥": "MASTERCARD", "٢٢٢١": "MASTERCARD", "٤": "CARD", "٣٤": "CARD", "٦٥": "CARD", None: None}
    assert {x: one(spark, x, brand) for x in brands} == brands
    luhn = {"000000000000": True, "00000000000": False, "4111-1111-1111-1111": True, "4111-1111-1111-1112": False, "": False, "٤١١١١١١١١١١١١١١١": False, None: None}
    assert {x: one(spark, x, luhn_ok) for x in luhn} == luhn


def test_display_and_ingest(spark):
    assert [one(spark, x, group4) for x in ("12345678", "123456789", "", "1234 678")] == ["1234 5678", "1234 5678 9", "", "1234  678"]
    assert one(spark, "1234-56 789", hero) == "1234 5678 9"
    assert [tuple(g) for g in one(spark, "*1", digit_glyphs)] == [(0, "*", False), (1, "1", True)]
    assert one(spark, "", digit_glyphs) == []
    assert [g.kept for g in one(spark, "*١- 2\U0001d7d8a", digit_glyphs)] == [False, True, False, False, True, False, False]
    assert [one(spark, x, accept_typed) for x in ("1a2", "1" * 19, "1" * 20)] == ["12", "1" * 19, None]
    assert tuple(one(spark, None, route_shared)) == ("single", "", "")
    both = "4111111111111111, 378282246310005"
    assert tuple(one(spark, both, route_shared)) == ("batch", "4111111111111111", both)


def test_legacy(spark):
    assert one(spark, "4111-1111-1111-1111", lambda c: tail_mask(c, 4)) == "****-****-****-1111"
    assert one(spark, "12-3", lambda c: tail_mask(c, 4)) == "12-3 \n\nUnable to Masked due to limit of Card Number"
    assert one(spark, None, lambda c: tail_mask(c, 4)) is None
    with pytest.raises(ValueError):
        tail_mask("x", -1)
    long = "-12\n345" * 2000
    for keep in (0, 1, 64, 65, 2000, 6000, 11999, 12000, 2**31 - 1):
        assert one(spark, long, lambda c, keep=keep: tail_mask(c, keep)) == tail_model(long, "*", "-", keep)
    for text, ignored, keep in (("a$b$$c", "$", 2), ("-a-b-", "-", 5), ("", "-", 0), ("--", "-", 0), ("a-b", "x", 2), ("xaxbx", "x", 5), ("a\n-b" * 99, "-", 65), ("é\U0001f600^^]x", "^", 1)):
        assert one(spark, text, lambda c, i=ignored, k=keep: tail_mask(c, k, "\\", i)) == tail_model(text, "\\", ignored, keep)


def test_legacy_of_long_accounts_makes_no_arrays_of_characters(spark):
    from panveil.plans.queries import QUERIES

    long = ["1" * 6000, "1-2\n" * 1500, "-" * 3000 + "é\U0001f600" * 3000, "-" * 6000, "12" * 2499 + "-", "x" * 2_000_000 + "-" * 9, "-1" * 1_000_000]
    df = spark.createDataFrame(list(enumerate(long)), "n int, t string").select("n", tail_mask("t", 5000).alias("m"), tail_mask("t", 5000, "$", "x").alias("other"))
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    for r in df.collect():
        assert r.m == tail_model(long[r.n], "*", "-", 5000) and r.other == tail_model(long[r.n], "$", "x", 5000)
    orders = spark.range(8000).select(F.col("id").alias("o_orderkey")).coalesce(1)
    folder = spark.conf.get("spark.sql.warehouse.dir") + "/tails"
    orders.write.mode("overwrite").parquet(f"{folder}/orders.parquet")
    rows = QUERIES["legacy_tail_large"](spark, folder)
    assert min(n for _, n in rows.groupBy(F.spark_partition_id()).count().collect()) > 500 and rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def tail_model(text: str, glyph: str, ignored: str, keep: int) -> str:
    if len(text) - text.count("-") < keep:
        return text + " \n\nUnable to Masked due to limit of Card Number"
    places = [i for i, c in enumerate(text) if c != ignored]
    gone = set(places[: max(len(places) - keep, 0)])
    return "".join(glyph if i in gone else c for i, c in enumerate(text))


def test_glyph_columns_are_checked(spark):
    from panveil.functions import glyph_offered

    rows = [("*", True), ("$", True), ("\\", True), ("\n", True), ("ab", False), ("", False), ("7", False), ("٣", False), ("\U0001f600", False), (None, False)]
    df = spark.createDataFrame(rows, "g string, fits boolean")
    for r in df.select("*", mask_number(F.lit("1-2 345"), F.col("g"), 1, 1).alias("n"), mask_runs(F.lit("a 411111111111 b"), F.col("g")).alias("r"), glyph_offered("g").alias("o"), mask_number(F.lit("12"), F.col("g"), allow_digit=True).alias("d")).collect():
        assert r.n == (f"1-{r.g} {r.g}{r.g}5" if r.fits else None) and r.r == (f"a {r.g * 8}1111 b" if r.fits else None)
        assert r.o == (None if r.g is None else r.g in GLYPHS) and r.d == (f"{r.g}2" if r.fits or r.g in ("7", "٣") else None)


def test_offsets_take_names_and_ints(spark):
    from panveil.functions import to_grouped_offset, to_plain_offset

    df = spark.createDataFrame([(6,)], "o int").select(to_grouped_offset("o"), to_grouped_offset(6), to_plain_offset("o"), to_plain_offset(F.col("o")))
    assert tuple(df.first()) == (7, 7, 5, 5)


def test_glyph_is_checked():
    for bad in ("", "ab", "\U0001f600", "7"):
        with pytest.raises(ValueError):
            mask_runs("x", bad)


def model(text: str, glyph: str, lead: int, trail: int) -> str:
    """Scans by hand, without a regular expression."""
    out, i = [], 0
    while i < len(text):
        j, ends = i, []
        while j < len(text) and text[j] in "0123456789" and len(ends) < 19:
            ends.append(j)
            j += 1
            if j + 1 < len(text) and text[j] in " -" and text[j + 1] in "0123456789":
                j += 1
        if len(ends) < 12:
            out.append(text[i])
            i += 1
            continue
        t = max(min(trail, 10), 0)
        first = max(min(lead, 10 - t), 0)
        shown = {*ends[:first], *(ends[-t:] if t else [])}
        out += [glyph if k in ends and k not in shown else text[k] for k in range(i, ends[-1] + 1)]
        i = ends[-1] + 1
    return "".join(out)


def test_random_texts_against_the_model(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choices("0123456789" * 4 + " -" * 5 + "ab\n€", k=rng.randrange(90))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for glyph, lead, trail in ((GLYPHS[0], 0, 4), ("$", 6, 4), ("•", 99, 3), ("#", -1, 0)):
        got = [r.y for r in df.select(mask_runs("x", glyph, lead, trail).alias("y")).collect()]
        assert got == [model(t, glyph, lead, trail) for t in texts]
