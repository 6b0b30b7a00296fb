"""The functions for use in SQL text. Each is a temporary SQL function that Catalyst inlines: no Python runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

from panveil.functions.digits import DIGIT, GLYPH, MAX_SHOWN, MAX_TYPED, OTHER, RUN, WIDE, WORTH

_FITS = f"glyph RLIKE r'{GLYPH}'"
_QUOTED = r"regexp_replace(glyph, r'([\\$])', r'\\$1')"
_TRAIL = f"greatest(least(trail, {MAX_SHOWN}), 0)"
_LEAD = f"greatest(least(lead, {MAX_SHOWN} - {_TRAIL}), 0)"
_MOST = f"greatest(least({MAX_SHOWN}, regexp_count(pan, r'{DIGIT}') - 1), 0)"
_T = f"greatest(least(trail, {_MOST}), 0)"
_L = f"greatest(least(lead, {_MOST} - {_T}), 0)"
_HEAD = f"regexp_extract(pan, concat(r'^(?:{OTHER}*{DIGIT}){{', {_L}, '}}'), 0)"
_PARTS = f"concat('^((?:[^0-9]*[0-9]){{', {_LEAD}, '}})(.*?)((?:[^0-9]*[0-9]){{', {_TRAIL}, '}})$')"
_D = f"regexp_replace(pan, r'{OTHER}', '')"
_FOUR = f"translate(substring({_D}, 1, 4), '{WIDE}', '{WORTH}')"

FUNCTIONS = {
    "pan_runs(txt STRING) RETURNS ARRAY<STRING>": f"regexp_extract_all(txt, r'({RUN})', 1)",
    "pan_count(txt STRING) RETURNS BIGINT": f"regexp_count(txt, r'{RUN}')",
    "pan_first_digits(txt STRING) RETURNS STRING": f"substring(regexp_replace(if(regexp_extract(txt, r'{RUN}', 0) != '', regexp_extract(txt, r'{RUN}', 0), txt), r'{OTHER}', ''), 1, {MAX_TYPED})",
    "pan_luhn(pan STRING) RETURNS BOOLEAN": (
        f"length({_D}) >= 12 AND CASE WHEN {_D} RLIKE '^[0-9]*$' THEN luhn_check({_D}) ELSE aggregate(transform(split(reverse({_D}), ''), "
        "(ch, i) -> CASE WHEN i % 2 = 0 THEN ascii(ch) - 48 WHEN ascii(ch) > 52 THEN 2 * ascii(ch) - 105 ELSE 2 * ascii(ch) - 96 END), 0, (a, x) -> a + x) % 10 = 0 END"
    ),
    "pan_brand(pan STRING) RETURNS STRING": (
        f"CASE WHEN pan IS NULL THEN NULL WHEN startswith({_D}, '4') THEN 'VISA' "
        f"WHEN try_cast(substring({_FOUR}, 1, 2) AS INT) BETWEEN 51 AND 55 THEN 'MASTERCARD' "
        f"WHEN length({_D}) >= 4 AND try_cast({_FOUR} AS INT) BETWEEN 2221 AND 2720 THEN 'MASTERCARD' "
        f"WHEN substring({_D}, 1, 2) IN ('34', '37') THEN 'AMEX' "
        f"WHEN startswith({_D}, '6011') OR startswith({_D}, '65') THEN 'DISCOVER' ELSE 'CARD' END"
    ),
    "pan_mask(pan STRING, glyph STRING, lead INT, trail INT) RETURNS STRING": (
        f"CASE WHEN NOT coalesce({_FITS}, false) THEN NULL WHEN regexp_count(pan, r'{DIGIT}') = 0 THEN pan ELSE concat({_HEAD}, "
        f"regexp_replace(substring(pan, length({_HEAD}) + 1), concat(r'{DIGIT}(?=(?:{OTHER}*{DIGIT}){{', {_T}, '}})'), {_QUOTED})) END"
    ),
    "pan_mask_runs(txt STRING, glyph STRING, lead INT, trail INT) RETURNS STRING": (
        f"CASE WHEN NOT coalesce({_FITS}, false) THEN NULL WHEN txt RLIKE r'{RUN}' THEN array_join(zip_with(split(txt, r'{RUN}', -1), regexp_extract_all(txt, r'({RUN})', 1), "
        f"(gap, run) -> concat(gap, coalesce(concat(regexp_extract(run, {_PARTS}, 1), "
        f"regexp_replace(regexp_extract(run, {_PARTS}, 2), '[0-9]', {_QUOTED}), regexp_extract(run, {_PARTS}, 3)), ''))), '') ELSE txt END"
    ),
    "pan_group4(pan STRING) RETURNS STRING": "regexp_replace(pan, r'(?s)(.{4})(?=.)', '$1 ')",
    "pan_hero(pan STRING) RETURNS STRING": "regexp_replace(regexp_replace(pan, '[- ]', ''), r'(?s)(.{4})(?=.)', '$1 ')",
}


def register(spark: SparkSession) -> None:
    """Makes pan_mask, pan_mask_runs, pan_runs, pan_count, pan_first_digits, pan_brand, pan_luhn, pan_group4 and pan_hero."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
