"""Queries over the driver's tables, and the same in DuckDB SQL, derived independently where its regexes allow no lookahead."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panveil.functions import (
    RUN,
    accept_typed,
    brand,
    can_commit,
    clamp_keep,
    count_runs,
    detected_caption,
    digit_glyphs,
    first_digits,
    glyph_offered,
    group4,
    hero,
    keep_columns,
    layout_x,
    luhn_badge,
    luhn_ok,
    mask_number,
    mask_runs,
    reveal_caption,
    route_shared,
    shared_text,
    slider,
    tail_mask,
    to_grouped_offset,
    to_plain_offset,
    update_kind,
    update_resume,
)
from panveil.functions.legacy import TOO_SHORT
from panveil.operators import run_inventory, screen_texts
from panveil.sources import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _pan() -> Column:
    k = F.col("o_orderkey")
    prefix = F.element_at(F.array(*(F.lit(x) for x in ("4", "51", "2221", "34", "6011", "65", "9"))), (k % 7).cast("int") + 1)
    return F.concat(prefix, F.lpad(k.cast("string"), (F.lit(8) + k % 7).cast("int"), F.lit("0")))


def _texts(table: str, key: str, text: str, **out: Callable[[Column], Column]) -> Query:
    return lambda spark, d: read_table(spark, d, table).select(key, *(f(F.col(text)).alias(n) for n, f in out.items()))


def _pans(**out: Callable[[Column], Column]) -> Query:
    return lambda spark, d: read_table(spark, d, "orders").select("o_orderkey", _pan().alias("pan")).select("o_orderkey", *(f(F.col("pan")).alias(n) for n, f in out.items()))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Documents with card numbers: how many, and the text with all but the last four digits masked."""
    return screen_texts(read_table(spark, d, "documents"), "text", ["doc_id"])


def _runs_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("lang", count_runs("text").alias("n")).groupBy("lang").agg(F.sum("n").alias("n_runs"))


def _offsets(spark: SparkSession, d: str) -> DataFrame:
    o = (F.col("o_orderkey") % 64 - 3).cast("int")
    return read_table(spark, d, "orders").select(
        "o_orderkey", to_grouped_offset(o).cast("long").alias("grouped"), to_plain_offset(o).cast("long").alias("plain")
    )


def _mode() -> Column:
    return F.element_at(F.array(F.lit("LAST"), F.lit("FIRST"), F.lit("FIRST6_LAST4")), (F.col("o_orderkey") % 3).cast("int") + 1)


def _settings(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("o_orderkey") % 14 - 2).cast("int")
    base = read_table(spark, d, "orders").select("o_orderkey", _mode().alias("mode"), n.alias("n"))
    keep = keep_columns(F.col("mode"), slider(F.col("n")))
    lead, trail = clamp_keep((F.col("o_orderkey") % 20).cast("int"), F.col("keep.lead"), F.col("keep.trail"))
    return base.withColumn("keep", keep).select(
        "o_orderkey", F.col("keep.lead").cast("long").alias("lead"), F.col("keep.trail").cast("long").alias("trail"),
        lead.cast("long").alias("clamped_lead"), trail.cast("long").alias("clamped_trail"),
        reveal_caption(F.col("mode"), slider(F.col("n"))).alias("caption"),
    )


def _per_row(spark: SparkSession, d: str) -> DataFrame:
    """Settings that differ from row to row."""
    n = (F.col("o_orderkey") % 11).cast("int")
    rows = read_table(spark, d, "orders").select("o_orderkey", _pan().alias("pan"), keep_columns(_mode(), n).alias("keep"))
    return rows.select("o_orderkey", mask_number("pan", "#", F.col("keep.lead"), F.col("keep.trail")).alias("masked"))


def _shares(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    action = F.when(k == 3, "android.intent.action.PROCESS_TEXT").when(k == 2, "android.intent.action.VIEW").otherwise("android.intent.action.SEND")
    mime = F.when(k == 1, "image/png").otherwise("text/plain")
    rows = read_table(spark, d, "documents").select("doc_id", shared_text(action, mime, F.col("text")).alias("shared"))
    routed = rows.select("doc_id", "shared", route_shared("shared").alias("r")).select("doc_id", "shared", "r.*")
    return routed.select(
        "doc_id", "mode", "single_digits", "batch_text", can_commit(F.col("mode"), F.col("single_digits"), F.col("batch_text")).alias("can_commit"),
        detected_caption(F.coalesce(count_runs("shared"), F.lit(0))).alias("caption"),
    )


def _glyphs(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "orders").select("o_orderkey", mask_number(_pan(), "*", 6, 4).alias("m"))
    return rows.select("o_orderkey", F.explode(layout_x("m", 90.0, 2.0)).alias("g")).select(
        "o_orderkey", F.col("g.pos").cast("long").alias("pos"), "g.ch", "g.kept", F.round("g.x", 3).alias("x")
    )


def _kept(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "orders").select("o_orderkey", digit_glyphs(mask_number(_pan(), "•", 0, 4)).alias("g"))
    return rows.select("o_orderkey", F.size(F.filter("g", lambda x: x["kept"])).cast("long").alias("n_kept"), F.size("g").cast("long").alias("n_glyphs"))


def _glyph_column() -> Column:
    """Glyphs that are offered, some that fit though they are not, and some that do not fit."""
    return F.element_at(F.array(*(F.lit(g) for g in _GLYPHS)), (F.col("o_orderkey") % len(_GLYPHS)).cast("int") + 1)


def _glyphs_by_row(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "orders").select("o_orderkey", _pan().alias("pan"), _glyph_column().alias("glyph"))
    return rows.select("o_orderkey", mask_number("pan", F.col("glyph"), 6, 4).alias("masked"), mask_runs("pan", F.col("glyph"), 0, 4).alias("runs"), glyph_offered("glyph").alias("offered"))


def _wide() -> Column:
    return F.translate(_pan(), "0123456789", _WIDE_DIGITS)


def _wide_digits(spark: SparkSession, d: str) -> DataFrame:
    """Numbers in Arabic-Indic digits: masked, and which characters of the result are kept."""
    rows = read_table(spark, d, "orders").select("o_orderkey", mask_number(_wide(), "*", 6, 4).alias("masked"), count_runs(_wide()).alias("n_cards"))
    kept = F.array_join(F.transform(F.filter(digit_glyphs("masked"), lambda g: g["kept"]), lambda g: g["pos"].cast("string")), ",")
    return rows.select("o_orderkey", "masked", "n_cards", kept.alias("kept"))


def _tail_large(spark: SparkSession, d: str) -> DataFrame:
    """Accounts of thousands of characters. They are made of keys, which are dealt to all cores before they grow: a small table is read by one or two."""
    keys = read_table(spark, d, "orders").select("o_orderkey").repartition(spark.sparkContext.defaultParallelism, "o_orderkey")
    return keys.select("o_orderkey", tail_mask(F.repeat(_pan(), F.lit(400)), 5000).alias("masked"))


def _updates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    days = F.when(k % 5 != 0, (k % 100).cast("int"))
    kind = update_kind(k % 9 != 0, (k % 7).cast("int"), days, k % 2 == 0, k % 3 != 0)
    status = F.when(k % 4 == 0, "DOWNLOADED").when(k % 4 == 1, "IN_PROGRESS")
    return read_table(spark, d, "orders").select("o_orderkey", kind.alias("kind"), update_resume(kind, status).alias("resume"))


_GLYPHS = ("*", "•", "#", "x", "$", "!", "@", "%", "^", "&", "\\", "y", "ab", "", "7", "٣", "\U0001f600")
_WIDE_DIGITS = "٠١٢٣٤٥٦٧٨٩"

QUERIES: dict[str, Query] = {
    "flagship_screen_documents": flagship,
    "mask_runs_last4": _texts("documents", "doc_id", "text", masked=lambda c: mask_runs(c, "*", 0, 4)),
    "mask_runs_first6last4": _texts("documents", "doc_id", "text", masked=lambda c: mask_runs(c, "*", 6, 4)),
    "mask_runs_dollar_glyph": _texts("documents", "doc_id", "text", masked=lambda c: mask_runs(c, "$", 0, 10)),
    "mask_runs_pages": _texts("pages", "page_id", "html", masked=lambda c: mask_runs(c, "#", 10, 3)),
    "count_runs": _texts("documents", "doc_id", "text", n_cards=count_runs),
    "count_runs_pages": _texts("pages", "page_id", "html", n_cards=count_runs),
    "first_digits": _texts("documents", "doc_id", "text", digits=first_digits),
    "run_inventory": lambda s, d: run_inventory(read_table(s, d, "documents"), "text", ["doc_id"]),
    "mask_number_last4": _pans(masked=lambda c: mask_number(c, "*", 0, 4)),
    "mask_number_first6last4": _pans(masked=lambda c: mask_number(c, "*", 6, 4)),
    "mask_number_overlarge": _pans(masked=lambda c: mask_number(c, "$", 16, 2**31 - 1)),
    "mask_number_negative": _pans(masked=lambda c: mask_number(c, "•", -3, -1)),
    "mask_number_per_row": _per_row,
    "mask_number_glyph_column": _glyphs_by_row,
    "mask_number_defaults": _pans(masked=mask_number, runs=mask_runs),
    "wide_digits": _wide_digits,
    "keep_settings": _settings,
    "brand": _pans(brand=brand),
    "luhn": _pans(luhn=luhn_ok, badge=luhn_badge),
    "group4": _pans(grouped=group4),
    "hero": _pans(hero=lambda c: hero(F.concat(F.substring(c, 1, 4), F.lit("-"), F.substring(c, 5, 3), F.lit(" "), F.substring(c, 8, 99)))),
    "display_offsets": _offsets,
    "glyph_layout": _glyphs,
    "glyph_classes": _kept,
    "accept_typed": _pans(accepted=lambda c: accept_typed(F.concat(c, F.lit(" /"), F.substring(c, 1, 6)))),
    "route_shared_text": lambda s, d: _texts("documents", "doc_id", "text", r=route_shared)(s, d).select("doc_id", "r.*"),
    "share_intents": _shares,
    "legacy_tail": _pans(masked=lambda c: tail_mask(c, 4)),
    "legacy_tail_large": _tail_large,
    "legacy_tail_short": _pans(masked=lambda c: tail_mask(F.concat(F.substring(c, 1, 6), F.lit("-"), F.substring(c, 7, 99)), 12, "#")),
    "update_policy": _updates,
    "runs_by_lang": _runs_by_lang,
}

# --- the same in DuckDB ---

PAN = "((['4','51','2221','34','6011','65','9'])[(o_orderkey % 7 + 1)::int] || lpad(o_orderkey::varchar, (8 + o_orderkey % 7)::int, '0'))"
_ALL = f"regexp_extract_all(s, '{RUN}')"


def _sql_runs(glyph: str, lead: int, trail: int) -> str:
    p = f"^((?:[^0-9]*[0-9]){{{lead}}})(.*?)((?:[^0-9]*[0-9]){{{trail}}})$"
    part = lambda k: f"regexp_extract(z[2], '{p}', {k})"
    mask = f"{part(1)} || translate({part(2)}, '0123456789', '{glyph * 10}') || {part(3)}"
    return f"array_to_string(list_transform(list_zip(string_split_regex(s, '{RUN}'), {_ALL}), lambda z: z[1] || coalesce({mask}, '')), '')"


def _sql_pan(glyph: str, lead: str, trail: str) -> str:
    n = "length(regexp_replace(s, '[^0-9]', '', 'g'))"
    most = f"greatest(least(10, {n} - 1), 0)"
    t = f"greatest(least({trail}, {most}), 0)"
    first = f"greatest(least({lead}, {most} - {t}), 0)"
    before, after = "length(regexp_replace(s[1:i], '[^0-9]', '', 'g'))", "length(regexp_replace(s[i:], '[^0-9]', '', 'g'))"
    return f"array_to_string(list_transform(string_split(s, ''), lambda x, i: CASE WHEN NOT regexp_matches(x, '[0-9]') OR {before} <= {first} OR {after} <= {t} THEN x ELSE '{glyph}' END), '')"


_N = f"len({_ALL})::bigint"
_FIRST = f"left(regexp_replace(CASE WHEN regexp_matches(s, '{RUN}') THEN regexp_extract(s, '{RUN}') ELSE s END, '[^0-9]', '', 'g'), 19)"
_DG = "regexp_replace(s, '[^0-9]', '', 'g')"
_BRAND = (
    f"CASE WHEN s IS NULL THEN NULL WHEN {_DG} LIKE '4%' THEN 'VISA' WHEN try_cast({_DG}[1:2] AS int) BETWEEN 51 AND 55 THEN 'MASTERCARD' "
    f"WHEN length({_DG}) >= 4 AND try_cast({_DG}[1:4] AS int) BETWEEN 2221 AND 2720 THEN 'MASTERCARD' "
    f"WHEN {_DG} LIKE '34%' OR {_DG} LIKE '37%' THEN 'AMEX' WHEN {_DG} LIKE '6011%' OR {_DG} LIKE '65%' THEN 'DISCOVER' ELSE 'CARD' END"
)
_X = "try_cast(x AS int)"
_LUHN = (
    f"(length({_DG}) >= 12 AND coalesce(list_sum(list_transform(string_split(reverse({_DG}), ''), lambda x, i: "
    f"CASE WHEN i % 2 = 1 THEN {_X} WHEN {_X} > 4 THEN {_X} * 2 - 9 ELSE {_X} * 2 END)), 1) % 10 = 0)"
)
_GROUP = "array_to_string(list_transform(range(0, (length(s) + 3) // 4), lambda k: substr(s, (k * 4 + 1)::int, 4)), ' ')"
_MODE = "(['LAST','FIRST','FIRST6_LAST4'])[(o_orderkey % 3 + 1)::int]"


def _doc(select: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return f"SELECT {key}, {select} FROM (SELECT {key}, {text} AS s FROM {table})"


def _order(select: str, s: str = PAN) -> str:
    return f"SELECT o_orderkey, {select} FROM (SELECT *, {s} AS s FROM orders)"


def _tail(n: int, glyph: str) -> str:
    msg = TOO_SHORT.replace("\n", "' || chr(10) || '")
    return (
        f"CASE WHEN length(replace(s, '-', '')) < {n} THEN s || '{msg}' ELSE coalesce(array_to_string(list_transform(string_split(s, ''), "
        f"lambda x, i: CASE WHEN x = '-' OR length(replace(s[i:], '-', '')) <= {n} THEN x ELSE '{glyph}' END), ''), s) END AS masked"
    )


_ROUTE = (
    f"CASE WHEN coalesce({_N}, 0) > 1 THEN 'batch' ELSE 'single' END AS mode, coalesce({_FIRST}, '') AS single_digits, "
    f"CASE WHEN coalesce({_N}, 0) > 1 THEN s ELSE '' END AS batch_text"
)
_SLIDER = "least(greatest(o_orderkey % 14 - 2, 0), 10)"
_LEAD = f"CASE {_MODE} WHEN 'LAST' THEN 0 WHEN 'FIRST' THEN {_SLIDER} ELSE 6 END"
_TRAIL = f"CASE {_MODE} WHEN 'LAST' THEN {_SLIDER} WHEN 'FIRST' THEN 0 ELSE 4 END"
_MASKED64 = _sql_pan("*", "6", "4")
_KIND = (
    "CASE WHEN k % 9 = 0 THEN NULL WHEN p = 5 AND im THEN 'IMMEDIATE' WHEN p = 4 AND dd >= 5 AND im THEN 'IMMEDIATE' WHEN p = 4 AND dd >= 3 AND fl THEN 'FLEXIBLE' "
    "WHEN p = 3 AND dd >= 30 AND im THEN 'IMMEDIATE' WHEN p = 3 AND dd >= 15 AND fl THEN 'FLEXIBLE' WHEN p = 2 AND dd >= 90 AND im THEN 'IMMEDIATE' "
    "WHEN p = 2 AND dd >= 30 AND fl THEN 'FLEXIBLE' WHEN p = 1 THEN 'FLEXIBLE' END"
)

ORACLE: dict[str, str] = {
    "flagship_screen_documents": _doc(f"{_N} AS n_cards, {_sql_runs('*', 0, 4)} AS masked_text") + f" WHERE regexp_matches(s, '{RUN}')",
    "mask_runs_last4": _doc(f"{_sql_runs('*', 0, 4)} AS masked"),
    "mask_runs_first6last4": _doc(f"{_sql_runs('*', 6, 4)} AS masked"),
    "mask_runs_dollar_glyph": _doc(f"{_sql_runs('$', 0, 10)} AS masked"),
    "mask_runs_pages": _doc(f"{_sql_runs('#', 7, 3)} AS masked", "pages", "page_id", "html"),
    "count_runs": _doc(f"{_N} AS n_cards"),
    "count_runs_pages": _doc(f"{_N} AS n_cards", "pages", "page_id", "html"),
    "first_digits": _doc(f"{_FIRST} AS digits"),
    "run_inventory": f"SELECT doc_id, run_no, run, {_BRAND} AS brand, {_LUHN} AS luhn FROM (SELECT doc_id, unnest(range(len({_ALL})))::bigint AS run_no, unnest({_ALL}) AS run, run AS s FROM (SELECT doc_id, text AS s FROM documents))",
    "mask_number_last4": _order(f"{_sql_pan('*', '0', '4')} AS masked"),
    "mask_number_first6last4": _order(f"{_MASKED64} AS masked"),
    "mask_number_overlarge": _order(f"{_sql_pan('$', '16', '2147483647')} AS masked"),
    "mask_number_negative": _order(f"{_sql_pan('•', '-3', '-1')} AS masked"),
    "mask_number_per_row": _order(
        _sql_pan("#", f"(CASE {_MODE} WHEN 'LAST' THEN 0 WHEN 'FIRST' THEN o_orderkey % 11 ELSE 6 END)", f"(CASE {_MODE} WHEN 'LAST' THEN o_orderkey % 11 WHEN 'FIRST' THEN 0 ELSE 4 END)") + " AS masked"
    ),
    "mask_number_glyph_column": (
        f"SELECT o_orderkey, CASE WHEN fits THEN replace({_sql_pan('~', '6', '4')}, '~', g) END AS masked, CASE WHEN fits THEN replace({_sql_runs('~', 0, 4)}, '~', g) END AS runs, k < 10 AS offered "
        f"FROM (SELECT *, k < 12 AS fits, ({[g for g in _GLYPHS]!r})[k + 1] AS g, {PAN} AS s FROM (SELECT *, (o_orderkey % {len(_GLYPHS)})::int AS k FROM orders))"
    ).replace("'\\\\'", "'\\'"),
    "mask_number_defaults": _order(f"{_sql_pan('*', '0', '4')} AS masked, {_sql_runs('*', 0, 4)} AS runs"),
    "wide_digits": (
        f"SELECT o_orderkey, translate(m, '0123456789', '{_WIDE_DIGITS}') AS masked, 0::bigint AS n_cards, "
        "array_to_string(list_filter(range(length(m)), lambda i: m[i + 1] <> '*'), ',') AS kept "
        f"FROM (SELECT o_orderkey, {_MASKED64} AS m FROM (SELECT *, {PAN} AS s FROM orders))"
    ),
    "keep_settings": (
        "SELECT o_orderkey, lead, trail, greatest(least(lead, most - greatest(least(trail, most), 0)), 0) AS clamped_lead, greatest(least(trail, most), 0) AS clamped_trail, caption "
        f"FROM (SELECT o_orderkey, ({_LEAD})::bigint AS lead, ({_TRAIL})::bigint AS trail, greatest(least(10, o_orderkey % 20 - 1), 0) AS most, "
        f"CASE WHEN {_MODE} = 'FIRST6_LAST4' THEN 'Showing first 6 + last 4' WHEN {_SLIDER} = 0 THEN 'Masking every digit' "
        f"ELSE 'Keeping ' || lower({_MODE}) || ' ' || {_SLIDER} END AS caption FROM orders)"
    ),
    "brand": _order(f"{_BRAND} AS brand"),
    "luhn": _order(f"{_LUHN} AS luhn, length(s) > 0 AND {_LUHN} AS badge"),
    "group4": _order(f"{_GROUP} AS grouped"),
    "hero": _order(f"{_GROUP} AS hero"),
    "display_offsets": "SELECT o_orderkey, CASE WHEN o <= 0 THEN 0 ELSE o + (o - 1) // 4 END AS grouped, CASE WHEN o <= 0 THEN 0 ELSE o - o // 5 END AS plain FROM (SELECT o_orderkey, o_orderkey % 64 - 3 AS o FROM orders)",
    "glyph_layout": (
        "SELECT o_orderkey, pos, ch, regexp_matches(ch, '[0-9]') AS kept, round(90 + 2 * (pos + 0.6 * (pos // 4)), 3)::double AS x FROM (SELECT o_orderkey, unnest(range(length(m))) AS pos, unnest(string_split(m, '')) AS ch "
        f"FROM (SELECT o_orderkey, {_MASKED64} AS m FROM (SELECT *, {PAN} AS s FROM orders)))"
    ),
    "glyph_classes": _order("least(4, length(s) - 1)::bigint AS n_kept, length(s)::bigint AS n_glyphs"),
    "accept_typed": _order("CASE WHEN length(s) + 6 <= 19 THEN s || left(s, 6) END AS accepted"),
    "route_shared_text": _doc(_ROUTE),
    "share_intents": (
        "SELECT doc_id, mode, single_digits, batch_text, CASE WHEN mode = 'batch' THEN true ELSE single_digits <> '' END AS can_commit, coalesce(n, 0) || ' card number(s) detected' AS caption "
        f"FROM (SELECT doc_id, {_ROUTE}, {_N} AS n FROM (SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 3) THEN text END AS s FROM documents))"
    ),
    "legacy_tail": _order(_tail(4, "*")),
    "legacy_tail_large": _order(f"CASE WHEN length(s) < 5000 THEN s || '{TOO_SHORT.replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))}' ELSE repeat('*', length(s) - 5000) || right(s, 5000) END AS masked", f"repeat({PAN}, 400)"),
    "legacy_tail_short": _order(_tail(12, "#"), f"({PAN}[1:6] || '-' || {PAN}[7:])"),
    "update_policy": (
        "SELECT o_orderkey, kind, CASE WHEN coalesce(kind, 'FLEXIBLE') = 'FLEXIBLE' AND k % 4 = 0 THEN 'notify' WHEN kind = 'IMMEDIATE' AND k % 4 = 1 THEN 'restart' END AS resume "
        f"FROM (SELECT *, {_KIND} AS kind FROM (SELECT o_orderkey, o_orderkey AS k, o_orderkey % 7 AS p, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 100 END AS dd, o_orderkey % 2 = 0 AS im, o_orderkey % 3 <> 0 AS fl FROM orders))"
    ),
    "runs_by_lang": f"SELECT lang, sum(n)::bigint AS n_runs FROM (SELECT lang, {_N} AS n FROM (SELECT lang, text AS s FROM documents)) GROUP BY lang",
}
