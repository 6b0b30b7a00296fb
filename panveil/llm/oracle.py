"""The queries in DuckDB SQL, where it can express them. Packing, mixing and the join are tested by brute force."""

from __future__ import annotations


# Everything here is stated apart from the operators, so that a wrong constant of theirs shows.
SPACE = r"\x20\x09-\x0D"

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


DEDUP = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_FOLDED} AS t FROM documents) WINDOW w AS (PARTITION BY t)
"""

_LINE = f"regexp_replace(regexp_replace(lower(l), '^[{SPACE}]+|[{SPACE}]+$', '', 'g'), '[{SPACE}]+', ' ', 'g')"
QUALITY = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, row_number() OVER () AS r,
    list_filter(string_split_regex(coalesce(text, ''), '[{SPACE}]+'), lambda w: w <> '') AS ws,
    list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l, i: {{'l': l, 'i': i - 1}}), lambda x: regexp_matches(x.l, '[^{SPACE}]')) AS ls FROM documents),
w3 AS (SELECT r, i, ws[i:i + 2] AS g FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM w3) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
base AS (SELECT d.*, coalesce(covered.n, 0)::bigint AS n_repeat_words, len(ws)::bigint AS n_words,
    len(ws) < 50 OR coalesce(covered.n, 0) * 100 > len(ws) * 50 AS bad FROM d LEFT JOIN covered USING (r)),
lines AS (SELECT r, doc_id, host, t, bad, place, length(l) AS size, {_LINE} AS line FROM (SELECT r, doc_id, host, t, bad, x.l AS l, x.i AS place FROM (SELECT r, doc_id, host, t, bad, unnest(ls) AS x FROM base))),
frequent AS (SELECT host, line, arg_min(t, (bad, doc_id)) AS stays FROM lines GROUP BY host, line HAVING count(DISTINCT t) > 50),
gone AS (SELECT r, sum(size) AS gone, string_agg(place, ',' ORDER BY place) AS places FROM lines JOIN frequent USING (host, line) WHERE t <> stays GROUP BY r),
counted AS (
  SELECT r, doc_id, bad, n_words, n_repeat_words, length(regexp_replace(t, '[{SPACE}]', '', 'g'))::bigint AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols, (len(ls) - len(list_distinct(list_transform(ls, lambda x: x.l))))::bigint AS n_dup_lines,
    coalesce(list_sum(list_transform(ls, lambda x: length(x.l))), 0)::bigint AS n_line_chars, coalesce(gone, 0)::bigint AS gone, coalesce(places, '') AS gone_lines
  FROM base LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bad AS base_failed,
  NOT bad AND NOT (n_line_chars - gone) * 100 < n_line_chars * 20 AS kept, (n_line_chars - gone)::bigint AS n_left_chars, gone_lines
FROM counted
"""

_ESCAPED = "regexp_replace({}, '<(\\\\*)\\|', '<\\\\\\1|', 'g')"
_ROLE = _ESCAPED.format("replace(replace(role, '\\', '\\\\'), chr(10), '\\n')")
CHAT = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(text))) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, md5(text))) AS loss_sha256,
  sum(length('<|im_start|>' || {_ROLE} || chr(10) || {_ESCAPED.format("text")} || '<|im_end|>' || chr(10)))::bigint AS formatted_chars
FROM c GROUP BY conv_id
"""

# CRC-32 byte by byte, with a table from its rule.
_CRC_TABLE = "(SELECT list(c ORDER BY b) AS crc FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b)))"
_BYTES = "list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::bigint)"
SHARDING = f"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS s, coalesce(text, '') AS t FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5('0:' || doc_id), doc_id) - 1 AS rank, count(*) OVER (PARTITION BY s) AS of FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY (rank + 0.5::double) / of, s, rank) - 1 AS position, count(*) OVER () AS n FROM r),
k AS (SELECT *, position * 8 // n AS shard FROM p)
SELECT doc_id, (octet_length(encode(t)) + 1)::bigint AS size,
  xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)::bigint AS text_crc32,
  'rows' AS law, shard::int AS shard, (position - (shard * n + 7) // 8)::bigint AS slot, NULL::int AS grown_shard
FROM k, {_CRC_TABLE}
"""

# Base32 of a SHA-1: each five hex digits are four letters.
_BASE32 = "array_to_string(list_transform(range(32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || h[1 + 5 * (k // 4):5 + 5 * (k // 4)])::bigint >> (15 - 5 * (k % 4))) & 31)]), '')"
WARC = f"""
SELECT page_id, octet_length(encode(t))::bigint AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM (SELECT page_id, t, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS last FROM (SELECT page_id, coalesce(html, '') AS t FROM pages))
"""


# Licence sentences as their publishers write them.
LICENSE_TEXTS = {
    "cc-nc.40": "Licensed under CC BY-NC 4.0",
    "cc-by.40": "Licensed under CC BY 4.0",
    "cc-sa.40": "Licensed under CC BY-SA 4.0",
    "cc-nc.long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by.long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-sa.long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc0": "This work is dedicated to the public domain under CC0 1.0",
    "gpl3.short": "This work is licensed under the GNU General Public License, version 3",
    "gpl2.short": "This work is licensed under the GNU General Public License, version 2",
    "gpl.free": "This program is free software",
    "gpl3.or": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2.or": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    "gpl.hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl.fitness": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "apache.short": "Licensed under the Apache License, Version 2.0",
    "apache.the": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache.may": "you may not use this file except in compliance with the License",
    "apache.obtain": "You may obtain a copy of the License at",
    "mit.short": "Released under the MIT License",
    "mit.licensed": "Licensed under the MIT License",
    "mit.grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit.notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd.grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd.endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl.form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED',
    "reserved": "All rights reserved",
}
# Licences by class, the strictest class first, and the sentences that make each, in the order in which they are tried.
LICENSE_CLASSES = {
    "reserved": ["All-Rights-Reserved"],
    "noncommercial": ["CC-BY-NC-4.0"],
    "copyleft": ["GPL-3.0-or-later", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-2.0-only", "MPL-2.0", "CC-BY-SA-4.0"],
    "permissive": ["BSD-3-Clause", "BSD-2-Clause", "MIT", "ISC", "Apache-2.0", "CC-BY-4.0", "CC0-1.0", "Unlicense"],
}
LICENSE_RULES = [
    ("BSD-3-Clause", "bsd.grant bsd.source bsd.binary bsd.endorse"),
    ("BSD-2-Clause", "bsd.grant bsd.source bsd.binary"),
    ("MIT", "mit.grant mit.notice as-is"),
    ("MIT", "mit.grant mit.notice"),
    ("MIT", "mit.short"),
    ("MIT", "mit.licensed"),
    ("ISC", "isc.grant"),
    ("Apache-2.0", "apache.the apache.may apache.obtain"),
    ("Apache-2.0", "apache.the"),
    ("Apache-2.0", "apache.short"),
    ("GPL-3.0-or-later", "gpl.free gpl3.or gpl.hope"),
    ("GPL-3.0-or-later", "gpl.free gpl3.or"),
    ("GPL-2.0-or-later", "gpl.free gpl2.or gpl.hope"),
    ("GPL-2.0-or-later", "gpl.free gpl2.or"),
    ("GPL-3.0-only", "gpl3.short"),
    ("GPL-2.0-only", "gpl2.short"),
    ("MPL-2.0", "mpl.form"),
    ("CC-BY-NC-4.0", "cc-nc.40"),
    ("CC-BY-NC-4.0", "cc-nc.long"),
    ("CC-BY-SA-4.0", "cc-sa.40"),
    ("CC-BY-SA-4.0", "cc-sa.long"),
    ("CC-BY-4.0", "cc-by.40"),
    ("CC-BY-4.0", "cc-by.long"),
    ("CC0-1.0", "cc0"),
    ("Unlicense", "unlicense"),
    ("All-Rights-Reserved", "reserved"),
]


def _licenses() -> str:
    # "v. 2" is a version, in which no sentence ends.
    words = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))".format
    texts = ", ".join(f"({_quoted(k)}, {_quoted(s)})" for k, s in LICENSE_TEXTS.items())
    steps = [
        f"WITH k AS (SELECT map_from_entries(list({{'k': {words('s')}, 'v': id}})) AS known FROM (VALUES {texts}) AS v(id, s)), "
        "s AS (SELECT doc_id, list_transform(string_split_regex(regexp_replace(coalesce(text, ''), '\\b([vV])\\.[ \\t]+([0-9])', '\\1 \\2', 'g'), '[.;:!?]*[\\n\\r]+|[.;:!?]+[ \\t]+'), "
        f"lambda x: {words('x')}) AS ss FROM documents), "
        "q AS (SELECT doc_id, list_filter(list_transform(ss, lambda x: known[x]), lambda x: x IS NOT NULL) AS ids FROM s, k), "
        "q0 AS (SELECT doc_id, ids, ' ' || array_to_string(ids, '  ') || ' ' AS line, []::varchar[] AS names FROM q)"
    ]
    for n, (name, seq) in enumerate(LICENSE_RULES):
        run, name = _quoted(f" {seq.replace(' ', '  ')} "), _quoted(name)
        steps.append(
            f"q{n + 1} AS (SELECT doc_id, ids, replace(line, {run}, '|') AS line, "
            f"CASE WHEN contains(line, {run}) AND NOT list_contains(names, {name}) THEN list_append(names, {name}) ELSE names END AS names FROM q{n})"
        )
    worst = "CASE " + " ".join(f"WHEN list_has_any(names, [{', '.join(map(_quoted, of))}]) THEN '{c}'" for c, of in LICENSE_CLASSES.items()) + " ELSE 'none' END"
    return ", ".join(steps) + f" SELECT doc_id, len(ids)::bigint AS n_sentences, array_to_string(ids, ' ') AS sentence_ids, array_to_string(names, ',') AS licenses, {worst} AS license_class FROM q{len(LICENSE_RULES)}"


# Kinds of secrets in their order, pattern, group of the value, least length; what the method adds; what examples hold.
_KEYWORDS = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
SECRET_KINDS = [
    ("assign", rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", "([0-9a-f]+)", 1, 24),
]
ADDED_KIND = ("opaque", "([0-9A-Za-z_+/=-]+)", 1, 20)
EXAMPLES = ["example", "sample", "changeme", "change_me", "dummy", "placeholder", "your", "test", "xxxx", "1234567", "abcdef", "redacted", "foobar"]


def _spans(kind: tuple[str, str, int, int], number: int, condition: str) -> str:
    _, pattern, group, least = kind
    p = _quoted(pattern)
    return f"""
  SELECT r, {number} AS number, "start", "start" + length(m) AS "end", v AS value FROM (
    SELECT r, m, v, i, coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0) AS "start"
    FROM (SELECT r, gaps, ms, unnest(ms) AS m, unnest(vs) AS v, unnest(range(1, len(ms) + 1)) AS i
      FROM (SELECT r, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}) AS ms, regexp_extract_all(t, {p}, {group}) AS vs FROM d)))
  WHERE length(v) >= {least} AND {condition}"""


def _secrets() -> str:
    mixed = "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')"
    every = " UNION ALL ".join(_spans(k, n, "true") for n, k in enumerate(SECRET_KINDS)) + " UNION ALL " + _spans(ADDED_KIND, len(SECRET_KINDS), mixed)
    names = "[" + ", ".join(_quoted(k[0]) for k in (*SECRET_KINDS, ADDED_KIND)) + "]"
    example = " OR ".join(f"contains(lower(value), {_quoted(e)})" for e in EXAMPLES)
    text = "string_agg(label, ',' ORDER BY \"start\", number, \"end\")"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
s AS ({every}),
o AS (SELECT value, count(DISTINCT coalesce('=' || source, '')) <= 1 AND count(DISTINCT (source, lang)) <= 2 AS own FROM s JOIN d USING (r) GROUP BY value),
j AS (SELECT r, number, "start", "end", number < {len(SECRET_KINDS)} AS base, own, own AND NOT ({example}) AND len(list_distinct(string_split(value, ''))) >= 8 AS live,
  {names}[number + 1] || ':' || "start"::bigint || ':' || "end"::bigint AS label FROM s JOIN o USING (value)),
g AS (SELECT r, count(*) FILTER (number = 0) AS n_assign, count(*) FILTER (number = 1) AS n_access, count(*) FILTER (number = 2) AS n_hex,
  {text} FILTER (base) AS base, {text} FILTER (base OR live) AS spans, count(*) FILTER (base AND live) AS n_live, count(*) FILTER (base AND NOT own) AS n_copied FROM j GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::bigint AS n_assign, coalesce(n_access, 0)::bigint AS n_access, coalesce(n_hex, 0)::bigint AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::bigint AS n_live, coalesce(n_copied, 0)::bigint AS n_copied
FROM d LEFT JOIN g USING (r)
"""


ORACLE: dict[str, str] = {
    "op1_secrets": _secrets(),
    "op3_exact_dedup": DEDUP,
    "op4_licenses": _licenses(),
    "op6_warc": WARC,
    "op7_quality": QUALITY,
    "op8_sharding": SHARDING,
    "op9_chat": CHAT,
}
