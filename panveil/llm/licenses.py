"""License scans by sentence rules: known sentences become identifiers, sequences of which match ordered rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panveil.llm.common import col, let, whole

# Sentences of licences as they read in lower case with all but letters and digits as single spaces.
SENTENCES = {
    "cc-nc.40": "licensed under cc by nc 4 0",
    "cc-by.40": "licensed under cc by 4 0",
    "cc-sa.40": "licensed under cc by sa 4 0",
    "cc-nc.long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by.long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-sa.long": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc0": "this work is dedicated to the public domain under cc0 1 0",
    "gpl3.short": "this work is licensed under the gnu general public license version 3",
    "gpl2.short": "this work is licensed under the gnu general public license version 2",
    "gpl.free": "this program is free software",
    "gpl3.or": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2.or": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl.hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl.fitness": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "apache.short": "licensed under the apache license version 2 0",
    "apache.the": "licensed under the apache license version 2 0 the license",
    "apache.may": "you may not use this file except in compliance with the license",
    "apache.obtain": "you may obtain a copy of the license at",
    "mit.short": "released under the mit license",
    "mit.licensed": "licensed under the mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd.grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl.form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "as-is": "the software is provided as is without warranty of any kind express or implied",
    "reserved": "all rights reserved",
}
# Rules in order; the first that matches a stretch of identifiers takes it. Each: licence, class, identifiers.
RULES = (
    ("BSD-3-Clause", "permissive", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse")),
    ("BSD-2-Clause", "permissive", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("MIT", "permissive", ("mit.grant", "mit.notice", "as-is")),
    ("MIT", "permissive", ("mit.grant", "mit.notice")),
    ("MIT", "permissive", ("mit.short",)),
    ("MIT", "permissive", ("mit.licensed",)),
    ("ISC", "permissive", ("isc.grant",)),
    ("Apache-2.0", "permissive", ("apache.the", "apache.may", "apache.obtain")),
    ("Apache-2.0", "permissive", ("apache.the",)),
    ("Apache-2.0", "permissive", ("apache.short",)),
    ("GPL-3.0-or-later", "copyleft", ("gpl.free", "gpl3.or", "gpl.hope")),
    ("GPL-3.0-or-later", "copyleft", ("gpl.free", "gpl3.or")),
    ("GPL-2.0-or-later", "copyleft", ("gpl.free", "gpl2.or", "gpl.hope")),
    ("GPL-2.0-or-later", "copyleft", ("gpl.free", "gpl2.or")),
    ("GPL-3.0-only", "copyleft", ("gpl3.short",)),
    ("GPL-2.0-only", "copyleft", ("gpl2.short",)),
    ("MPL-2.0", "copyleft", ("mpl.form",)),
    ("CC-BY-NC-4.0", "noncommercial", ("cc-nc.40",)),
    ("CC-BY-NC-4.0", "noncommercial", ("cc-nc.long",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc-sa.40",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc-sa.long",)),
    ("CC-BY-4.0", "permissive", ("cc-by.40",)),
    ("CC-BY-4.0", "permissive", ("cc-by.long",)),
    ("CC0-1.0", "permissive", ("cc0",)),
    ("Unlicense", "permissive", ("unlicense",)),
    ("All-Rights-Reserved", "reserved", ("reserved",)),
)
# Other forms, as patterns over words as in SENTENCES, a low line being a space that ends no line. Licences named in a grant or an SPDX line: name, class, pattern.
_CC = "(?:cc|creative commons) (?:by|attribution)"
_NC, _SA, _ND = "(?:nc|non ?commercial)", "(?:sa|share ?alike)", "(?:nd|no ?deriv(?:ative)?s?|no derivative works)"
_END = "(?: international| unported| generic)?"
_GPL, _LGPL, _AGPL = "(?:gnu )?(?:general public|gpl)", "(?:gnu )?(?:lesser general public|library general public|lgpl)", "(?:gnu )?(?:affero general public|agpl)"
_LATER = "(?:or (?:at your option )?(?:any )?(?:later|newer)(?: version)?|plus)"


def _gnu(family: str, version: str, later: bool) -> str:
    return f"{family}(?: license| licence)? ?(?:version |v ?)?{version}(?! [0-9])" + (f" {_LATER}" if later else "(?: only)?")


NAMED = (
    ("MIT", "permissive", "(?:mit|expat)(?: x11)?"),
    ("ISC", "permissive", "isc"),
    ("Apache-2.0", "permissive", "apache(?: software)?(?: license| licence)? ?(?:version |v ?)?2(?: 0)?"),
    ("BSD-3-Clause", "permissive", "(?:bsd 3 clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd)"),
    ("BSD-2-Clause", "permissive", "(?:bsd 2 clause|(?:2|two) clause bsd|simplified bsd|freebsd)"),
    ("Zlib", "permissive", "zlib"),
    ("BSL-1.0", "permissive", "(?:bsl 1 0|boost software(?: license| licence)? (?:version |v ?)?1 0)"),
    *((f"{name}-{v}{'-or-later' if later else '-only'}", "copyleft", _gnu(family, words, later))
      for name, family, versions in (("GPL", _GPL, (("2.0", "2(?: 0)?"), ("3.0", "3(?: 0)?"))), ("LGPL", _LGPL, (("2.0", "2(?: 0)?"), ("2.1", "2 1"), ("3.0", "3(?: 0)?"))), ("AGPL", _AGPL, (("3.0", "3(?: 0)?"),)))
      for v, words in versions for later in (True, False)),
    ("MPL-2.0", "copyleft", "(?:mpl|mozilla public)(?: license| licence)? ?(?:version |v ?)?2(?: 0)?"),
    *((f"EPL-{v}.0", "copyleft", f"(?:epl|eclipse public)(?: license| licence)? ?(?:version |v ?)?{v}(?: 0)?") for v in (1, 2)),
    *((f"CC-BY{part}-{v}.{w}", kind, f"{_CC}{words} {v} {w}{_END}")
      for part, kind, words in (
          ("", "permissive", ""), ("-SA", "copyleft", f" {_SA}"), ("-ND", "noderivatives", f" {_ND}"), ("-NC", "noncommercial", f" {_NC}"),
          ("-NC-SA", "noncommercial", f" {_NC} {_SA}"), ("-NC-ND", "noderivatives", f" {_NC} {_ND}"),
      ) for v, w in ((1, 0), (2, 0), (2, 5), (3, 0), (4, 0))),
    ("CC0-1.0", "permissive", "(?:creative commons )?(?:cc0|cc zero)(?: 1 0)?(?: universal)?"),
    ("Unlicense", "permissive", "unlicense"),
)
#: What a grant may begin and end with around the licence that it names.
LEAD = "(?:(?:(?:this|the|all|our) (?:[a-z0-9]+_){1,3}|(?!nothing|none|neither|what|which|if|not)[a-z0-9]+_)(?:is|are) (?:free software )?(?:hereby )?)?(?:(?:dual )?licen[sc]ed|released|distributed|(?:made )?available|published|provided) under (?:the |an? )?(?:terms (?:and conditions )?of (?:the |an? )?|conditions of (?:the |an? )?)?"
TAIL = "(?: (?:public )?(?:license|licence))?(?: see(?:_[a-z0-9]+){1,12})?"
SPDX = "spdx license identifier(?:_[a-z0-9]+){1,40}"
_FREE = "you can redistribute it and or modify it under the terms of the gnu {} license as published by the free software foundation {}version {} of the license"
_OPTION = " or at your option any later version"
# Longer or looser forms of known sentences, and notices of other licences: identifier, pattern.
FORMS = (
    ("as-is", "(?:the|this) (?:software|work) is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non ?infringement"),
    ("reserved", "(?:copyright|c) (?:[a-z0-9]+_){0,20}all rights reserved"),
    ("gpl.free", "this (?:[a-z0-9]+_){1,3}is free software"),
    ("isc.grant", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd.endorse", "neither the names? of (?:[a-z0-9]+ ){1,15}nor the names of (?:its|their|the) contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    *((f"named:{name}-{v}-{'or-later' if later else 'only'}", _FREE.format(f"{family} general public", "either " if later else "", v.replace(".", " ").removesuffix(" 0")) + (_OPTION if later else ""))
      for name, family, versions in (("LGPL", "(?:lesser|library)", ("2.0", "2.1", "3.0")), ("AGPL", "affero", ("3.0",))) for v in versions for later in (True, False)),
    *((f"named:GPL-{v}.0-only", _FREE.format("general public", "", v)) for v in "23"),
)
MORE_RULES = tuple((name, kind, (f"named:{name}",)) for name, kind, _ in NAMED)
CLASSES = ("reserved", "noncommercial", "copyleft", "permissive")  # the strictest first
STRICTEST = ("reserved", "noderivatives", *CLASSES[1:])  # with those of MORE_RULES

#: Where a sentence ends. A full stop within a version number is not followed by white space.
BREAK = r"[.;:!?]*[\n\r]+|[.;:!?]+[\x20\t]+"
#: Some word that every sentence holds one of, to leave other texts alone.
HINT = "[Ll][Ii][Cc][Ee][Nn][Ss]|[Pp][Ee][Rr][Mm][Ii][Ss]|[Rr][Ee][Dd][Ii][Ss][Tt][Rr]|[Cc][Oo][Pp][Yy]|[Rr][Ii][Gg][Hh][Tt][Ss]|[Ww][Aa][Rr][Rr][Aa]|[Pp][Uu][Bb][Ll][Ii][Cc]|[Pp][Rr][Oo][Gg][Rr][Aa][Mm]|[Cc][Cc]|[Uu][Nn][Dd][Ee][Rr]\\s"


#: What a line may begin with that is not its text: comment marks, whether signs or words, and numbers of a list.
PREFIX = r"(?m)^[^A-Za-z0-9\r\n]*(?:(?:dnl|DNL|rem|REM)\b[^A-Za-z0-9\r\n]*)?(?:\(?(?:[0-9]{1,2}|[A-Za-z])[.)][\x20\t]+)?"


def normal_text(text: Column) -> Column:
    """Its words as in SENTENCES, each between single spaces, with a bar where a line or a sentence ends."""
    plain = F.regexp_replace(F.regexp_replace(text, "SPDX-License-Identifier:\\s*", "SPDX-License-Identifier "), r"(GPL-[0-9]\.[0-9])\+", "$1-or-later")
    plain = F.regexp_replace(F.regexp_replace(plain, PREFIX, ""), BREAK, "\n")
    framed = F.concat(F.lit("\n"), F.lower(plain), F.lit("\n"))
    return F.regexp_replace(F.regexp_replace(framed, "[^a-z0-9\n]+", " "), " ?\n[ \n]*", " | ")


def _wrapped(pattern: str) -> str:
    """The pattern with a break allowed at each space."""
    return re.sub(r" (\??)", lambda m: r"(?: (?:\| )?)?" if m[1] else r" (?:\| )?", pattern).replace("_", " ")


def _named(words: Column) -> Column:
    """The identifier of a licence's name, null if it is none."""
    return F.coalesce(*(F.when(F.rlike(words, F.lit(f"^(?:{p})$")), F.lit(f"named:{name}")) for name, _, p in NAMED))


def identifiers(sentence: Column) -> Column:
    """Of a sentence that has been found, as words: one, or those of the names in an SPDX line."""
    names = "|".join(p for _, _, p in NAMED)
    known = F.create_map(*(F.lit(x) for k, s in SENTENCES.items() for x in (s, k)))
    form = F.coalesce(*(F.when(F.rlike(sentence, F.lit(f"^(?:{p})$".replace("_", " "))), F.lit(k)) for k, p in FORMS))
    granted = _named(F.regexp_extract(sentence, f"^{LEAD}({names}){TAIL}$".replace("_", " "), 1))
    in_line = F.transform(F.regexp_extract_all(sentence, F.lit(f"(?<![a-z0-9])(?:{names})(?![a-z0-9])"), F.lit(0)), _named)
    return F.when(F.startswith(sentence, F.lit("spdx ")), in_line).otherwise(F.array(F.coalesce(F.try_element_at(known, sentence), form, granted)))


def recognised(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order; others are left out, so rules match across them.

    A known sentence begins and ends where a line or sentence does. Breaks between its words do not matter, so it is found
    however its lines are wrapped. Those of SENTENCES come before other forms.
    """
    sentences = sorted(SENTENCES.values(), key=len, reverse=True)
    names = "|".join(p for _, _, p in NAMED)
    every = _wrapped("|".join([*sentences, *(p for _, p in FORMS), f"{LEAD}(?:{names}){TAIL}", SPDX]))
    found = F.regexp_extract_all(normal_text(text), F.lit(rf"(?<=\| )(?:{every})(?= \|)"), F.lit(0))
    ids = F.flatten(F.transform(found, lambda s: let(F.replace(s, F.lit("| "), F.lit("")), identifiers)))
    return F.when(F.rlike(text, F.lit(HINT)), F.filter(ids, lambda k: k.isNotNull())).otherwise(F.array().cast("array<string>"))


def licences(ids: Column) -> Column:
    """Names in the order of the rules; a rule takes the identifiers it matches away from those after it."""
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(" " + "  ".join(seq) + " ").alias("seq")) for name, _, seq in (*RULES, *MORE_RULES)))
    # Identifiers stand as " a  b ", each between spaces of its own, so that neighbours match without sharing one.
    line = F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" "))
    init = lambda s: F.struct(s.alias("line"), F.array().cast("array<string>").alias("names"))
    step = lambda acc, r: F.when(
        F.contains(acc["line"], r["seq"]),
        F.struct(F.replace(acc["line"], r["seq"], F.lit("|")).alias("line"), F.array_union(acc["names"], F.array(r["name"])).alias("names")),
    ).otherwise(acc)
    return F.when(F.size(ids) > 0, F.aggregate(rules, init(line), step, lambda acc: acc["names"])).otherwise(F.array().cast("array<string>"))


def scan(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each input row: doc_id, n_sentences (known ones), sentence_ids, licenses and license_class.

    Sentences end at line breaks and at punctuation before white space; known ones may also be wrapped over lines, with
    comment marks. license_class is the strictest class of the
    licences found, none without any. Everything happens within a row. Null and empty texts have no sentence; null
    and repeated ids stay, a row for each.
    """
    classes = {name: kind for name, kind, _ in (*RULES, *MORE_RULES)}
    of = F.create_map(*(F.lit(x) for pair in classes.items() for x in pair))
    found = df.select(col(id_col).alias("doc_id"), recognised(whole(text_col)).alias("ids"))
    named = found.select("doc_id", "ids", licences(F.col("ids")).alias("names"))
    kinds = F.transform("names", lambda n: F.try_element_at(of, n))
    strictest = lambda k: F.coalesce(*(F.when(F.array_contains(k, c), F.lit(c)) for c in STRICTEST), F.lit("none"))
    return named.select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", " ").alias("sentence_ids"),
        F.array_join("names", ",").alias("licenses"), let(kinds, strictest).alias("license_class"),
    )
