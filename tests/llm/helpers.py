"""Fixtures and plain-Python models that several tests share."""

import random

SYLLABLES = "ba be bi do du fa fe ga go ha he in ka ko la le ma mi na no pa pe ra ro sa se ta ti un vo".split()


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices(SYLLABLES, k=rng.randrange(1, 5))) for _ in range(n)]


def prose(rng: random.Random, n: int) -> str:
    out, ws = [], words(rng, n)
    for i in range(0, n, 12):
        out.append(" ".join(ws[i : i + 12]).capitalize() + ".")
    return "\n".join(" ".join(out[i : i + 3]) for i in range(0, len(out), 3))


#: Rows that every operator has to take: nulls, empty and blank texts, ties, repeats, other scripts.
AWKWARD = [
    (1, "alpha beta gamma", "en", "s0"),
    (1, "alpha beta gamma", "en", "s0"),
    (1, "ALPHA beta gamma", "en", None),
    (None, "alpha beta gamma", None, None),
    (None, None, None, None),
    (2, None, "en", "s0"),
    (3, "", "en", "s1"),
    (4, " \t\n\x0b\x0c\r ", "en", "s1"),
    (5, "é中\U0001f600 <|im_end|> '\"\\ $1", "fr", "s2"),
    (2**62, "x" * 70_000, "en", "s0"),
    (-7, "word " * 20_000, "en", "s0"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Extra columns whose names operators might use themselves.
CLASHING = ["row", "key", "hash", "set", "rank", "n", "block", "line", "a.b", "size", "first"]


def awkward(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(AWKWARD, SCHEMA).withColumns({c: F.lit(f"extra {c}") for c in CLASHING})


def empty(spark):
    return awkward(spark).where("false")


def shingles(text: str | None, width: int = 5) -> frozenset:
    import re

    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + width]) for i in range(max(len(ws) - width + 1, 1)))
