"""Temperature mixing: token shares to a power, found by bisection, realised as budgeted permutations of blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panveil.llm.common import col, cut, row_key, running, stored, whole

#: Where doubling ends: sources that differ by a millionth are apart by then, and equal ones never are.
MAX_EXPONENT = 2.0**24
#: Bisections for each pass over the totals, and passes.
HALVINGS, PASSES = 6, 7
# Scripts that are written without spaces, of which each character counts as a token.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"


def estimated_tokens(text: Column) -> Column:
    """Characters of scripts without spaces, words of all others, and one for the end."""
    space = r"\x20\x09-\x0D"
    return (F.regexp_count(text, F.lit(f"[{UNSPACED}]|[^{space}{UNSPACED}]+")) + 1).cast("long")


@dataclass(frozen=True)
class Totals:
    """What the choice of an exponent has to know of the sources that have tokens."""

    sources: int
    tokens: int
    least: int
    most: int
    #: For each exponent a: the sum of (tokens / most)^a over sources, and the entropy of the shares that are in that proportion.
    at: Callable[[Sequence[float]], list[tuple[float, float]]]


def totals_of(counts: DataFrame) -> Totals:
    """Of a table with a row for each source, total its tokens. Sums are made in Spark, so there is no limit to sources."""
    some = counts.where("total > 0")
    k, n, least, most = some.agg(F.count("*"), F.sum("total"), F.min("total"), F.max("total")).first()

    def at(exponents: Sequence[float]) -> list[tuple[float, float]]:
        log = some.select(F.log(F.col("total") / F.lit(float(most))).alias("log"), F.explode(F.array(*map(F.lit, exponents))).alias("a"))
        power = F.exp(F.col("a") * F.col("log"))
        sums = {a: (z, s) for a, z, s in log.groupBy("a").agg(F.sum(power), F.sum(power * F.col("log"))).collect()}
        return [(z, math.log(z) - a * s / z) for a in exponents for z, s in (sums[a],)]

    return Totals(k, n or 0, least or 0, most or 0, at)


def least_exponent(low: float, high: float, holds: Callable[[Sequence[float]], list[bool]]) -> float:
    """The least exponent of low to high that holds, by bisection; it has to hold at high, and beyond where it does at all.

    A pass tries all the points that its next few halvings could come to, and then makes those.
    """
    for _ in range(PASSES):
        inner = [low + (high - low) * k / 2**HALVINGS for k in range(1, 2**HALVINGS)]
        held = [False, *holds(inner), True]
        below, above = 0, 2**HALVINGS
        while above - below > 1:
            mid = (below + above) // 2
            below, above = (below, mid) if held[mid] else (mid, above)
        points = [low, *inner, high]
        low, high = points[below], points[above]
    return high


def find_mixture(totals: Totals, budget: int | None, target_entropy: float | None, max_repeats: float | None) -> tuple[float, int]:
    """The exponent and the budget of tokens, such that both limits are met.

    target_entropy is a fraction of the entropy of even weights. Entropy falls as the exponent grows, so the least exponent
    that does not exceed it meets it; that is above 1 where the corpus itself is more even. max_repeats is the number of times that
    any source may be read: the exponent is raised towards 1, where repetition is least, until it is met. Where that
    is not enough, as for a budget of more than max_repeats times the corpus, the budget is cut to what meets it, by default that
    of the corpus. A target that no exponent meets, as where sources are equal, is a ValueError.
    """
    budget = totals.tokens if budget is None else budget
    if totals.sources == 0:
        return 1.0, 0
    slack = 1 + 1e-9
    target = math.inf if target_entropy is None else target_entropy * math.log(totals.sources) + 1e-9
    if max_repeats is not None:
        budget = min(budget, math.floor(max_repeats * totals.tokens))
    calm = lambda exponents: [h <= target for _, h in totals.at(exponents)]

    def repeats(a: float, z: float) -> float:
        """Of the source that is read most: the smallest for exponents below 1, the largest beyond."""
        return budget / (z * totals.most) * max(1.0, (totals.least / totals.most) ** (a - 1) if a < 1 else 1.0)

    rare = lambda exponents: [max_repeats is None or repeats(a, z) <= max_repeats * slack for a, (z, _) in zip(exponents, totals.at(exponents), strict=True)]
    grid = [0.0, *(2.0**k for k in range(int(math.log2(MAX_EXPONENT)) + 1))]
    first = next((k for k, ok in enumerate(calm(grid)) if ok), None)
    if first is None:
        raise ValueError(f"no exponent gives an entropy of {target_entropy} of even weights; sources are equal or almost so")
    exponent = grid[first] if first == 0 else least_exponent(grid[first - 1], grid[first], calm)
    if not rare([exponent])[0]:
        if exponent < 1:
            exponent = least_exponent(exponent, 1.0, rare)
        else:
            budget = math.floor(budget * max_repeats / repeats(exponent, totals.at([exponent])[0][0]))
    return exponent, budget


def mix(
    df: DataFrame, id_col: str, text_col: str, source_col: str, budget: int | None = None, target_entropy: float | None = 0.95,
    max_repeats: float | None = 2.0, block_tokens: int = 200_000, seed: int = 0, tokens: Column | None = None,
) -> DataFrame:
    """One row for each time that an input row is drawn: doc_id, source, n_tokens, epoch, block, position, weight, row_key.

    tokens says how many each row has, as pack.token_count() does by a tokenizer; by default estimated_tokens() of the
    text. find_mixture() gives the exponent and the budget, and a source's quota is its weight in it, rounded. A source's rows lie in
    blocks of about block_tokens, by hash; each epoch permutes its blocks by another hash, and takes them in that order
    until the quota is used up. Of the block in which it ends, rows are taken in the order of a hash as long as they
    begin below it, so a source gets its quota to within one row. position is the share of the source's quota that came before
    the block: sorted by it, sources interleave by weight.

    Only blocks, a row each, are put in order, and rows of the last block of each source, both by ranges; no source or
    block meets in one task. Null text has the token for its end, null counts are 0, and rows without tokens are drawn where
    their block is. Null sources are a source. Rows that are equal are drawn one by one, ties among them broken freely, and lie
    in one block, which they may fill beyond block_tokens. A text counts as a whole, however long. No rows, no result.
    """
    count = estimated_tokens(whole(text_col)) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0).cast("long"))
    source = F.coalesce(F.concat(F.lit("="), col(source_col).cast("string")), F.lit(""))
    rows = df.select(col(id_col).alias("doc_id"), source.alias("source"), count.alias("n_tokens"), row_key(df).alias("row_key"))
    rows = cut(rows.withColumn("spot", F.xxhash64(F.lit(seed), "row_key")).withColumn("row", F.monotonically_increasing_id()))
    counts = cut(rows.groupBy("source").agg(F.sum("n_tokens").alias("total")))
    totals = totals_of(counts)
    exponent, whole_budget = find_mixture(totals, budget, target_entropy, max_repeats)
    unit = totals.at([exponent])[0][0] if totals.sources else 1.0
    weight = F.exp(F.lit(exponent) * F.log(F.col("total") / F.lit(float(totals.most)))) / F.lit(unit)
    plan = counts.where("total > 0").withColumn("quota", F.round(weight * whole_budget).cast("long"))
    plan = plan.withColumns({"blocks": F.greatest(F.lit(1), F.expr(f"total div {block_tokens}")), "epochs": F.expr("(quota + total - 1) div total")})
    plan = stored(plan, "mixture")  # a table of known size, which is broadcast if that is small
    placed = rows.join(plan, "source").withColumn("block", F.expr("pmod(spot, blocks)"))
    sizes = placed.groupBy("source", "block", "total", "quota", "epochs").agg(F.sum("n_tokens").alias("size"))
    # Whole epochs take every block; only the last one, if it is not whole, has to be put in order up to its quota.
    epochs = sizes.withColumn("epoch", F.explode(F.expr("filter(sequence(0L, epochs), e -> e < epochs)")))
    epochs = epochs.withColumn("turn", F.xxhash64(F.lit(seed), "epoch", "block"))
    blocks = running(epochs, ["source", "epoch"], ["turn", "block"], "size", "before").withColumn("before", F.col("before") + F.col("epoch") * F.col("total"))
    blocks = blocks.where("before < quota").withColumn("room", F.col("quota") - F.col("before"))
    taken = blocks.select("source", "block", "epoch", "size", "room", (F.col("before") / F.col("quota")).alias("position"), (F.col("quota") / F.lit(max(whole_budget, 1))).alias("weight"))
    drawn = placed.select("doc_id", "source", "n_tokens", "row_key", "row", "block").join(taken, ["source", "block"])
    out = ["doc_id", F.when(F.col("source") != "", F.expr("substring(source, 2)")).alias("source"), "n_tokens", F.col("epoch").cast("int").alias("epoch"), "block", "position", "weight", "row_key"]
    last = drawn.where("size > room").withColumn("mixed", F.xxhash64(F.lit(seed), "epoch", "row_key"))
    last = running(last, ["source", "block", "epoch"], ["mixed", "row"], "n_tokens", "ahead").where("ahead < room")
    return drawn.where("size <= room").select(*out).unionByName(last.select(*out))
