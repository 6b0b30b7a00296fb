"""Secret scans with corpus-wide ownership: candidates by pattern, then who holds each value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panveil.llm.common import col, cut, hash128, let, prefix_sums, whole

# The kinds in their order, each with its pattern, the group that is the value, and its least length.
_WORDS = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
KINDS = (
    ("assign", f"({_WORDS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", "([0-9a-f]+)", 1, 24),
)
# Spans that the method adds: long runs that nothing names, of all three classes of letters.
OPAQUE = ("opaque", "([A-Za-z0-9+/_=-]+)", 1, 20)
#: Of a run that can match, to leave texts without any alone. {24,} and the like find the same runs.
_HINTS = {"assign": f"({_WORDS})[\"']?\\x20*[:=]", "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}", "opaque": "[A-Za-z0-9+/_=-]{20,}"}
# What examples look like.
PLACEHOLDER = "(?i)example|sample|changeme|change_me|dummy|placeholder|your|test|xxxx|1234567|abcdef|redacted|foobar"


def _live_looking(value: Column) -> Column:
    return ~F.rlike(value, F.lit(PLACEHOLDER)) & (F.size(F.array_distinct(F.split(value, ""))) >= 8)


def spans_of(text: Column, kind: tuple[str, str, int, int], number: int) -> Column:
    """array<struct<start,number,end,value>> in code points: leftmost matches that do not overlap, short ones dropped."""
    name, pattern, group, least = kind
    if name in ("access", "hex", "opaque"):  # runs, of which the short ones can be left out by the pattern itself
        pattern = f"({_HINTS[name]})"
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
    whole_match = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m).cast("long"))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def build(g: Column) -> Column:
        return let(whole_match, lambda m: let(values, lambda v: let(
            prefix_sums(F.zip_with(g, m, lambda a, b: a + F.coalesce(b, F.lit(0)))),
            lambda at: F.transform(
                F.filter(F.sequence(F.lit(0), F.size(m)), lambda i: i < F.size(m)),
                lambda i: F.struct((F.get(at, i) + F.get(g, i)).alias("start"), F.lit(number).alias("number"), (F.get(at, i) + F.get(g, i) + F.get(m, i)).alias("end"), F.get(v, i).alias("value")),
            ),
        )))

    found = F.filter(let(gaps, build), lambda s: F.length(s["value"]) >= least)
    if name == "opaque":
        found = F.filter(found, lambda s: F.rlike(s["value"], F.lit("[0-9]")) & F.rlike(s["value"], F.lit("[a-z]")) & F.rlike(s["value"], F.lit("[A-Z]")))
    return F.when(F.rlike(text, F.lit(_HINTS[name])), found).otherwise(F.array()).cast("array<struct<start:bigint,number:int,end:bigint,value:string>>")


def ownership(df: DataFrame, id_col: str, text_col: str, repo_cols: list[str], owner_col: str, max_owners: int = 1, max_repos: int = 2) -> DataFrame:
    """One row for each input row: doc_id, base (spans by pattern), added (spans by ownership), n_live, n_copied.

    Each candidate's SHA-256 is counted over the whole corpus by distinct owners and distinct repositories. A value is
    owner-specific if max_owners at most hold it in max_repos repositories at most. A repository is a distinct value of
    repo_cols within an owner, so one that two owners hold counts for each. Spans by pattern all stay; n_live
    of them are owner-specific and do not look like examples, n_copied are in more hands. Long opaque runs that no
    pattern names are added as spans where they are owner-specific and look live: what many share is no secret. They may overlap
    spans by pattern.

    Texts are read once. Only spans and hashes move after that, and counts are combined before each shuffle, so that a
    value in a third of all rows costs a row for each task. Null text is empty; null owners are one owner, as are null
    repositories; null and repeated ids stay, a row for each, and copies of a text under several owners count for each.
    A very long text is searched as a whole, by patterns that take no stack for its length. No rows, no result.
    """
    base = F.concat(*(spans_of(F.col("text"), k, n) for n, k in enumerate(KINDS)))
    read = df.select(
        col(id_col).alias("doc_id"), F.coalesce(F.concat(F.lit("="), col(owner_col).cast("string")), F.lit("")).alias("owner"),
        F.struct(*hash128(*map(col, repo_cols))).alias("repo"), whole(text_col).alias("text"),
    )
    hashed = lambda spans, base_span: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["number"].alias("number"), s["end"].alias("end"), F.unhex(F.sha2(s["value"], 256)).alias("hash"), _live_looking(s["value"]).alias("live"), F.lit(base_span).alias("base")))
    found = read.select("doc_id", "owner", "repo", F.monotonically_increasing_id().alias("row"), F.sort_array(F.concat(hashed(base, True), hashed(spans_of(F.col("text"), OPAQUE, len(KINDS)), False))).alias("spans"))
    found = cut(found)
    each = found.select("row", "owner", "repo", F.explode("spans").alias("s")).select("row", "owner", "repo", "s.*")
    held = each.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    owners = held.groupBy("hash", "owner").agg(F.count("*").alias("repos")).groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))
    owners = cut(owners)  # so that the join shuffles for itself and a common value's rows can be split over tasks
    own = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    judged = each.join(owners, "hash").select("row", "base", "live", own.alias("own"), F.struct("start", "number", "end").alias("span"))
    per_row = judged.groupBy("row").agg(
        F.count_if(F.col("base") & F.col("own") & F.col("live")).alias("n_live"),
        F.count_if(F.col("base") & ~F.col("own")).alias("n_copied"),
        F.sort_array(F.collect_list(F.when(~F.col("base") & F.col("own") & F.col("live"), F.col("span")))).alias("added"),
    )
    place = lambda s: F.struct(s["start"].alias("start"), s["number"].alias("number"), s["end"].alias("end"))
    out = found.select("doc_id", "row", F.transform(F.filter("spans", lambda s: s["base"]), place).alias("base")).join(per_row, "row", "left")
    none = F.array().cast("array<struct<start:bigint,number:int,end:bigint>>")
    return out.select("doc_id", "base", F.coalesce("added", none).alias("added"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"))


def described(spans: Column) -> Column:
    """kind:start:end of each span by start, then kind, comma-joined."""
    names = F.array(*(F.lit(k[0]) for k in (*KINDS, OPAQUE)))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat(F.get(names, s["number"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
