import hashlib
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F
from tests.llm.helpers import SCHEMA, awkward, empty, prose

from panveil.llm import dedup, shard
from panveil.llm.common import cut, sifted

TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_groups(rows, keep):
    groups = {}
    for r in rows:
        groups.setdefault((r.text or "").translate(TABLE), []).append(r.doc_id)
    best = {t: (max if keep == "largest" else min)((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return Counter((r.doc_id, best[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for r in rows for t in [(r.text or "").translate(TABLE)])


def check_dedup(df, keep, **options):
    rows, out = df.collect(), dedup.exact_dedup(df, "doc_id", "text", keep, **options).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == brute_groups(rows, keep)
    kept = [r for r in out if r.kept]
    assert len(kept) == len({r.text_sha256 for r in out}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def documents(spark, n=120):
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(1, 60)) for _ in range(n)]
    rows = [(i, texts[i % 40 if i % 3 else 0], "en", f"s{i % 4}") for i in range(n)]
    return spark.createDataFrame([(i, t.upper() if i % 5 == 0 else t, x, s) for i, t, x, s in rows], SCHEMA)


def test_dedup_equals_brute_force(spark):
    for keep in ("smallest", "largest"):
        check_dedup(documents(spark), keep)
        check_dedup(awkward(spark), keep)


def test_colliding_hashes_are_told_apart_by_bytes(spark):
    weak = lambda digest, norm: F.encode(F.substring(digest, 1, 1), "UTF-8")
    check_dedup(documents(spark), "largest", content_hash=weak)
    check_dedup(awkward(spark), "smallest", content_hash=lambda digest, norm: F.lit(b"\0"))


def test_ids_of_any_kind(spark):
    ids = F.when(F.col("doc_id") == 2, -(2**63)).otherwise(F.col("doc_id"))
    nested = awkward(spark).withColumns({"m": F.array(F.create_map(F.lit("k"), F.col("text"))), "doc_id": ids})
    for df in (nested, nested.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))):
        for keep in ("smallest", "largest"):
            check_dedup(df, keep)
        out = dedup.drop_copies(df, "doc_id", "text")
        assert out.columns == df.columns and out.count() == len({(r.text or "").translate(TABLE) for r in df.collect()})


def test_sifted_loses_nothing(spark):
    df = spark.range(50_000).select("id", F.xxhash64("id").alias("h"))
    for step, most in ((1, 50_000), (100, 10_000), (50_000, 100)):
        keys = cut(df.where(F.col("id") % step == 0).select("h"))
        out = {r.id for r in sifted(df, F.col("h"), keys).collect()}
        assert set(range(0, 50_000, step)) <= out and len(out) <= most
    assert sifted(df, F.col("h"), cut(df.where("false").select("h"))).count() == 0


def test_drop_copies_keeps_columns_and_one_row_of_each_text(spark):
    df = awkward(spark)
    out = dedup.drop_copies(df, "doc_id", "text")
    assert out.columns == df.columns
    got = Counter((r.text or "").translate(TABLE) for r in out.collect())
    assert got == Counter({(r.text or "").translate(TABLE) for r in df.collect()})


def test_rows_drawn(spark):
    from panveil.llm.common import row_key

    df = awkward(spark)
    draws = df.select(row_key(df).alias("key"), F.explode(F.sequence(F.lit(1), F.when(F.col("doc_id") == 3, 3).otherwise(1)))).select("key")
    got, want = dedup.rows_drawn(df, draws), df.select("*", F.explode(F.sequence(F.lit(1), F.when(F.col("doc_id") == 3, 3).otherwise(1))).alias("x")).drop("x")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def brute_shards(rows, shards, seed=0):
    by_source = {}
    for k, r in enumerate(rows):
        text = (r.text or "").encode()
        key = hashlib.md5(f"{seed}:{'null' if r.doc_id is None else r.doc_id}".encode()).digest()
        item = (key, (r.doc_id is not None, r.doc_id or 0), zlib.crc32(text), len(text) + 1, k)
        by_source.setdefault("" if r.source is None else "=" + r.source, []).append(item)
    line = []
    for s, items in by_source.items():
        for rank, item in enumerate(sorted(items)):
            line.append(((rank + 0.5) / len(items), s, rank, item))
    line.sort()
    out, slots = Counter(), Counter()
    for position, (_, _, _, (_, (there, i), crc, size, _)) in enumerate(line):
        n = position * shards // len(line)
        out[(i if there else None, size, crc, n, slots[n])] += 1
        slots[n] += 1
    return out


def test_shards_equal_brute_force(spark):
    for df in (documents(spark), awkward(spark)):
        for shards in (1, 3, 8, 50):
            out = shard.interleave(df, "doc_id", "text", "source", shards).collect()
            assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in out) == brute_shards(df.collect(), shards)


def test_shards_match_the_mixture(spark):
    df = documents(spark, 403)
    out = shard.interleave(df, "doc_id", "text", "source", 8)
    counts = Counter((r.shard, r.source) for r in out.collect())
    total = Counter(r.source for r in df.collect())
    assert all(abs(counts[(n, s)] - total[s] / 8) <= 1 for n in range(8) for s in total)
    sizes = Counter(n for (n, _), c in counts.items() for _ in range(c))
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_empty_tables(spark):
    assert dedup.exact_dedup(empty(spark), "doc_id", "text").count() == 0
    assert dedup.drop_copies(empty(spark), "doc_id", "text").count() == 0
    assert shard.interleave(empty(spark), "doc_id", "text", "source").count() == 0
