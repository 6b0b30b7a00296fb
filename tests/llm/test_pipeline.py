"""The pipeline stage by stage against plain Python, and the queries against their SQL."""

import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import SCHEMA, awkward, prose, shingles
from tests.llm.test_pack_warc import plain  # noqa: F401
from tests.llm.test_scans import brute_counts

import corpus_pipeline
from panveil.llm.queries import LLM_ORACLE, LLM_QUERIES

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def write(df, folder):
    df.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def corpus(spark):
    rng = random.Random(21)
    rows = []
    for i in range(60):
        text = prose(rng, rng.randrange(20, 150))
        rows.append((3 * i, text, "en", f"s{i % 4}"))
        if i % 3 == 0:
            rows.append((3 * i + 1, text.upper(), "en", f"s{i % 3}"))
        if i % 4 == 0:
            rows.append((3 * i + 2, text.replace(".", ". ", 1) + " extra", "en", "s0"))
    return spark.createDataFrame(rows, SCHEMA).unionByName(awkward(spark), allowMissingColumns=True).drop("a.b")


def test_stages_against_brute_force(spark, tmp_path, plain):  # noqa: F811
    folder = write(corpus(spark), tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, columns = docs.collect(), docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        after = docs.collect()
        if name != "pack":
            assert docs.columns == columns
        if name == "quality":
            assert Counter(after) == Counter(r for r in before if not brute_counts(r.text or "")[5])
        elif name == "exact_dedup":
            first = {}
            for r in before:
                t = r.text.translate(FOLD)
                first[t] = min(first.get(t, r.doc_id), r.doc_id)
            assert Counter((r.doc_id, r.text.translate(FOLD)) for r in after) == Counter((i, t) for t, i in first.items())
        elif name == "near_dedup":
            kept = {r.doc_id: shingles(r.text) for r in after}
            alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
            assert not any(alike(a, b) for i, a in kept.items() for j, b in kept.items() if i < j)
            gone = [r for r in before if r.doc_id not in kept]
            assert gone and all(any(alike(shingles(r.text), shingles(o.text)) for o in before if o.doc_id != r.doc_id) for r in gone)
        elif name == "mix":
            assert set(after) <= set(before) and len(after) > 0
        else:
            sizes = Counter()
            for r in after:
                sizes[r.doc_id] += r.length
            drawn = Counter(r.doc_id for r in before)
            assert sizes == Counter({r.doc_id: drawn[r.doc_id] * (len(plain(r.text)) // 4 + 1) for r in before})
        before = after


def test_mixed_documents_lie_in_the_order_of_the_mixture(spark):
    rng = random.Random(23)
    rows = [(i, prose(rng, 60), "en", "big" if i < 60 else "small") for i in range(70)]
    ids = [r.doc_id for r in corpus_pipeline.mixed(spark, spark.createDataFrame(rows, SCHEMA), "").collect()]
    again = [i for i, n in Counter(ids).items() if n > 1]
    assert again and len(set(ids[: len(set(ids))])) == len(set(ids))  # every document once before any comes again


def strings(spark):
    """Awkward rows with ids that are texts, and a column that holds maps."""
    df = awkward(spark).withColumns({"doc_id": F.concat(F.lit("d"), F.col("doc_id").cast("string")), "n_chars": F.length("text").cast("long")})
    return df.withColumn("m", F.array(F.struct(F.create_map(F.lit("k"), F.col("text")).alias("of"))))


@pytest.mark.parametrize("make", [awkward, strings])
def test_stages_take_awkward_rows_as_they_are(spark, plain, make):  # noqa: F811
    docs = make(spark)
    before = docs.collect()
    results = {name: stage(spark, docs, "") for name, stage in corpus_pipeline.STAGES}
    assert all(df.columns == docs.columns for name, df in results.items() if name != "pack")
    ids = lambda rows: [r.doc_id for r in rows if r.doc_id is not None]
    assert Counter(map(repr, results["quality"].collect())) == Counter(repr(r) for r in before if not brute_counts(r.text or "")[5])
    groups = {}
    for r in before:
        groups.setdefault((r.text or "").translate(FOLD), []).append(r)
    want = Counter((min(ids(g), default=None), t) for t, g in groups.items())
    assert Counter((r.doc_id, (r.text or "").translate(FOLD)) for r in results["exact_dedup"].collect()) == want
    groups = {}
    for r in before:
        groups.setdefault(shingles(r.text), []).append(r)
    assert Counter(r.doc_id for r in results["near_dedup"].collect()) == Counter(min(ids(g), default=None) for g in groups.values())
    drawn = results["mix"].collect()
    assert drawn and set(map(repr, drawn)) <= set(map(repr, before))
    sizes = Counter()
    for r in results["pack"].collect():
        sizes[r.doc_id] += r.length
    tokens = Counter()
    for r in before:
        tokens[r.doc_id] += len(plain(r.text or "")) // 4 + 1
    assert sizes == tokens


def test_stages_take_no_rows(spark):
    docs = strings(spark).where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0 and (name == "pack" or out.columns == docs.columns)


def test_run_is_the_stages(spark, tmp_path):
    folder = write(corpus(spark), tmp_path)
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_empty_corpus(spark, tmp_path):
    folder = write(corpus(spark).where("false"), tmp_path)
    assert corpus_pipeline.run(spark, folder).count() == 0


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_query_equals_its_sql(spark, name):
    import duckdb

    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for table in ("documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    result = con.execute(LLM_ORACLE[name])
    names = [c[0] for c in result.description]
    got = LLM_QUERIES[name](spark, str(folder))
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, result.fetchall()))


def test_cuts_let_the_driver_drop_what_queries_left(spark, monkeypatch):
    from panveil.llm import common

    collected = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    for write in (common.cut, lambda df: common.stored(df, "swept")):
        monkeypatch.setattr(common, "_swept_at", float("-inf"), raising=False)
        before = collected()
        assert write(spark.range(3)).count() == 3 and collected() == before + 1
        assert write(spark.range(3)).count() == 3 and collected() == before + 1  # not so soon again


def test_cuts_let_the_driver_return_what_it_freed_beside_its_heap(spark, monkeypatch):
    from panveil.llm import common

    pid = spark._jvm.java.lang.ProcessHandle.current().pid()

    def beside() -> int:
        """MB resident of the JVM's mappings but its heap, which lies at low addresses."""
        found = re.findall(r"^([0-9a-f]+)-\S+ .*\n(?:[A-Z]\w+: .*\n)*?Rss: +(\d+)", Path(f"/proc/{pid}/smaps").read_text(), re.M)
        return sum(int(kb) for at, kb in found if int(at, 16) >= 1 << 40) // 1024

    field = spark._jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    unsafe, size = field.get(None), 64 << 10  # such blocks stay with the C library when freed, if one behind them is in use
    for write in (common.cut, lambda df: common.stored(df, "swept")):
        monkeypatch.setattr(common, "_swept_at", float("-inf"))
        common._sweep(spark)
        blocks = [unsafe.allocateMemory(size) for _ in range(2400)]
        for b in blocks:
            unsafe.setMemory(b, size, 1)
        for b in blocks[:-1]:
            unsafe.freeMemory(b)
        before = beside()
        monkeypatch.setattr(common, "_swept_at", float("-inf"))
        assert write(spark.range(3)).count() == 3 and beside() < before - 75
        unsafe.freeMemory(blocks[-1])
