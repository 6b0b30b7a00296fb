"""SQL functions, streams, sources and the driver contract."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from panveil.functions import brand, count_runs, first_digits, group4, hero, luhn_ok, mask_number, mask_runs
from panveil.operators import mask_columns, run_inventory
from panveil.plans.queries import ORACLE, QUERIES
from panveil.plans.sqlfuncs import register
from panveil.sources import read_shares, read_texts, write_masked
from panveil.streaming import mask_stream, text_stream

ROOT = Path(__file__).resolve().parent.parent
TEXTS = ["4111111111111111 and 378282246310005", "x 4111-1111-1111-1111", "55", "12 34", "", None, "$ 6011000990139424 \\", "٤٢ 2221000000000009", "٥١ 11", "٢٢٢١", "٣٤"]


def test_sql_functions_equal_the_columns(spark):
    register(spark)
    spark.createDataFrame([(t,) for t in TEXTS], "t string").createOrReplaceTempView("sql_texts")
    got = spark.sql(
        "SELECT pan_mask(t, '$', 6, 4), pan_mask_runs(t, '$', 6, 4), pan_count(t), pan_first_digits(t), pan_brand(t), pan_luhn(t), pan_group4(t), pan_hero(t), pan_mask(t, 'ab', 6, 4), pan_mask_runs(t, '7', 6, 4) FROM sql_texts"
    ).collect()
    want = spark.table("sql_texts").select(mask_number("t", "$", 6, 4), mask_runs("t", "$", 6, 4), count_runs("t"), first_digits("t"), brand("t"), luhn_ok("t"), group4("t"), hero("t"), F.lit(None), F.lit(None)).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("pay 4111111111111111 now\nnothing\n")
    stream = text_stream(spark, str(tmp_path / "in"))
    mask_stream(stream, ["text"], str(tmp_path / "out"), str(tmp_path / "ck"), "FIRST6_LAST4").awaitTermination(60)
    batch = mask_columns(read_texts(spark, str(tmp_path / "in")), ["text"], "FIRST6_LAST4")
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(r.text for r in batch.collect())


def test_shares_and_sinks(spark, tmp_path):
    (tmp_path / "s.json").write_text("\n".join(json.dumps(x) for x in (
        {"action": "android.intent.action.SEND", "mime": "text/plain", "payload": "a"},
        {"action": "android.intent.action.SEND", "mime": "image/png", "payload": "b"},
        {"action": "android.intent.action.PROCESS_TEXT", "mime": None, "payload": "c"},
    )))
    df = read_shares(spark, str(tmp_path / "s.json"))
    assert [r.text for r in df.orderBy("payload").collect()] == ["a", None, "c"]
    for fmt in ("parquet", "json", "orc", "csv"):
        write_masked(df, str(tmp_path / fmt), fmt)
        assert spark.read.format(fmt).load(str(tmp_path / fmt)).count() == 3
    write_masked(df.select(mask_runs(F.lit(TEXTS[0])).alias("text")).limit(1), str(tmp_path / "text"), "text")
    assert [r.text for r in read_texts(spark, str(tmp_path / "text")).collect()] == ["************1111 and ***********0005"]


def test_inventory(spark):
    rows = run_inventory(spark.createDataFrame([(1, TEXTS[0]), (2, None), (3, "")], "id long, t string"), "t", ["id"]).collect()
    assert [(r.id, r.run_no, r.brand, r.luhn) for r in rows] == [(1, 0, "VISA", True), (1, 1, "AMEX", True)]


def test_no_python_and_no_shuffle_in_the_plans(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    plan = df.select(mask_number("t"), mask_runs("t"), luhn_ok("t"), brand("t"), F.lit(1))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    import duckdb

    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for table in ("documents", "pages", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got = QUERIES[name](spark, str(folder))
    result = con.execute(ORACLE[name])
    names = [c[0] for c in result.description]
    want = result.fetchall()
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, want))


def test_imports_without_llm(tmp_path):
    for name in ("panveil", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name)
    hide = "import sys\nclass H:\n    def find_spec(self, name, *a):\n        if name.startswith('panveil.llm'): raise ModuleNotFoundError(name=name)\nsys.meta_path.insert(0, H())\nimport __spark_entry__ as e; assert e.queries() and not [q for q in e.queries() if q.startswith('op')]"
    assert subprocess.run([sys.executable, "-c", hide], cwd=tmp_path).returncode == 0
