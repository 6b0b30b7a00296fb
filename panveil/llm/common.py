"""What the operators share: durable cuts of lineage, row keys, exact ranks, and small array helpers.

Operators read each input column under a name of their own and never by position, so extra columns of any name in
the input neither clash nor pass through.
"""

from __future__ import annotations

import atexit
import gc
import logging
import math
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Of the map of bits by which rows are sifted: 16 MiB.
FILTER_BITS = 1 << 27
#: Seconds between two sweeps of the driver at least.
SWEEP_S = 5.0

_written: list[tuple[SparkSession, str]] = []
_swept_at = -math.inf


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's if that is unset.

    Without either, a temporary folder serves where driver and executors are one process; anywhere else it is an error,
    since a folder of the driver's own is out of the executors' reach.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files are deleted when it is done, and not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _trim(spark: SparkSession) -> None:
    """Has the driver's JVM return to the system what it has freed beside its heap, where it has a command for that.

    Compilers, threads and buffers take that from the C library, which keeps it in a pool for each of many threads.
    """
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    of = jvm.java.lang.Class.forName
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    kinds, given = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = of(kind)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:  # by the interface, as the server's own class is none that others may call
        of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, given)
    except Py4JJavaError:
        logging.getLogger(__name__).debug("this JVM can't trim its native heap", exc_info=True)


def _sweep(spark: SparkSession) -> None:
    """Has the driver give back what its queries so far have left, once in SWEEP_S at most.

    Operators of many cuts make plans, task metrics and statuses faster than a driver collects them of itself: it takes
    all of its heap first, on top of what compiled plans and threads take beside it, and keeps it.
    """
    global _swept_at
    if time.monotonic() - _swept_at < SWEEP_S:
        return
    gc.collect()  # Python's handles keep objects of the driver's JVM alive
    spark._jvm.System.gc()
    _trim(spark)
    _swept_at = time.monotonic()


def cut(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the shared folder: computed once, safe when executors are lost."""
    shared_dir(df.sparkSession)
    with _tidy(df.sparkSession):
        out = df.select("*").checkpoint()
    _written.append((df.sparkSession, out._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()))
    _sweep(df.sparkSession)
    return out


def new_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; release() deletes it."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows as a compressed table in the shared folder, for those too large for a plain checkpoint."""
    path = new_path(df.sparkSession, what)
    with _tidy(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    _sweep(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Deletes the tables, checkpoints and archives that operators wrote; their results can't be read any more after that.

    One that can't be deleted is logged and the others go on. Those of a session that has stopped stay where they are.
    """
    while _written:
        spark, path = _written.pop()
        if spark.sparkContext._jsc is None:
            continue
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:
            logging.getLogger(__name__).warning("%s was not deleted", path, exc_info=True)


atexit.register(release)


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def whole(name: str) -> Column:
    """A text column, null as empty."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates value once for any number of uses in body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hash128(*cols: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes with different seeds, nulls told apart."""
    marked = [x for c in cols for x in (c, c.isNull())]
    return F.xxhash64(F.lit(1), *marked), F.xxhash64(F.lit(2), *marked)


def row_key(df: DataFrame) -> Column:
    """A 128-bit key of a whole row. Rows that are equal in every column share it, and nothing tells those apart.

    Columns that hold a map or a variant, at any depth, count by their JSON, as Spark doesn't hash them.
    """
    a, b = hash128(*(F.to_json(F.struct(col(n))) if "map<" in kind or "variant" in kind else col(n) for n, kind in df.dtypes))
    return F.struct(a.alias("a"), b.alias("b"))


def sifted(df: DataFrame, hash_of: Column, keys: DataFrame) -> DataFrame:
    """The rows of df whose 64-bit hash is in column h of keys, and a few others; for use before a shuffle of wide rows.

    keys have to be cut, and set a bit each of a map of 16 bits a key or more and FILTER_BITS at most. That is 16 MiB, which
    is what is broadcast at most. Many more keys than an eighth of that let more rows through, but none is ever lost.
    """
    page = 15  # bits of the place within a bitmap
    bits = min(FILTER_BITS, 1 << max(page, math.ceil(math.log2(16 * max(1, keys.count())))))
    # Made of expressions that are never null, so that the join doesn't work out wide columns once more to look for nulls.
    spot = lambda h: h.bitwiseAND(F.lit(bits - 1).cast("long"))
    within = lambda s: s.bitwiseAND(F.lit((1 << page) - 1).cast("long"))
    found = keys.select(spot(F.col("h")).alias("s")).groupBy(F.shiftright("s", page).alias("_page")).agg(F.bitmap_construct_agg(within(F.col("s"))).alias("_bits"))
    placed = df.withColumn("_spot", spot(hash_of)).join(F.broadcast(found), F.shiftright("_spot", page) == F.col("_page"))
    at = within(F.col("_spot")).cast("int")
    byte = F.conv(F.hex(F.substr("_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return placed.where(F.getbit(byte, at % 8) == 1).drop("_spot", "_page", "_bits")


def prefix_sums(values: Column) -> Column:
    """Running sums of an array of longs, each without its own term, plus the total as the last item.

    Works in blocks, so that the copies of arrays that it makes stay small beside the array.
    """
    block = 256
    grow = lambda xs: F.aggregate(xs, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def sums(xs: Column) -> Column:
        n = F.size(xs)
        heads = F.sequence(F.lit(0), F.greatest(F.ceil(n / block).cast("int") - 1, F.lit(0)))
        inner = F.transform(heads, lambda b: grow(F.slice(xs, b * block + 1, block)))
        return let(inner, lambda parts: let(
            grow(F.transform(parts, lambda p: F.element_at(p, -1))),
            lambda at: F.concat(
                F.flatten(F.zip_with(parts, F.slice(at, 1, F.size(parts)), lambda p, o: F.transform(F.slice(p, 1, F.size(p) - 1), lambda x: x + o))),
                F.array(F.element_at(at, -1)),
            ),
        ))

    return let(values, sums)


def ranked(df: DataFrame, keys: Sequence[str], out: str, group: str | None = None) -> DataFrame:
    """The rows with their 0-based rank in the order of keys, within group if given (keys then begin with it).

    No group meets in one task: rows are sorted by ranges of all keys, and a count for each range and group, a few
    rows each, gives where its ranks begin. The keys have to be unique for the ranks to be defined.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    by = ["_part", group] if group else ["_part"]
    counts = placed.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    if group:
        before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return placed.join(starts, by).withColumn(out, F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def running(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """The rows with the sum of value over those before them in their group, in an order that has to be unique.

    As in ranked, no group meets in one task: a sum for each range and group gives where the sums of a range begin.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(df.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*group, "_part").agg(F.sum(value).alias("_sum"))
    starts = starts.withColumn("_before", F.coalesce(F.sum("_sum").over(before(Window.partitionBy(*group).orderBy("_part"))), F.lit(0))).drop("_sum")
    inside = placed.withColumn(out, F.coalesce(F.sum(value).over(before(Window.partitionBy(*group, "_part").orderBy(*order))), F.lit(0)))
    return inside.join(starts, [*group, "_part"]).withColumn(out, F.col(out) + F.col("_before")).drop("_part", "_before")
