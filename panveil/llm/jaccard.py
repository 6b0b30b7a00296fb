"""N-gram Jaccard join by chosen paths: split on sampled shared tokens, compare small buckets, repeat for recall."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panveil.llm.common import col, cut, row_key, running, sifted, stored, whole

SIGNATURE = 64  # sampled tokens of a set, 32 bits each
BUCKET = 512  # sets that are compared with one another at most
SAMPLE = 16  # sets of a larger bucket, about, of which its centre is made
CHILDREN = 3  # sampled tokens that a set follows out of a bucket that is too large
TRIED = 48  # sets of a bucket, about, of which the places to split it by are found
DEPTH = 12  # splits of a bucket, after which its blocks are compared in pairs
HEAVY = 16 << 20  # tokens of the whole sets that a task holds for a group, about; sets are dealt by hash and kept whole
_BATCH_BYTES = 8 << 20


def runs_for(recall: float, threshold: float, levels: int = 3) -> int:
    """Runs after which a pair at the threshold has met with this probability, if its buckets split levels - 1 times.

    Buckets split where their sets differ most, and there a pair agrees less often than it does on the whole: in three
    cases of four is the reckoning.
    """
    once = threshold * (1 - (1 - 0.75 * threshold) ** CHILDREN) ** (levels - 1)
    return math.ceil(math.log(1 - recall) / math.log(1 - once))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles.

    Words lie between ASCII white space, A-Z in lower case. A text of fewer words than width has one shingle of all
    of them, and a text without words has none.
    """
    import xxhash

    by_text = pc.split_pattern_regex(pc.utf8_trim(pc.ascii_lower(texts), " \t\n\x0b\x0c\r"), "[\\x20\\x09-\\x0D]+")
    words = by_text.flatten().dictionary_encode()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.dictionary.to_pylist()), dtype=np.uint64, count=len(words.dictionary))
    sequence = hashes[words.indices.to_numpy()]
    ends = by_text.offsets.to_numpy()
    empty = pc.equal(pc.binary_length(pc.utf8_trim(texts, " \t\n\x0b\x0c\r")), 0).to_pylist()
    for i, j, none in zip(ends[:-1].tolist(), ends[1:].tolist(), empty, strict=True):
        own = sequence[i:j]
        if none:
            yield own[:0]
            continue
        n = max(len(own) - width + 1, 1)
        out = np.zeros(n, dtype=np.uint64)
        for k in range(min(width, len(own))):
            out = _mixed(out * np.uint64(31) + own[k : k + n])
        yield np.unique(out)


def _hashers() -> tuple[np.ndarray, np.ndarray]:
    seeds = _mixed(np.arange(1, 2 * SIGNATURE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:SIGNATURE] | np.uint64(1), seeds[SIGNATURE:]


def signature(tokens: np.ndarray) -> bytes:
    """For each of the sampled orders of all tokens, 32 bits that tell which token of the set comes first."""
    a, b = _hashers()
    least = np.full(SIGNATURE, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(tokens), 4096):
        least = np.minimum(least, (tokens[None, i : i + 4096] * a[:, None] + b[:, None]).min(axis=1))
    return (_mixed(least) >> np.uint64(32)).astype("<u4").tobytes()


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    sizes, begin, held = pc.binary_length(batch.column(column)).to_pylist(), 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > _BATCH_BYTES:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if batch.num_rows:
        yield batch.slice(begin)
    pa.default_memory_pool().release_unused()  # the next stage may have other needs


def _sketches(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """row, row_key, doc_id, set (16 bytes that tell sets apart), n (its size), sketch."""
    rows = df.select(row_key(df).alias("row_key"), col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("set", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType())])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, 2):
                ids, sizes, sketches = [], [], []
                for s in shingle_sets(piece.column(2), width):
                    ids.append(np.array([s.sum(dtype=np.uint64), _mixed(s).sum(dtype=np.uint64)], dtype="<u8").tobytes())
                    sizes.append(len(s))
                    sketches.append(signature(s))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())], names=["row_key", "doc_id", "set", "n", "sketch"])

    return cut(rows.mapInArrow(sketch, schema).withColumn("row", F.monotonically_increasing_id()))


def _token(sketch: Column, place: Column) -> Column:
    return F.substr(sketch, (place * 4 + 1).cast("int"), F.lit(4))


def _spots(large: DataFrame, sets: DataFrame) -> DataFrame:
    """bucket, spots: the places of sketches by which a bucket splits, those with the least common tokens; none if it is dense.

    How common a place's commonest token is, is told by a sample of the bucket. A bucket is dense if that token's sets
    would make as many again over all places, so that splitting would only multiply the sets of large buckets: most of
    its sets are alike.
    """
    some = large.where(F.expr(f"pmod(xxhash64(bucket, set), greatest(size div {TRIED}, 1)) = 0")).select("bucket", "set").join(sets.select("set", "sketch"), "set")
    tokens = F.transform(F.sequence(F.lit(0), F.lit(SIGNATURE - 1)), lambda p: _token(F.col("sketch"), p))
    # A bucket's sample is small, so all three counts of it are made where it lies.
    counts = some.select("bucket", F.posexplode(tokens).alias("spot", "token")).repartition("bucket").groupBy("bucket", "spot", "token").agg(F.count("*").alias("n"))
    common = counts.groupBy("bucket", "spot").agg((F.max("n") / F.sum("n")).alias("share")).withColumn("tie", F.xxhash64("bucket", "spot"))
    ranked = common.groupBy("bucket").agg(F.slice(F.sort_array(F.collect_list(F.struct("share", "tie", "spot"))), 1, CHILDREN).alias("best"))
    dense = F.aggregate("best", F.lit(0.0), lambda a, x: a + x["share"]) >= 1
    return cut(ranked.select("bucket", F.when(~dense, F.transform("best", lambda x: x["spot"])).alias("spots")))


def _buckets(sets: DataFrame, runs: int) -> DataFrame:
    """bucket, set, size: where sets meet, and how many do. A bucket that splitting would hardly make smaller stays whole."""
    first = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.xxhash64(r, _token(F.col("sketch"), r)))
    keys = sets.where("n > 0").select("set", F.explode(first).alias("bucket"))
    done = []
    for level in range(DEPTH + 1):
        sizes = cut(keys.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
        met = cut(keys.join(sizes, "bucket")).select("bucket", "set", "size")
        done.append(met.where(F.col("size") <= BUCKET))
        large = met.where(F.col("size") > BUCKET)
        if level == DEPTH or large.isEmpty():
            break
        # All sets of a bucket follow the same places, so two that share a token there stay together.
        large = cut(large.join(_spots(large, sets), "bucket", "left"))
        done.append(large.where("spots IS NULL").select("bucket", "set", "size"))
        children = F.transform("spots", lambda p: F.xxhash64(F.col("bucket"), p, _token(F.col("sketch"), p)))
        keys = large.where("spots IS NOT NULL").join(sets.select("set", "sketch"), "set").select("set", F.explode(children).alias("bucket"))
        large = large.where("false").select("bucket", "set", "size")
    return cut(_union([*done, large]))


def _meetings(buckets: DataFrame, zones: DataFrame | None) -> DataFrame:
    """group, bucket, set, block, across: sets to compare, BUCKET or so at most in a group.

    The sets of a larger bucket lie in blocks, each two of which meet in a group, where only sets of different blocks are
    compared. zones says what is known of a set in a bucket, and blocks are of sets of which the same is known: those of
    a class are linked to one another as it is, and don't meet, nor do those near a bucket's centre and those far from it.
    """
    half = BUCKET // 2
    few = buckets.where(F.col("size") <= BUCKET).select(F.col("bucket").alias("group"), "bucket", "set", F.lit(0).cast("long").alias("block"), F.lit(False).alias("across"))
    if zones is None:
        return few
    kind = F.when(F.col("near") & F.col("class").isNotNull(), F.col("class")).when(F.col("far"), F.lit(b"far")).otherwise(F.lit(b"any"))
    own = buckets.where(F.col("size") > BUCKET).join(zones, ["bucket", "set"], "left").select("bucket", "set", kind.alias("kind"))
    kinds = own.groupBy("bucket", "kind").agg(F.count("*").alias("n"))
    # Few sets of a class are not worth blocks of their own; any sets may meet all others.
    kinds = cut(kinds.withColumn("tribe", F.when((F.length("kind") > 3) & (F.col("n") < half // 2), F.lit(b"any")).otherwise(F.col("kind"))))
    tribes = kinds.groupBy("bucket", "tribe").agg(F.ceil(F.sum("n") / half).alias("blocks"))
    blocks = tribes.select("bucket", "tribe", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("of")).withColumn("block", F.xxhash64("tribe", "of"))
    low, high = blocks.select("bucket", F.col("tribe").alias("one"), F.col("block").alias("low")), blocks.select("bucket", F.col("tribe").alias("other"), F.col("block").alias("high"))
    named = lambda c: F.length(c) > 3
    idle = (named("one") & (F.col("one") == F.col("other"))) | (named("one") & (F.col("other") == F.lit(b"far"))) | ((F.col("one") == F.lit(b"far")) & named("other"))
    met = low.join(high, "bucket").where((F.col("low") <= F.col("high")) & ~idle).withColumn("group", F.xxhash64("bucket", "low", "high"))
    ends = F.when(F.col("low") == F.col("high"), F.array("low")).otherwise(F.array("low", "high"))
    met = met.select("group", "bucket", F.explode(ends).alias("block"), (F.col("low") != F.col("high")).alias("across"))
    placed = own.join(kinds, ["bucket", "kind"]).join(tribes, ["bucket", "tribe"])
    placed = placed.select("bucket", "set", F.xxhash64("tribe", F.expr("pmod(xxhash64(set), blocks)")).alias("block"))
    return few.unionByName(placed.join(met, ["bucket", "block"]).select("group", "bucket", "set", "block", "across"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _halls(needed: DataFrame) -> DataFrame:
    """group, set, hall, part, cross: where the whole sets of a group are compared.

    A group of more than HEAVY tokens is dealt to parts of half of that, and each two parts meet in a hall, where only
    sets of different parts are compared; any other group is a hall.
    """
    heavy = cut(needed.groupBy("group").agg(F.sum("n").alias("load")).where(F.col("load") > HEAVY))
    own = needed.join(heavy, "group", "left").withColumn("parts", F.coalesce(F.ceil(F.col("load") * 2 / HEAVY), F.lit(1)).cast("int"))
    own = own.withColumn("part", F.expr("cast(pmod(xxhash64(group, set), parts) as int)")).withColumn("with", F.explode(F.expr("sequence(0, parts - 1)")))
    low, high = F.least("part", "with"), F.greatest("part", "with")
    return own.select("group", "set", F.when(F.col("parts") == 1, F.col("group")).otherwise(F.xxhash64("group", low, high)).alias("hall"), "part", (low != high).alias("cross"))


def _bins(loads: DataFrame, key: str) -> DataFrame:
    """key and bin: keys in as many bins as there are shuffle partitions, of about the same load each.

    So no task gets several large groups, as it might by hash. A bin has more than its share by a group at most.
    """
    n = max(1, int(loads.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = running(loads, [], [key], "load", "before")
    total = placed.agg(F.max(F.col("before") + F.col("load"))).first()[0] or 1
    return placed.select(key, F.least(F.expr(f"before * {n} div {total}"), F.lit(n - 1)).cast("int").alias("bin"))


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows, which have a bin, one task for each bin and sorted by key."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartitionById(n, F.col("bin")).drop("bin").sortWithinPartitions(key)


def _groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[list[dict]]:
    """Rows that meet, of batches sorted by where they do."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[by] != held[0][by]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _agreement(threshold: float) -> int:
    """Places in which two sketches have to agree: four standard deviations less than a pair at the threshold does."""
    return math.floor(SIGNATURE * threshold - 4 * math.sqrt(SIGNATURE * threshold * (1 - threshold)))


def _likely(rows: list[dict], threshold: float, least: int) -> Iterator[tuple[int, int]]:
    """Pairs of a group that are likely to be similar and that no other bucket is to report.

    Of the buckets in which two sets meet, the one with the least number reports them. Sets of one class are known to be
    similar, and are no pairs.
    """
    names = {None: 0}
    classes = np.array([names.setdefault(r["class"], len(names)) for r in rows])
    tokens = np.frombuffer(b"".join(r["sketch"] for r in rows), dtype="<u4").reshape(len(rows), SIGNATURE)
    sizes = np.array([r["n"] for r in rows], dtype=np.float64)
    homes, bucket = [frozenset(r["buckets"]) for r in rows], rows[0]["bucket"]
    apart = [np.array([r[side] for r in rows]) for side, parted in (("block", "across"), ("part", "cross")) if rows[0].get(parted)]
    for i in range(len(rows) - 1):
        fits = (tokens[i + 1 :] == tokens[i]).sum(axis=1) >= least
        fits &= np.minimum(sizes[i + 1 :], sizes[i]) >= threshold * np.maximum(sizes[i + 1 :], sizes[i]) - 1e-9
        if classes[i]:
            fits &= classes[i + 1 :] != classes[i]
        for sides in apart:
            fits &= sides[i + 1 :] != sides[i]
        for j in (np.flatnonzero(fits) + i + 1).tolist():
            if min(homes[i] & homes[j]) == bucket:
                yield i, j


def _whole_sets(df: DataFrame, text_col: str, wanted: DataFrame, width: int) -> DataFrame:
    """set and tokens (its shingles, 64 bits each) for the sets in wanted, each by the row_key of a row that has it.

    Rows that can't be wanted are left out before texts are shuffled.
    """
    wanted = cut(wanted)
    read = df.select(row_key(df).alias("row_key"), whole(text_col).alias("text"))
    some = sifted(read, F.col("row_key.a"), wanted.select(F.col("row_key.a").alias("h"))).groupBy("row_key").agg(F.first("text").alias("text"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, 1):
                found = [s.tobytes() for s in shingle_sets(piece.column(1), width)]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(found, pa.binary())], names=["set", "tokens"])

    return some.join(wanted, "row_key").select("set", "text").mapInArrow(tokens, "set binary, tokens binary")


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _centres(sample: DataFrame) -> DataFrame:
    """bucket, centre (its name), tokens: those that more than half of a bucket's sampled sets hold.

    Buckets of the same near copies mostly come to the same centre, and centres of the same tokens have the same name.
    """

    def middle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "bucket"):
            every, counts = np.unique(np.concatenate([np.frombuffer(r["tokens"], dtype=np.uint64) for r in rows]), return_counts=True)
            held = every[2 * counts > len(rows)]
            if len(held):
                name = np.array([held.sum(dtype=np.uint64), _mixed(held).sum(dtype=np.uint64)], dtype="<u8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([rows[0]["bucket"]], pa.int64()), pa.array([name], pa.binary()), pa.array([held.tobytes()], pa.binary())], names=["bucket", "centre", "tokens"])

    return cut(sample.select("bucket", "tokens").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(middle, "bucket long, centre binary, tokens binary"))


def _zones(around: DataFrame, centres: DataFrame, tokens: DataFrame, threshold: float) -> DataFrame:
    """set, centre, near, far for each set and centre in around.

    Say a set lacks a of a centre's c tokens and has b others. With a' and b' of another set, the two share c - a - a' tokens
    at least and have c + b + b' at most, so they are linked if a + a' + threshold * (b + b') <= (1 - threshold) * c. A set
    is near if its own terms make up no more than half of that: any two that are near are linked. Their Jaccard
    distance from the centre is then (1 - threshold) / (1 + threshold) at most, and that being a metric, a set
    farther from it by all that a link may bridge is far: it is linked to none that is near.

    The sets of a centre are dealt to parts of about BUCKET, and a copy of the centre goes first in each part.
    """
    parts = around.groupBy("centre").agg(F.ceil(F.count("*") / BUCKET).alias("parts"))
    sets = around.join(parts, "centre").select("centre", F.expr("pmod(xxhash64(set), parts)").alias("part"), "set").join(tokens, "set")
    firsts = centres.groupBy("centre").agg(F.first("tokens").alias("tokens")).join(parts, "centre")
    firsts = firsts.select("centre", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), F.lit(None).cast("binary").alias("set"), "tokens")
    rows = sets.select("centre", "part", "set", "tokens").unionByName(firsts).repartition("centre", "part").sortWithinPartitions("centre", "part", "set")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        bridge = (1 - threshold) + (1 - threshold) / (1 + threshold) + 1e-9
        for batch in batches:
            out = []
            for centre, name, data in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                own = np.frombuffer(data, dtype=np.uint64)
                if name is None:  # nulls are sorted first
                    held = own
                    continue
                common = _shared(own, held)
                lacks, others = len(held) - common, len(own) - common
                near = lacks + threshold * others <= (1 - threshold) * len(held) / 2 + 1e-9
                out.append((name, centre, near, lacks + others > bridge * (len(held) + others)))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            kinds = (pa.binary(), pa.binary(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["set", "centre", "near", "far"])

    return cut(rows.mapInArrow(measure, "set binary, centre binary, near boolean, far boolean"))


def _classes(df: DataFrame, text_col: str, sets: DataFrame, buckets: DataFrame, width: int, threshold: float) -> tuple[DataFrame, DataFrame] | None:
    """Of sets in buckets of more than BUCKET: (set, class), and (bucket, set, near, far, class). None without such buckets.

    All sets near a centre are a class, linked to one another without a comparison, whatever the centre is; a good one
    makes a large class. A set near several is in the largest.
    """
    big = cut(buckets.where(F.col("size") > BUCKET))
    if big.isEmpty():
        return None
    tokens = stored(_whole_sets(df, text_col, big.select("set").distinct().join(sets.select("set", "row_key"), "set"), width), "sets")
    sample = big.where(F.expr(f"pmod(xxhash64(bucket, set), greatest(size div {SAMPLE}, 1)) = 0"))
    centres = _centres(sample.join(tokens, "set"))
    around = cut(big.join(centres.select("bucket", "centre"), "bucket").select("bucket", "set", "centre"))
    known = _zones(around.select("set", "centre").distinct(), centres, tokens, threshold)
    sizes = known.where("near").groupBy("centre").agg(F.count("*").alias("n"))
    classes = known.where("near").join(sizes, "centre").groupBy("set").agg(F.max(F.struct("n", "centre")).alias("best"))
    classes = cut(classes.select("set", F.col("best.centre").alias("class")))
    zones = around.join(known, ["set", "centre"]).join(classes, "set", "left")
    return classes, zones.select("bucket", "set", "near", "far", "class")


def _links(df: DataFrame, text_col: str, sets: DataFrame, buckets: DataFrame, width: int, threshold: float) -> DataFrame:
    """set, linked, root: for each group with links of a set, the rows it is linked to and one set it is connected to.

    Classes of large buckets are linked as a whole. Of other pairs, sketches first tell which sets have likely partners in
    a group. Only their texts are read again and go to that group's halls, where the pairs are verified by the whole sets.
    Pairs are counted where they are found and never written: a group gives a row for each of its sets.
    """
    least = _agreement(threshold)
    homes = buckets.groupBy("set").agg(F.collect_set("bucket").alias("buckets"))
    found = _classes(df, text_col, sets, buckets, width, threshold)
    classes, zones = found or (None, None)
    known = sets.join(homes, "set").select("set", "n", "sketch", "copies", "row_key", "buckets")
    known = cut(known.join(classes, "set", "left") if found else known.withColumn("class", F.lit(None).cast("binary")))
    meetings = cut(_meetings(buckets, zones))
    columns = ["group", "bucket", "set", "block", "across", "n", "sketch", "buckets", "class"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in (("group", pa.int64()), ("set", pa.binary()), ("n", pa.int64()))], names=["group", "set", "n"])

        for rows in _groups(batches, "group"):
            if len(rows) > 1:
                out += [rows[k] for k in {k for pair in _likely(rows, threshold, least) for k in pair}]
            if len(out) >= 10_000:
                yield batch()
                out = []
        yield batch()

    bins = _bins(meetings.groupBy("group").agg(F.count("*").alias("load")), "group")
    sketched = meetings.join(bins, "group").join(known.select("set", "n", "sketch", "buckets", "class"), "set").select(*columns, "bin")
    needed = cut(_dealt(sketched, "group").mapInArrow(find, "group long, set binary, n long"))
    tokens = _whole_sets(df, text_col, needed.select("set").distinct().join(known.select("set", "row_key"), "set"), width)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "hall"):
            full = [np.frombuffer(r["tokens"], dtype=np.uint64) for r in rows]
            linked, root = [0] * len(rows), list(range(len(rows)))
            for i, j in _likely(rows, threshold, least):
                common = _shared(full[i], full[j])
                if common >= threshold * (len(full[i]) + len(full[j]) - common) - 1e-9:
                    linked[i] += rows[j]["copies"]
                    linked[j] += rows[i]["copies"]
                    while root[i] != root[root[i]]:
                        root[i] = root[root[i]]
                    while root[j] != root[root[j]]:
                        root[j] = root[root[j]]
                    low, high = sorted((root[i], root[j]))
                    root[high] = low
            some = [k for k, n in enumerate(linked) if n]
            yield pa.RecordBatch.from_arrays([pa.array([rows[k]["set"] for k in some], pa.binary()), pa.array([linked[k] for k in some], pa.int64()), pa.array([rows[root[k]]["set"] for k in some], pa.binary())], names=["set", "linked", "root"])

    halls = cut(_halls(needed).join(needed.select("group", "set", "n"), ["group", "set"]))
    load = F.col("n") + 1024  # tokens, and something for each set
    bins = _bins(halls.groupBy("hall").agg(F.sum(load).alias("load")), "hall")
    asked = meetings.join(halls.drop("n").join(bins, "hall"), ["group", "set"]).join(known.select("set", "n", "sketch", "buckets", "copies", "class"), "set")
    rows = asked.join(tokens, "set").select(*columns, "hall", "part", "cross", "copies", "tokens", "bin")
    links = cut(_dealt(rows, "hall").mapInArrow(verify, "set binary, linked long, root binary"))
    if not found:
        return links
    members = known.where(F.col("class").isNotNull())
    sums = cut(members.groupBy("class").agg(F.sum("copies").alias("rows"), F.min("set").alias("root")))
    return links.unionByName(cut(members.join(sums, "class").select("set", (F.col("rows") - F.col("copies")).alias("linked"), "root").where("linked > 0")))


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, label for each node of a link: label is the least node of its component.

    Large stars and small stars in turn: each round, nodes link to the least neighbour they know of. Rounds grow as
    the logarithm of a component's size; each is cut, so a lost executor repeats one at most.
    """
    edges, before = links.where("a != b"), None
    for _ in range(most_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))  # a cut, so that a hub's links split over tasks
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        small = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(joined.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = cut(small.where("a != b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()


def similar(df: DataFrame, id_col: str, text_col: str, width: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """One row for each input row: doc_id, class_id, copy_id, n_links, class_size, kept, row_key.

    Two rows are linked if the sets of their width-word shingles have a Jaccard similarity of threshold or more, by
    the whole sets. Rows with equal sets are copies and share copy_id, their least id; only one of them takes part in
    the join. class_id is the least id of those connected by links, n_links counts the other rows that a row is
    linked to itself, copies included, class_size those of its class, and kept marks one row of each class, that
    with the least id.

    A set's sketch samples its tokens by 64 random orders. In each run every set goes to the bucket of one sampled
    token; buckets of more than 512 sets split by further ones, each set along three of them, until they are small or
    splitting hardly parts them, or twelve times. In what is still large, sets near a centre are a class that is known to be
    linked throughout, and all others are compared block by block. So no bucket is left out or cut short. Pairs whose sketches
    agree, within four standard deviations, are verified. runs_for(recall, threshold) gives the runs: a pair
    at the threshold is found with that probability, a more similar one with a greater one.

    Texts of fewer words than width have one shingle, all of their words. Texts without words, nulls too, are copies
    of one another. Null ids are never the least unless there is no other. No rows, no result.
    """
    rows = _sketches(df, id_col, text_col, width)
    sets = cut(rows.groupBy("set").agg(F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row_key")).alias("one"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).select("set", "copies", "n", "sketch", "one", F.col("one.row_key").alias("row_key")))
    links = _links(df, text_col, sets, _buckets(sets, runs_for(recall, threshold)), width, threshold)
    labels = components(links.select(F.col("set").alias("a"), F.col("root").alias("b")))
    linked = links.groupBy("set").agg(F.sum("linked").alias("linked"))
    named = sets.select("set", "copies", "one").join(labels.withColumnRenamed("node", "set"), "set", "left").join(linked, "set", "left")
    named = cut(named.select("set", "copies", "one", F.coalesce("label", "set").alias("label"), F.coalesce("linked", F.lit(0)).alias("linked")))
    classes = cut(named.groupBy("label").agg(F.min("one").alias("best"), F.sum("copies").alias("class_size")))  # as in components, for a large class
    known = named.join(classes, "label").select("set", (F.col("linked") + F.col("copies") - 1).alias("n_links"), F.col("one.doc_id").alias("copy_id"), "best", "class_size")
    firsts = rows.groupBy("set", "row_key").agg(F.min("row").alias("first"))
    chosen = known.join(firsts, (firsts["set"] == known["set"]) & (F.col("row_key") == F.col("best.row_key"))).select(known["set"], "first")
    marked = cut(known.join(chosen, "set", "left"))
    return rows.select("set", "doc_id", "row_key", "row").join(marked, "set").select(
        "doc_id", F.col("best.doc_id").alias("class_id"), "copy_id", "n_links", "class_size", F.coalesce(F.col("row") == F.col("first"), F.lit(False)).alias("kept"), "row_key"
    )
