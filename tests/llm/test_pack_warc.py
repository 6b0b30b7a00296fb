import base64
import gzip
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.helpers import SCHEMA, awkward, empty, prose

from panveil.llm import pack, warc
from panveil.llm.queries import END_ID, tokenizer_path


@pytest.fixture(scope="module")
def encoder():
    return pack.Encoder(tokenizer_path(), cache=50)


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


LETTERS = "aBcdÀéßžŸſİΣς1٣½ªº_ '\t\n\r\x0b\x0c\x1c\x85\xa0 　́가<|>/w.,!?\U0001f600​中"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(LETTERS, max_size=30), st.sampled_from(["", "it's we'll I'm", "<|endoftext|> x", "a<|startoftext|>b", "...'s 12ab34"])), max_size=6))
def test_encoder_equals_the_tokenizer(encoder, plain, texts):
    assert encoder(pa.array(texts, pa.string())) == [plain(t) for t in texts]


def test_encoder_forgets_and_still_agrees(encoder, plain):
    rng = random.Random(1)
    for _ in range(8):
        texts = [prose(rng, 80) for _ in range(4)]
        assert encoder(pa.array(texts)) == [plain(t) for t in texts]


def test_other_tokenizers_are_encoded_whole():
    import public_tokenizers

    e = pack.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not e.by_piece
    ids = e.tokenizer.encode(" two  spaces", add_special_tokens=False).ids
    assert e(pa.array([" two  spaces"])) == [np.array(ids, dtype="<u4").tobytes()]


def check_packing(df, plain, length):
    out = pack.concatenate_and_cut(df, "doc_id", "text", tokenizer_path(), length, END_ID).collect()
    want = Counter((r.doc_id, plain(r.text or "") + END_ID.to_bytes(4, "little")) for r in df.collect())
    line = sorted(out, key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in line:  # gapless, and full but for the last
        assert (r.sequence_id, r.offset) == divmod(at, length)
        assert 0 < r.length == len(r.ids) // 4 and r.offset + r.length <= length
        at += r.length
    got, held = Counter(), b""
    for r in line:  # documents are whole, in one stretch
        assert r.start * 4 == len(held)
        held += bytes(r.ids)
        if len(held) == 4 * r.doc_tokens:
            got[(r.doc_id, held)] += 1
            held = b""
    assert not held and got == want


def test_packing_equals_brute_force(spark, plain):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, prose(rng, rng.randrange(400)), "en", "s") for i in range(150)], SCHEMA)
    for length in (1, 64, 2048):
        check_packing(df.limit(20) if length == 1 else df, plain, length)
    check_packing(awkward(spark), plain, 100)


def test_empty_packing(spark):
    assert pack.concatenate_and_cut(empty(spark), "doc_id", "text", tokenizer_path()).count() == 0


def brute_pages(rows, least):
    by_payload = {}
    for r in rows:
        by_payload.setdefault((r.html or "").encode(), []).append(r.page_id)
    out = Counter()
    for payload, ids in by_payload.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        best = max((i for i in ids if i is not None), default=None)
        name = None if best is None else str(best)
        rest = list(ids)
        if len(payload) >= least:
            rest.remove(best)
            out[(name, len(payload), digest, "response", None)] += 1
        for i in rest:
            revisit = len(payload) >= least
            out[(None if i is None else str(i), len(payload), digest, "revisit" if revisit else "response", name if revisit else None)] += 1
    return out


PAGES = [
    (1, "http://a/é?x=1 2", "<p>one</p>"), (2, "http://b", "<p>one</p>"), (2, "http://b", "<p>one</p>"), (3, None, None), (None, "", ""),
    (4, "http://c\r\nX: y", "\r\n\r\nWARC/1.1\r\n"), (None, "u", "only null"), (5, "u", "é\U0001f600 " * 50_000), (6, "%41", "\0\x01"),
]


def test_archives_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as kind", "2 as key", "3 as row")
    for least in (0, 10, 10**9):
        index = warc.write_archives(df, "page_id", "url", "html", min_revisit_bytes=least, segment_bytes=200)
        got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_selected(index).collect())
        assert got == brute_pages(df.collect(), least)
        some = index.where("page_id = '5'")
        assert [r.page_id for r in warc.read_selected(some).collect()] == ["5"]
    assert warc.read_selected(warc.write_archives(df.where("false"), "page_id", "url", "html")).count() == 0


def test_ids_of_any_kind(spark):
    rows = [("~", "u", "a"), ("=", "u", "b"), (None, "u", "c"), ("", "u", "d"), ("a b %", "u", "a"), ("~", "u", "a")]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    out = warc.read_selected(warc.write_archives(df, "page_id", "url", "html")).collect()
    assert Counter(r.page_id for r in out) == Counter(r[0] for r in rows)
    assert {(r.page_id, r.refers_to) for r in out if r.record_type == "revisit"} <= {("a b %", "~"), ("~", "~")}


def test_stores(spark, tmp_path):
    def in_folder(folder):
        from pyarrow import fs

        return fs.LocalFileSystem(), folder.partition("://")[2]

    assert warc.arrow_uri("s3a://bucket/a") == "s3://bucket/a"
    assert [warc.arrow_uri(f) for f in ("hdfs://n:8020/a", "file:///a", "file:/a", "/a")] == ["hdfs://n:8020/a", "file:///a", "file:///a", "file:///a"]
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    for folder in ("viewfs://n/a", "fake://x", "a/b"):
        with pytest.raises(ValueError):
            warc.write_archives(df, "page_id", "url", "html", folder=folder)
    index = warc.write_archives(df, "page_id", "url", "html", folder=f"fake://{tmp_path}/archives", open_store=in_folder)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_selected(index, open_store=in_folder).collect())
    assert got == brute_pages(df.collect(), 0) and list((tmp_path / "archives").glob("*.warc.gz"))


def test_records_are_whole_members(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    index = warc.write_archives(df, "page_id", "url", "html").collect()
    for path in {r.file for r in index}:
        data = gzip.decompress(open(path, "rb").read())
        assert data.count(b"WARC/1.1\r\nWARC-Type: ") == sum(r.file == path for r in index)
    spread = sorted((r.file, r.offset, r.length) for r in index)
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(spread, spread[1:]))


def test_ranges_are_coalesced():
    assert warc.coalesced([(50, 10), (0, 10), (10, 10), (200, 5)], gap=20, most=1000) == [(0, 20), (50, 60), (200, 205)]
    assert warc.coalesced([(0, 10), (10, 10), (20, 10)], gap=0, most=20) == [(0, 20), (20, 30)]
    assert warc.coalesced([]) == []


def test_damage_is_reported(spark):
    df = spark.createDataFrame([(1, "u", "payload " * 100)], "page_id long, url string, html string")
    index = warc.write_archives(df, "page_id", "url", "html")
    row = index.first()
    warc_record = warc.record("response", "=1 0", "u", b"other", 800, row.digest, "", "2026-01-01T00:00:00Z")
    with open(row.file, "wb") as f:
        f.write(warc_record)
    moved = index.selectExpr("page_id", "url", "digest", "file", "0L as offset", f"{len(warc_record)}L as length", "block", "folder")
    with pytest.raises(Exception, match="damaged"):
        warc.read_selected(moved).collect()
