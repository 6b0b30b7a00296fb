"""WARC archives, index first: write records and their places, then read selected ones by sorted byte ranges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panveil.llm.common import col, cut, new_path, stored, whole

INDEX = "page_id string, url string, digest string, file string, offset long, length long, block long"
PAGES = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"
BLOCK = 8 << 20
#: Schemes of Hadoop's connectors, and those under which pyarrow opens the same stores.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "s3": "s3", "gs": "gs", "gcs": "gs", "hdfs": "hdfs", "file": "file", "abfs": "abfs", "abfss": "abfss"}
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def arrow_uri(folder: str) -> str:
    """The folder as a URI for pyarrow; a scheme that it has no store for is an error."""
    scheme, colon, rest = folder.partition(":")
    if not colon:
        if not folder.startswith("/"):
            raise ValueError(f"{folder!r} is neither a URI nor an absolute path")
        return f"file://{folder}"
    if scheme not in _SCHEMES:
        raise ValueError(f"archives can't be kept under {scheme}:, only under {', '.join(_SCHEMES)}; give open_store for any other store")
    return f"{_SCHEMES[scheme]}:{'//' + rest if scheme == 'file' and not rest.startswith('//') else rest}"


def _store(folder: str, open_store: Callable | None):
    """A pyarrow filesystem and the folder's path in it."""
    from pyarrow import fs

    return open_store(folder) if open_store else fs.FileSystem.from_uri(arrow_uri(folder))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str) -> str:
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")


def record(kind: str, name: str, url: str, payload: bytes | None, size: int, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record as a gzip member. A revisit has the HTTP header of the full answer and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{name}>", f"WARC-Target-URI: {_uri(url)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    block = http + (payload or b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 2, mtime=0)


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of one record."""
    fields = lambda text: dict(line.split(": ", 1) for line in text.decode().split("\r\n")[1:])
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    warc = fields(head)
    http, _, payload = rest[: int(warc["Content-Length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def write_archives(
    df: DataFrame, id_col: str, url_col: str, payload_col: str, folder: str | None = None, min_revisit_bytes: int = 0,
    segment_bytes: int = 256 << 20, date: str = "2026-01-01T00:00:00Z", open_store: Callable | None = None,
) -> DataFrame:
    """Writes a record for each row to folder and returns the index: page_id, url, digest, file, offset, length, block.

    Of rows with equal payloads of min_revisit_bytes or more, the one with the largest id is a response and the others
    are revisits of it; each smaller payload is a response. Payloads are told apart by SHA-256. Copies are combined
    before payloads are shuffled, and a revisit moves no payload. A task writes files under names of its own and the
    stored index names those of the attempts that succeeded, so a lost executor leaves files that nothing refers to.
    folder is a URI that pyarrow can open on every executor; by default it lies in the shared folder. open_store, if given,
    opens it instead: it takes folder and returns a pyarrow filesystem and a path. Stores that can't be opened are an error
    before any row is read.

    Null payloads are empty. A null id is the smallest; of rows with the same id one is taken; rows that are equal get a
    record each, and ids are of any type that sorts. Null URLs are empty. A payload is held by the task that writes its
    record, however long. No rows, no archives and an empty index.
    """
    folder = folder or new_path(df.sparkSession, "archives")
    if open_store is None:
        arrow_uri(folder)
    payload = whole(payload_col)
    rows = df.select(col(id_col).cast("string").alias("id"), col(id_col).alias("rank"), whole(url_col).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("key"))
    narrow = cut(rows.select("id", "rank", "url", "key", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha1"), F.monotonically_increasing_id().alias("row")))
    best = cut(narrow.groupBy("key").agg(F.max(F.struct("rank", "row", "id")).alias("best")))
    typed = narrow.join(best, "key").withColumn("kind", F.when((F.col("size") >= min_revisit_bytes) & (F.col("row") != F.col("best.row")), "revisit").otherwise("response"))
    name = lambda n, row: F.concat(F.coalesce(F.concat(F.lit("="), n), F.lit("~")), F.lit(" "), row.cast("string"))
    typed = cut(typed.select("key", "kind", "id", "url", "size", "sha1", name(F.col("id"), F.col("row")).alias("name"), name(F.col("best.id"), F.col("best.row")).alias("refers_to")))
    contents = rows.groupBy("key").agg(F.first("payload").alias("payload"))
    out = ["kind", "id", "url", "size", "sha1", "name", "refers_to", "payload"]
    responses = typed.where("kind = 'response'").join(contents, "key").select(*out)
    records = responses.unionByName(typed.where("kind = 'revisit'").withColumn("payload", F.lit(None).cast("string")).select(*out))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = _store(folder, open_store)
        store.create_dir(top, recursive=True)
        path, sink, at = "", None, 0
        for batch in batches:
            index = []
            for kind, page, url, size, sha1, name, refers_to, text in batch.itertuples(index=False, name=None):
                if sink is None or at >= segment_bytes:
                    if sink is not None:
                        sink.close()
                    path, at = f"{top}/{uuid.uuid4().hex}.warc.gz", 0
                    sink = store.open_output_stream(path, compression=None)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                data = record(kind, quote(name), url, None if kind == "revisit" else text.encode(), size, digest, quote(refers_to), date)
                sink.write(data)
                index.append((page, url, digest, path, at, len(data), at // BLOCK))
                at += len(data)
            yield pd.DataFrame(index, columns=[x.split()[0] for x in INDEX.split(", ")])
        if sink is not None:
            sink.close()

    index = stored(records.mapInPandas(write, INDEX), "index")
    return index.withColumn("folder", F.lit(folder))


def coalesced(places: list[tuple[int, int]], gap: int = 64 << 10, most: int = BLOCK * 2) -> list[tuple[int, int]]:
    """Byte ranges that cover these (offset, length), sorted: neighbours less than gap apart are read at once, up to most."""
    ranges: list[tuple[int, int]] = []
    for at, n in sorted(places):
        if ranges and at - ranges[-1][1] <= gap and max(at + n, ranges[-1][1]) - ranges[-1][0] <= most:
            ranges[-1] = (ranges[-1][0], max(ranges[-1][1], at + n))
        else:
            ranges.append((at, at + n))
    return ranges


def read_selected(index: DataFrame, open_store: Callable | None = None) -> DataFrame:
    """Reads the records of these index rows: page_id, payload_bytes, payload_digest, record_type, refers_to, all strings or longs.

    Rows meet by file and block, and each group reads its coalesced byte ranges. A group is the records that begin within
    8 MiB of a file: some 28,000 of them if all are revisits, of about 300 bytes each, and a record more than that long if
    its payload is. A payload whose digest or length differs from its header raises an error. Ids that were null are null;
    index rows that are equal give a row each. No index rows, no result. open_store is that of write_archives.
    """

    def read(rows: pd.DataFrame) -> pd.DataFrame:
        store, _ = _store(rows["folder"].iloc[0], open_store)
        out, places = [], sorted(zip(rows["offset"].tolist(), rows["length"].tolist(), strict=True))
        with store.open_input_file(rows["file"].iloc[0]) as source:
            k = 0
            for begin, end in coalesced(places):
                source.seek(begin)
                data = source.read(end - begin)
                while k < len(places) and places[k][0] + places[k][1] <= end:
                    at, n = places[k]
                    warc, http, payload = parse(data[at - begin : at - begin + n])
                    digest, size = warc["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
                    if warc["WARC-Type"] == "response" and (base32_sha1(payload), len(payload)) != (digest, size):
                        raise ValueError(f"damaged record at {at} of {rows['file'].iloc[0]}")
                    out.append((_page(warc["WARC-Record-ID"]), size, digest, warc["WARC-Type"], _page(warc.get("WARC-Refers-To"))))
                    k += 1
        return pd.DataFrame(out, columns=[x.split()[0] for x in PAGES.split(", ")])

    return index.groupBy("file", "block").applyInPandas(read, PAGES)


def _page(name: str | None) -> str | None:
    page = unquote(name.removeprefix("<urn:x-page:").removesuffix(">")).rpartition(" ")[0] if name else "~"
    return page[1:] if page.startswith("=") else None
