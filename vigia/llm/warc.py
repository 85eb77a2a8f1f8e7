"""WARC archives with a two-level capture index: compressed blocks of sorted keys and a sparse directory."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import slices
from .storage import cut

#: Payload bytes meant for one archive, captures for one index shard, captures in one block.
ARCHIVE_BYTES, SHARD_CAPTURES, BLOCK_CAPTURES = 8 << 20, 100_000, 128
#: Bytes of neighbouring (compressed) records that one range read fetches at most; one longer record is read alone.
READ_BYTES = 1 << 20
_DATE = "2024-01-01T00:00:00Z"
_ID = "<urn:page:%d>"
_END = "\r\n"


def _member(data: bytes) -> bytes:
    """A gzip member; members one after the other are a gzip file."""
    gzip = zlib.compressobj(3, zlib.DEFLATED, 31)
    return gzip.compress(data) + gzip.flush()


#: Stands between two records, as Spark's writer needs something there: a member without content.
_BETWEEN = _member(b"")


def digests(pages: DataFrame) -> DataFrame:
    """``page_id, url, html`` (null: empty), ``payload_bytes`` and ``payload_digest`` (base32 SHA-1) of each page."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    bits = F.sha1(html.cast("binary"))
    # 40 hex digits are 32 base32 digits: 5 of the one for 4 of the other
    quint = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lpad(F.conv(F.substring(bits, i * 5 + 1, F.lit(5)), 16, 32), 4, "0"))
    base32 = F.translate(F.upper(F.array_join(quint, "")), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.octet_length(html).cast("bigint").alias("payload_bytes"), base32.alias("payload_digest"))


def plan_records(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Adds ``refers_to``: null for a response, else the page_id of the response with the same payload (the largest id).

    Payloads are told apart by SHA-1 and length; those of fewer than ``least_bytes`` bytes are always responses.  Who refers to whom is
    found on ids and digests alone; the html is shuffled once, to join that on the page's id and digest, which no two pages
    share but repeats of one, and comes out dealt into archives of about ``archive_bytes``.  Rows that repeat a page_id with the
    same payload are alike.
    """
    rows, key = digests(pages), ["page_id", "payload_digest", "payload_bytes"]
    slim = cut(rows.select(*[F.col(c).alias(c) for c in key]))
    groups = slim.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = slim.join(groups, ["payload_digest", "payload_bytes"]).where("page_id < refers_to").groupBy(*key).agg(F.max("refers_to").alias("refers_to"))
    parts = max(1, -(-(slim.agg(F.sum("payload_bytes")).first()[0] or 0) // archive_bytes))
    return rows.repartition(parts, *key).join(revisits.repartition(parts, *key), key, "left")


def _record() -> F.Column:
    """A WARC/1.1 record.  A revisit keeps the response's headers, and so the payload's length."""
    revisit = F.col("refers_to").isNotNull()
    url = F.translate(F.coalesce("url", F.lit("")), _END, "")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END * 2))
    size = F.octet_length(head) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit(f"WARC/1.1{_END}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{_END}WARC-Target-URI: "), url,
        F.lit(f"{_END}WARC-Date: {_DATE}{_END}WARC-Record-ID: "), F.coalesce(F.format_string(_ID, "page_id"), F.lit("<urn:page:none>")),
        F.lit(f"{_END}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"{_END}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{_END}WARC-Refers-To: "), F.format_string(_ID, "refers_to"))).otherwise(""),
        F.lit(f"{_END}Content-Type: application/http; msgtype=response{_END}Content-Length: "), size.cast("string"),
        F.lit(_END * 2), head, F.when(revisit, "").otherwise(F.col("html")), F.lit(_END * 2),
    )


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, _, _ in slices(batches, "record"):
        yield pa.RecordBatch.from_arrays([pa.array([_member(x.as_py()) for x in part.column("record")], pa.binary())], names=["value"])


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one record a page into WARC files of about ``archive_bytes`` of payload at ``path``, each record a gzip member of its own.

    Spark's text writer puts the members' bytes out as they are, with a member without content as line separator, so the files lie
    where any Hadoop path can be, and a lost task is written anew.
    """
    records = plan_records(pages, least_bytes, archive_bytes).select(_record().cast("binary").alias("record"))
    records.mapInArrow(_members, "value binary").select(F.col("value").cast("string").alias("value")).write.options(lineSep=_BETWEEN.decode("latin-1"), encoding="ISO-8859-1").text(path)


def surt(url: str | None) -> str:
    """Reversed-host key of a URL: ``http://www.a.example/p?q`` is ``example,a)/p?q``; no URL is an empty key."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    names = host.removeprefix("www.").split(".")
    shown = f":{port}" if port and port not in (80, 443) else ""
    query = "?" + parts.query if parts.query else ""
    return ",".join(reversed(names)) + shown + ")" + (parts.path or "/").lower() + query.lower()


def _headers(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """The header lines from ``at`` on, and where they end."""
    stop = data.index(b"\r\n\r\n", at)
    return dict(line.split(": ", 1) for line in data[at:stop].decode("utf-8", "replace").split(_END)[1:]), stop + 4


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and content block of a record."""
    head, start = _headers(record, 0)
    return head, record[start : start + int(head["Content-Length"])]


def read_members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and record of each member of an archive that has content."""
    at, whole = 0, memoryview(content)
    while at < len(content):
        unzip, parts, stop = zlib.decompressobj(31), [], at
        while not unzip.eof:
            if stop >= len(content):
                raise ValueError("an archive ends within a record")
            parts.append(unzip.decompress(whole[stop : stop + (1 << 16)]))
            stop = min(len(content), stop + (1 << 16))
        stop -= len(unzip.unused_data)
        if any(parts):
            yield at, stop - at, b"".join(parts)
        at = stop


def _page(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            heads = ((at, size, parse_record(record)[0]) for at, size, record in read_members(content.as_py()))
            rows = [(surt(h["WARC-Target-URI"]), _page(h["WARC-Record-ID"]), path, at, size) for at, size, h in heads]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "archive", "offset", "length"])


_CAPTURE = "key string, page_id bigint, archive string, offset bigint, length bigint"


def archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")


def _blocks(size: int):
    """Cut a sorted shard into compressed blocks; a block's first and last key go beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        number = 0

        def block() -> pa.RecordBatch:
            nonlocal number, held
            rows, held, number = held, [], number + 1
            data = zlib.compress("\n".join(json.dumps([r["key"], r["page_id"], r["archive"], r["offset"], r["length"]]) for r in rows).encode(), 6)
            return pa.RecordBatch.from_arrays([pa.array([rows[0]["shard"]], pa.int32()), pa.array([number - 1], pa.int32()), pa.array([rows[0]["key"]]), pa.array([rows[-1]["key"]]), pa.array([len(rows)], pa.int32()), pa.array([data], pa.binary())], names=["shard", "block", "first_key", "last_key", "captures", "data"])

        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                if len(held) == size:
                    yield block()
        if held:
            yield block()

    return run


def write_index(spark: SparkSession, archive_path: str, path: str, shards: int, block_captures: int = BLOCK_CAPTURES) -> None:
    """Read every archive and write its captures as compressed blocks in the order of their keys; one directory row a block.

    Captures are dealt to ``shards`` shards by ranges of (reversed-host key, page_id, place), so that the shards follow each other in the
    order of the keys, and a host or even one URL with a third of all captures takes many shards.
    """
    rows = archives(spark, archive_path).mapInArrow(_captures, _CAPTURE)
    rows = rows.repartitionByRange(shards, "key", "page_id", "archive", "offset").sortWithinPartitions("key", "page_id", "archive", "offset")
    rows.withColumn("shard", F.spark_partition_id()).mapInArrow(_blocks(block_captures), "shard int, block int, first_key string, last_key string, captures int, data binary").write.parquet(path)


def _find(key: tuple, asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    """One shard: binary search in its sparse directory, then in each block that may hold the key."""
    out: list[list] = []
    if len(asked) and len(blocks):
        blocks = blocks.sort_values("block")
        first, last, data = blocks["first_key"].tolist(), blocks["last_key"].tolist(), blocks["data"].tolist()
        opened, lines, keys = -1, [], []
        for wanted in sorted(asked["key"]):
            for at in range(bisect_left(last, wanted), bisect_right(first, wanted)):
                if opened != at:
                    lines = [json.loads(x) for x in zlib.decompress(data[at]).decode().split("\n")]
                    opened, keys = at, [x[0] for x in lines]
                out += lines[bisect_left(keys, wanted) : bisect_right(keys, wanted)]
    return pd.DataFrame(out, columns=["key", "page_id", "archive", "offset", "length"]).astype({"page_id": "Int64"})


def look_up(spark: SparkSession, keys: DataFrame, index_path: str) -> DataFrame:
    """``key, page_id, archive, offset, length`` of every capture of each asked ``key`` (distinct rows).

    The first and last key of each shard (a row for SHARD_CAPTURES captures) say by binary search which shards can hold a key; the
    asked keys go there, and each shard is searched by itself.
    """
    blocks = spark.read.parquet(index_path)
    bounds = sorted(tuple(r) for r in blocks.groupBy("shard").agg(F.min("first_key"), F.max("last_key")).select("min(first_key)", "max(last_key)", "shard").collect())
    first, last, numbers = ([b[i] for b in bounds] for i in range(3))
    first, last, numbers = list(first), list(last), list(numbers)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = [(k, numbers[s]) for k in batch.column("key").to_pylist() for s in range(bisect_left(last, k), bisect_right(first, k))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in asked], pa.string()), pa.array([s for _, s in asked], pa.int32())], names=["key", "shard"])

    routed = keys.select("key").mapInArrow(route, "key string, shard int")
    return routed.groupBy("shard").cogroup(blocks.groupBy("shard")).applyInPandas(_find, _CAPTURE)


_READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _parsed(records: list[bytes]) -> pa.RecordBatch:
    rows = []
    for record in records:
        head, block = parse_record(zlib.decompress(record, 31))
        answer, start = _headers(block, 0)
        revisit = head["WARC-Type"] == "revisit"
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else base64.b32encode(hashlib.sha1(block[start:]).digest()).decode()
        rows.append((_page(head["WARC-Record-ID"]), int(answer["Content-Length"]) if revisit else len(block) - start, digest, head["WARC-Type"], _page(head.get("WARC-Refers-To"))))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def _uri(path: str) -> str:
    return re.sub("^file:/+", "file:///", path)


@cache
def _store(scheme_and_host: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(scheme_and_host)[0]


def _opened(uri: str) -> pa.NativeFile:
    return _store(re.match("[a-z0-9]+://[^/]*/", uri).group()).open_input_file(fs.FileSystem.from_uri(uri)[1])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read spans (sorted by archive and offset) from the archives' store; spans next to each other are read together."""
    path, source = None, None

    def read(spans: list[tuple[int, int]]) -> pa.RecordBatch:
        start, (last, size) = spans[0][0], spans[-1]
        data = source.read_at(last + size - start, start)
        return _parsed([data[a - start : a - start + n] for a, n in spans])

    for batch in batches:
        spans: list[tuple[int, int]] = []
        for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
            if spans and (archive != path or offset > sum(spans[-1]) + len(_BETWEEN) or offset + length - spans[0][0] > READ_BYTES):
                yield read(spans)
                spans = []
            if archive != path:
                path, source = archive, _opened(_uri(archive))
            spans.append((offset, length))
        if spans:
            yield read(spans)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content, spans in zip(batch.column("content"), batch.column("spans").to_pylist(), strict=True):
            whole = memoryview(content.as_buffer())
            yield _parsed([bytes(whole[s["offset"] : s["offset"] + s["length"]]) for s in spans])


def _has_ranges(archive_path: str) -> bool:
    try:
        fs.FileSystem.from_uri(_uri(archive_path))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def read_captures(spark: SparkSession, archive_path: str, found: DataFrame) -> DataFrame:
    """Range-read the found captures: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Only spans are shuffled, to one task an archive (ARCHIVE_BYTES bound its captures), which reads their byte ranges from the store:
    a local or shared folder, or an object or HDFS store that pyarrow opens.  Spark's own readers have no ranges; in a store that only
    they open, whole archives are read and joined with their spans.  A response's length and digest come from its payload as
    read, a revisit's from its record.
    """
    if _has_ranges(archive_path):
        return found.select("archive", "offset", "length").repartition("archive").sortWithinPartitions("archive", "offset").mapInArrow(_ranges, _READ)
    spans = found.groupBy("archive").agg(F.collect_list(F.struct("offset", "length")).alias("spans"))
    files = archives(spark, archive_path)
    return files.join(spans, files["path"] == spans["archive"]).select("content", "spans").mapInArrow(_whole, _READ)


def surt_keys(pages: DataFrame) -> DataFrame:
    """Distinct reversed-host ``key`` of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = [None if u is None else u.replace("\r", "").replace("\n", "") for u in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in urls], pa.string())], names=["key"])

    return pages.select(F.col("url").cast("string").alias("url")).mapInArrow(run, "key string").distinct()


def shard_count(n_pages: int, shard_captures: int = SHARD_CAPTURES) -> int:
    return max(1, -(-n_pages // shard_captures))


def archive_and_read_back(pages: DataFrame, archive_path: str, index_path: str, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as WARC records, index them, and read every record back through the index.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to`` for each page.  Null html is an empty payload, a null url an
    empty key; a null page_id is archived as a response of its own; repeated page_ids each get a record; an empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    write_archives(pages, archive_path, least_bytes)
    write_index(spark, archive_path, index_path, shard_count(pages.count()))
    return read_captures(spark, archive_path, look_up(spark, surt_keys(pages), index_path))


#: DuckDB SQL for the rows of op6_warc over the view ``pages``; the base32 digits come 4 from 5 hex digits of the SHA-1.
SQL = r"""
WITH t AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes,
        array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda j:
          substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, CAST(1 + 5 * i AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * j AS BIGINT)) & 31 AS INTEGER), 1)), '')), '') AS payload_digest
      FROM t)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = max(page_id) OVER g THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < max(page_id) OVER g THEN max(page_id) OVER g END AS refers_to
FROM d WINDOW g AS (PARTITION BY payload_digest, payload_bytes)
"""
