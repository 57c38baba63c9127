"""WARC archives: a writer with revisit records and a splittable reader.

Each record is a gzip member of its own. The reader's tasks are byte ranges: a task looks for the
gzip magic from its first byte on, takes a candidate for a member only if decompressing it gives
a WARC version line and a complete header block, and owns the records that start in its range,
reading past its end to finish the last one. Files are opened by pyarrow.fs, which takes any
address that pyarrow knows (local, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions, shared_dir

MAGIC = b"\x1f\x8b\x08"
READ = 1 << 20  # bytes asked for at once

WRITTEN = "path string, bytes long, records long"
RECORD = "record_id string, record_type string, url string, payload_digest string, payload_bytes long, refers_to string, payload binary, verified boolean"


def record_id(page_id: int | str | None) -> str:
    """Of a page; rows without page_id have one that ends in a colon."""
    return f"urn:page:{'' if page_id is None else page_id}"


def b32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def encode_record(page_id: int | str | None, url: str | None, payload: bytes, refers_to: int | str | None, level: int = 6) -> bytes:
    """One gzip member. A revisit has no payload, but the digest and length of the full one."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id(page_id)}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{b32_sha1(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(refers_to)}>"]
    body = payload if refers_to is None else b""
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def _header(data: bytes) -> dict[str, str] | None:
    """The header fields if data begins with a WARC version line and a whole header block."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.") or end < 0:
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")[1:]
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines))
    return fields | {"": str(end + 4)} if "warc-type" in fields and "content-length" in fields else None


def _member(source, at: int, have: bytes) -> tuple[bytes, int, bytes] | None:
    """(contents, where the next member would start, bytes read from there on) of the gzip member
    that starts at byte `at`, of which `have` was read; None if what stands there isn't a member
    that begins with a WARC header. Decoding stops at the first piece that shows that."""
    unpack, out = zlib.decompressobj(31), []
    fed, rest, position, checked = have[:4096], have[4096:], at + len(have), False
    try:
        while True:
            out.append(unpack.decompress(fed))
            if not checked:
                got = b"".join(out)
                if len(got) >= 7 and not got.startswith(b"WARC/1."):
                    return None
                checked = b"\r\n\r\n" in got
                if checked and _header(got) is None:
                    return None
            if unpack.eof:
                after = unpack.unused_data + rest
                return b"".join(out), position - len(after), after
            if rest:
                fed, rest = rest[:READ], rest[READ:]
                continue
            source.seek(position)
            if not (fed := source.read(READ)):
                return None  # cut off in the middle
            position += len(fed)
    except zlib.error:
        return None


def read_range(source, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, body) of each record that starts in [start, end) of an open file."""
    at, have = start, b""
    while at < end:
        if len(have) < len(MAGIC):
            source.seek(at + len(have))
            have += source.read(READ)
            if len(have) < len(MAGIC):
                return
        if not have.startswith(MAGIC):
            # Before the first record or behind damage: on to the next place with the magic.
            found = have.find(MAGIC)
            skip = found if found >= 0 else len(have) - len(MAGIC) + 1
            at, have = at + skip, have[skip:]
            continue
        member = _member(source, at, have)
        fields = member and _header(member[0])
        if not fields:
            at, have = at + 1, have[1:]
            continue
        data, after_at, after = member
        body = int(fields[""])
        yield at, fields, data[body : body + int(fields["content-length"])]
        at, have = after_at, after


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0, level: int = 6) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) and return (path, bytes, records)
    of the files. Of rows with equal payloads of at least min_revisit_bytes bytes, the one with
    the largest page_id is written as response and the others as revisits of it.

    Payloads are compared by SHA-1; only page ids and digests are grouped, so that a payload which
    many pages share is one pre-aggregated row, and the html is joined by page_id and digest. Files
    are written under a name of the task attempt and renamed, so a repeated task does no harm.
    Null html is an empty payload; null urls are left out of the header; rows with a page_id that
    occurs twice are written twice, and those of equal page_id and payload alike; rows without
    page_id are written as responses; an empty table writes no file.
    """
    from pyarrow import fs

    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    html = F.coalesce("html", F.lit("")).cast("binary")
    ids = pages.select("page_id", F.unhex(F.sha1(html)).alias("digest"), F.octet_length(html).alias("n"))
    ids = ids.where(F.col("n") >= min_revisit_bytes).select("page_id", "digest")
    first = ids.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisit = ids.join(first, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    # Dealt by both join keys beforehand, the html is shuffled once, for the join as for the files.
    rows = pages.select("page_id", F.unhex(F.sha1(html)).alias("digest"), "url", html.alias("html")).repartition(partitions(spark), "page_id", "digest")
    rows = rows.join(revisit, ["page_id", "digest"], "left")
    # As strings, as a null would turn the integers of its batch into doubles in pandas.
    rows = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("refers_to").cast("string").alias("refers_to"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = name = None
        size = records = 0
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for page_id, url, payload, refers_to in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"], strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}"
                    out = store.open_output_stream(f"{root}/.{name}.part")
                data = encode_record(page_id, url, bytes(payload), refers_to, level)
                out.write(data)
                size, records = size + len(data), records + 1
        if out is not None:
            out.close()
            store.move(f"{root}/.{name}.part", f"{root}/{name}.warc.gz")
            yield pd.DataFrame({"path": [f"{folder}/{name}.warc.gz"], "bytes": [size], "records": [records]})

    return cut(rows.mapInPandas(write, WRITTEN), "warc-files")


def read_archives(spark: SparkSession, files: DataFrame, split_bytes: int = 4 << 20) -> DataFrame:
    """Records (RECORD) of archives (path, bytes), split into ranges of split_bytes, each range
    in one task's hands. `verified`: the digest of the payload read is that of the header (null
    for revisits, which have none). No files, no rows."""
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes))).alias("start"))
    ranges = ranges.repartition(partitions(spark), "path", "start")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for path, start in zip(batch["path"], batch["start"], strict=True):
                rows, size = [], 0
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as source:
                    for _, head, body in read_range(source, int(start), int(start) + split_bytes):
                        plain, digest = head["warc-type"] == "response", head["warc-payload-digest"].removeprefix("sha1:")
                        rows.append((head["warc-record-id"].strip("<>"), head["warc-type"], head.get("warc-target-uri"), digest, int(head["x-payload-length"]), head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None, body if plain else None, b32_sha1(body) == digest and len(body) == int(head["x-payload-length"]) if plain else None))
                        size += len(body)
                        if size > 8 * READ:
                            yield pd.DataFrame(rows, columns=COLUMNS)
                            rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=COLUMNS)

    return ranges.mapInPandas(scan, RECORD)


COLUMNS = [x.split()[0] for x in RECORD.split(", ")]
