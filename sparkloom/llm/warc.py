"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

The writer stores a page as an HTTP response record, or, where an equal payload of at least ``min_bytes`` bytes has
a page with a larger id, as a revisit of that page without the payload. The reader loads the dictionary, decodes
frame by frame, and raises on any header, length or digest that doesn't hold.

Null payloads count as empty. A null page id is written as an empty one and read back as null; such a page is never
referred to. Rows that repeat the largest id of their group are responses all. A null URL leaves its header out; white
space and control characters in URLs are percent-encoded. Other columns are ignored. An empty table gives no record.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import posix, scratch

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SAMPLE, DICTIONARY_BYTES = 256, 64 << 10
READ = 16 << 10


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """One uncompressed record; ``refers_to`` makes it a revisit."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~-._"),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(digest).decode(),
        "WARC-Profile": PROFILE if revisit else None,
        "WARC-Refers-To": record_id(refers_to) if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return VERSION + b"\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]):
    """A dictionary from the first records of a shard; None where they are too few or too alike to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples) if len(samples) >= 16 else None
    except zstandard.ZstdError:
        return None


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 1000) -> DataFrame:
    """Write ``pages(page_id, url, html)`` below ``folder``; returns the manifest of committed files.

    Only digests are grouped. The payloads meet their group's largest id in a join that Spark broadcasts when the
    groups are small, and otherwise deals by digest, splitting a digest with many pages.
    """
    spark = pages.sparkSession
    place = posix(folder)
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("size"))
    slim = rows.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "largest")
    revisit = F.when((F.col("size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    rows = rows.join(slim, "digest", "left").withColumn("refers_to", revisit)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        task = TaskContext.get()
        name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst"
        os.makedirs(place, exist_ok=True)
        n, out, pack = 0, None, None
        for batch in batches:
            ids = [None if pd.isna(x) else int(x) for x in batch["page_id"]]
            refs = [None if pd.isna(x) else int(x) for x in batch["refers_to"]]
            for page_id, url, html, digest, ref in zip(ids, batch["url"], batch["html"], batch["digest"], refs, strict=True):
                if out is None:
                    trained = train([h.encode("utf-8", "replace") for h in batch["html"][:SAMPLE]])
                    pack = zstandard.ZstdCompressor(3, dict_data=trained, write_content_size=True)
                    out = open(f"{place}/{name}", "wb")
                    if trained is not None:
                        raw = trained.as_bytes()
                        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
                out.write(pack.compress(build_record(page_id, url if isinstance(url, str) else None, html.encode("utf-8", "replace"), bytes.fromhex(digest), ref)))
                n += 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"file": [name], "n_records": [n]})

    schema = "file string, n_records long"
    rows.select("page_id", "url", "html", "digest", "refers_to").mapInPandas(write, schema).write.parquet(f"{folder}/manifest")
    return spark.read.schema(schema).parquet(f"{folder}/manifest")


def frames(path: str) -> Iterator[bytes]:
    """The content of each Zstandard frame of a file, after its dictionary was loaded."""
    import zstandard

    with open(path, "rb") as f:
        head = f.read(8)
        trained = None
        if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_MAGIC:
            n = struct.unpack("<I", head[4:])[0]
            raw = f.read(n)
            if len(raw) != n:
                raise ValueError(f"{path}: the dictionary frame is cut short")
            if raw[:4] == FRAME_MAGIC:
                raw = zstandard.ZstdDecompressor().decompress(raw)
            trained, rest = zstandard.ZstdCompressionDict(raw), b""
        else:
            rest = head
        unpack = zstandard.ZstdDecompressor(dict_data=trained)
        while rest := rest or f.read(READ):
            one, parts = unpack.decompressobj(), []
            parts.append(one.decompress(rest))
            while not one.eof:
                more = f.read(READ)
                if not more:
                    raise ValueError(f"{path}: a frame is cut short")
                parts.append(one.decompress(more))
            rest = one.unused_data
            yield b"".join(parts)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record, validated."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines[1:]:
        k, colon, v = line.decode("utf-8").partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", k):
            raise ValueError(f"bad header line {line!r}")
        headers[k.lower()] = v.strip()
    for k in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if k not in headers:
            raise ValueError(f"{k} is missing")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("Content-Length doesn't fit the record")
    return headers, rest[:-4]


def page_of(urn: str | None) -> int | None:
    return int(m[1]) if urn and (m := re.fullmatch(r"<urn:page:(-?\d+)>", urn)) else None


def read_page(raw: bytes) -> tuple:
    """(page_id, url, payload or None, payload bytes, SHA-1, type, refers_to) of a record."""
    headers, block = parse_record(raw)
    http, sep, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    if not sep or not http.startswith(b"HTTP/") or not length:
        raise ValueError("the block isn't an HTTP response")
    kind, n = headers["warc-type"], int(length[1])
    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{headers['warc-record-id']}: the payload doesn't fit its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in headers):
        raise ValueError(f"{headers['warc-record-id']}: a revisit has no payload and names a record")
    return page_of(headers["warc-record-id"]), headers.get("warc-target-uri"), payload if kind == "response" else None, n, digest, kind, page_of(headers.get("warc-refers-to"))


def read_warc(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """A row per record of the manifest's files."""
    place = posix(folder)
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, n_records in zip(batch["file"], batch["n_records"], strict=True):
                held, n = [], 0
                for raw in frames(f"{place}/{file}"):
                    row = read_page(raw)
                    held.append(row if with_payload else (*row[:2], None, *row[3:]))
                    n += 1
                    if len(held) == 500:
                        yield frame(held)
                        held = []
                if n != n_records:
                    raise ValueError(f"{file}: {n} records; the manifest says {n_records}")
                if held:
                    yield frame(held)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        return out.assign(**{k: out[k].astype("Int64") for k in ("page_id", "payload_bytes", "refers_to")}, **{k: out[k].replace({np.nan: None}) for k in ("url", "payload")})

    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return manifest.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file").mapInPandas(read, schema)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_warc(manifest, folder, with_payload=False).drop("payload", "url")


def op3_sql() -> str:
    return """WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
    g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM g"""
