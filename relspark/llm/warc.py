"""Deterministic sharded WARC writer and reader.

Write: shard bounds on the record id come from exact byte histograms (never
from samples), so the same rows always make the same shards; records of null
ids, and of one id heavier than a shard, are dealt to several shards by a hash of
their digest and url.  There are at most ``MAX_SHARDS`` shards, which grow with
the input beyond that.  Each shard is sorted and written by one task as gzip
members, one a record, and rolls to a new file once the compressed size reaches
``roll_bytes``.  Headers, lengths and digests are made anew from the payload.  A
file is written under a temporary name and renamed when whole; the manifest
(file, records, bytes, SHA-256) is the Parquet table ``_manifest`` beside the
files, which Spark commits at the end, and only files it names count.  A task
that runs twice writes the same bytes under the same names.

Of records with equal payloads of at least ``min_revisit_bytes`` bytes, the one
with the largest id is a response and the others are revisits of it.

Edge cases: a null payload is empty.  A null id comes first and never is what
others refer to while an id exists.  Repeated rows of the largest id are all
responses.  Null urls get a urn; control characters and blanks in urls are
percent-encoded.  An empty table gives an empty manifest and no file.  Payloads
of any size are written whole.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import bounded_batches, drop_scratch, materialize, scratch_path

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Digest tables of up to this many rows (48 bytes each) are broadcast, larger ones joined by a shuffle.
MAX_BROADCAST_ROWS = 500_000

#: Shards at most; the driver sees a few byte counts for each.
MAX_SHARDS = 50_000

MANIFEST = "shard long, file string, records long, bytes long, sha256 string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id}:{digest}'.encode()).digest()[:16], version=5)}>"


def _clean_url(url: str | None, page_id: int | None) -> str:
    if not url:
        return f"urn:page:{'' if page_id is None else page_id}"
    return re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url)


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _clean_url(url, page_id)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-ID", "" if page_id is None else page_id),
        ("X-Payload-Length", len(payload)),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", refers_to)]
    return _record(headers, block)


def _open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class _Roller:
    """Writes records to numbered files of one shard, each renamed when whole."""

    def __init__(self, folder: str, shard: int, roll_bytes: int, level: int, date: str):
        self.fs, self.root = _open_fs(folder)
        self.shard, self.roll_bytes, self.level, self.date = shard, roll_bytes, level, date
        self.seq, self.out, self.done = 0, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.seq:05d}.warc.gz"
            self.temp = f"{self.root}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out, self.hash, self.size, self.records = self.fs.open_output_stream(self.temp, compression=None), hashlib.sha256(), 0, 0
            info = json.dumps({"software": "relspark", "shard": self.shard, "file": self.seq}, sort_keys=True).encode()
            self._member(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name)), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/json")], info))
        self._member(data)
        self.records += 1
        if self.size >= self.roll_bytes:
            self.close()

    def _member(self, data: bytes) -> None:
        z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        packed = z.compress(data) + z.flush()
        self.out.write(packed)
        self.hash.update(packed)
        self.size += len(packed)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temp, f"{self.root}/{self.name}")
            self.done.append((self.shard, self.name, self.records, self.size, self.hash.hexdigest()))
            self.out, self.seq = None, self.seq + 1


def _writer(folder: str, roll_bytes: int, level: int, date: str):
    def rows(done):
        cols = list(zip(*done, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["shard", "file", "records", "bytes", "sha256"])

    def run(batches):
        roller = None
        for batch in batches:
            shards, ids, urls, refs = (batch.column(k).to_pylist() for k in ("shard", "page_id", "url", "refers_to"))
            html = batch.column("html")
            for k, shard in enumerate(shards):
                if roller is None or roller.shard != shard:
                    if roller is not None:
                        roller.close()
                        yield rows(roller.done)
                    roller = _Roller(folder, shard, roll_bytes, level, date)
                payload = html[k].as_py()
                roller.add(page_record(ids[k], urls[k], b"" if payload is None else payload.encode("utf-8", "surrogatepass"), refs[k], date))
        if roller is not None:
            roller.close()
            yield rows(roller.done)

    return run


def parse_records(stream) -> "iter":
    """(headers, block) of each record of an uncompressed stream."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        yield headers, block


class _Gunzip(io.RawIOBase):
    """All members of a gzip stream, one after the other."""

    def __init__(self, raw):
        self.raw, self.z, self.left = raw, zlib.decompressobj(31), b""

    def readable(self):
        return True

    def readinto(self, target):
        while True:
            data = self.left or self.raw.read(1 << 18)
            if not data:
                return 0
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            out = self.z.decompress(data, len(target))
            self.left = self.z.unconsumed_tail or self.z.unused_data
            if out:
                target[: len(out)] = out
                return len(out)


def _reader(folder: str):
    def records(name):
        fs, root = _open_fs(folder)
        with fs.open_input_stream(f"{root}/{name}", compression=None) as raw:
            for head, block in parse_records(io.BufferedReader(_Gunzip(raw), 1 << 18)):
                if head["warc-type"] not in ("response", "revisit"):
                    continue
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                if base32_sha1(block) != head["warc-block-digest"].removeprefix("sha1:"):
                    raise ValueError(f"{name}: block digest of {head['warc-record-id']} differs")
                size = int(head["x-payload-length"])
                if head["warc-type"] == "response":
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    if len(payload) != size or base32_sha1(payload) != digest:
                        raise ValueError(f"{name}: payload of {head['warc-record-id']} differs")
                number = lambda x: int(x) if x else None
                yield number(head["x-page-id"]), size, digest, head["warc-type"], number(head.get("x-refers-to-page-id")), head["warc-target-uri"], head["warc-record-id"]

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                held = []
                for row in records(name):
                    held.append(row)
                    if len(held) == 4096:
                        yield batch(held)
                        held = []
                if held:
                    yield batch(held)

    return run


def shard_bounds(sizes: DataFrame, shard_bytes: int, least: int, bins: int = 8, levels: int = 8) -> list[tuple[int | None, int]]:
    """First ids of the id ranges (None: null ids) and into how many shards each is dealt.

    From exact byte histograms over the id range, finer where a bin is heavier
    than a shard; only a single id that is heavier is dealt to more than one.
    """
    lo, hi, total, nulls = sizes.agg(F.min("page_id"), F.max("page_id"), F.sum("bytes"), F.sum(F.when(F.col("page_id").isNull(), F.col("bytes") + 1))).first()
    if total is None:
        return []
    want = min(MAX_SHARDS, max(least, -(-total // shard_bytes)))
    share = max(1, total / want)
    bounds: list[tuple[int | None, int]] = [] if nulls is None else [(None, max(1, round(nulls / share)))]
    if lo is None:
        return bounds
    width = max(1, -(-(hi - lo + 1) // (want * bins)))
    found = {(lo + r.b * width, width): r.s for r in sizes.where("page_id IS NOT NULL").groupBy(F.floor((F.col("page_id") - lo) / width).cast("long").alias("b")).agg(F.sum("bytes").alias("s")).collect()}
    for _ in range(levels):
        heavy = [(s, w) for (s, w), n in found.items() if n > 2 * share and w > 1]
        if not heavy:
            break
        table = sizes.sparkSession.createDataFrame([(int(s), int(w), max(1, -(-int(w) // 64))) for s, w in sorted(heavy)], "s long, w long, f long")
        fine = sizes.join(F.broadcast(table), (F.col("page_id") >= F.col("s")) & (F.col("page_id") < F.col("s") + F.col("w")))  # at most one heavy bin a shard
        fine = fine.groupBy("s", "f", F.floor((F.col("page_id") - F.col("s")) / F.col("f")).cast("long").alias("b")).agg(F.sum("bytes").alias("n")).collect()
        for key in heavy:
            del found[key]
        found |= {(r.s + r.b * r.f, r.f): r.n for r in fine}
    held = None
    for (start, w), n in sorted(found.items()):
        if w == 1 and n > 2 * share:
            bounds.append((start, round(n / share)))
            held = None
        elif held is None or held and held + n > share:
            bounds.append((start, 1))
            held = n
        else:
            held += n
    return bounds


def write_warc(
    pages: DataFrame,
    folder: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_revisit_bytes: int = 0,
    shard_bytes: int = 16 << 20,
    roll_bytes: int | None = None,
    level: int = 4,
    date: str = "2024-01-01T00:00:00Z",
    least_shards: int = 12,
) -> DataFrame:
    """Write the pages below ``folder``, which all executors share; the manifest comes back.

    ``roll_bytes`` None: a quarter of a shard's share of the input, 4 MB at least.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    sizes = materialize(rows.select("page_id", "sha", F.octet_length("html").cast("long").alias("bytes")), "warc-sizes")
    same = sizes.where(F.col("bytes") >= min_revisit_bytes).groupBy("sha").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n"))
    same = materialize(same.where("n > 1 AND keep IS NOT NULL").select("sha", "keep"), "warc-same")
    n_same = same.count()
    rows = rows.join(F.broadcast(same) if n_same <= MAX_BROADCAST_ROWS else same, "sha", "left")
    rows = rows.withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("keep")), F.col("keep")))
    bounds = shard_bounds(sizes, shard_bytes, least_shards)
    edges = np.array([np.iinfo(np.int64).min if x is None else x for x, _ in bounds], np.int64)
    deal = np.array([k for _, k in bounds], np.int64)
    first = np.concatenate([[0], np.cumsum(deal)])
    if roll_bytes is None:
        total = sizes.agg(F.sum("bytes")).first()[0] or 0
        roll_bytes = max(4 << 20, total // max(1, int(first[-1])) // 4)

    def shard_of(batches):
        for b in batches:
            ids = b.column(b.schema.get_field_index("page_id"))
            at = np.maximum(np.searchsorted(edges, np.asarray(ids.fill_null(np.iinfo(np.int64).min)), "right") - 1, 0)
            turn = np.asarray(b.column(b.schema.get_field_index("turn"))) % deal[at]
            yield pa.RecordBatch.from_arrays([pa.array((first[at] + turn).astype(np.int32)), *(b.column(k) for k in ("page_id", "url", "html", "refers_to"))], ["shard", "page_id", "url", "html", "refers_to"])

    rows = rows.withColumn("turn", F.xxhash64("sha", "url").bitwiseAND((1 << 62) - 1))
    rows = rows.select("page_id", "url", "html", "refers_to", "turn").mapInArrow(shard_of, "shard int, page_id long, url string, html string, refers_to long")
    rows = rows.repartitionById(max(1, int(first[-1])), "shard").sortWithinPartitions("shard", "page_id", "url", "refers_to", "html")
    fs, root = _open_fs(folder)
    fs.create_dir(f"{root}/_temporary", recursive=True)
    rows.mapInArrow(_writer(folder, roll_bytes, level, date), MANIFEST).write.parquet(f"{folder}/_manifest")
    fs.delete_dir(f"{root}/_temporary")
    for x in (sizes, same):
        drop_scratch(x)
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def read_warc(folder: str, manifest: DataFrame) -> DataFrame:
    """The records of the manifest's files, digests checked."""
    n = max(1, manifest.count())
    return manifest.select("file").repartition(min(n, 4096), "file").mapInArrow(_reader(folder), RECORDS)


def query(spark, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), folder)
    return read_warc(folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keep FROM p),
d AS (
  SELECT *, array_to_string(list_transform(range(0, 8), lambda i: (
    list_aggregate(list_transform(range(0, 4), lambda j:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (5 * i + 1)::INT, 5))::BIGINT >> (15 - 5 * j)::INT) & 31)::INT + 1, 1)), 'string_agg', ''))), '') AS b32
  FROM k)
SELECT page_id, n::BIGINT AS payload_bytes, b32 AS payload_digest,
  CASE WHEN page_id IS NULL AND keep IS NOT NULL OR page_id < keep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS NULL OR page_id < keep THEN keep END AS refers_to
FROM d
"""
