"""Deterministic sharded WARC writer and reader.

Records are range-sorted by (id, payload digest).  Shard borders are the keys
at which the running total of payload bytes passes a multiple of
``shard_bytes``, so they follow from the data alone, not from sampling or the
number of tasks; only these border keys (one per shard) reach the driver.  A
task writes its shards record by record, each record a gzip member with
headers and digests made anew, and starts a new file when the compressed size
passes ``file_bytes``.  Files are written under temporary names that carry the
attempt and renamed when complete; a retried task writes the same bytes to the
same final names.  The manifest, a Parquet table committed by Spark, lists the
files that count; readers go by it alone.

Copies are found by digest: counts are combined map-side, and what a revisit
refers to travels to the writer as a small row sorted in front of its record.

Defined results: a null payload is empty; a null url gives no target header; a
null id sorts first and is never a response while an equal payload has an id;
rows with the same id and payload are records of their own, all of one type; an
empty table gives an empty manifest; other columns of the input are not used.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import written
from lexforge.operators.positions import ordered_running
from lexforge.session import checkpoint_dir

DATE = "2024-01-01T00:00:00Z"       # regenerated headers are the same in every run
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "file string, shard int, part int, records long, bytes long"
_RECORD = "id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string"


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """The shared folder as a file system and path; Hadoop writes file:/x for file:///x."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder) if ":" in folder else f"file://{folder}")


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    sha = base64.b32encode(hashlib.sha1(block).digest()).decode()
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha1:{sha}",
             f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _urn(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts)))}>"


def _page(row_id: str | None, url: str | None, payload: bytes, digest: str, refers: str | None) -> bytes:
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    headers = [("WARC-Type", "response" if refers is None else "revisit"),
               ("WARC-Record-ID", _urn(row_id, digest)), ("WARC-Date", DATE),
               ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
               ("Content-Type", "application/http; msgtype=response")]
    if row_id is not None:
        headers.append(("X-Row-ID", row_id))
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers, digest)), ("X-Refers-To-Row", refers)]
    return _record(headers, http + (payload if refers is None else b""))


class _Files:
    """The files of one shard, rolled by compressed size."""

    def __init__(self, folder: str, shard: int, file_bytes: int):
        self.fs, self.path = _filesystem(folder)
        self.shard, self.file_bytes, self.part, self.out = shard, file_bytes, 0, None

    def add(self, record: bytes) -> Iterator[tuple]:
        if self.out is None:
            self.temporary = f"{self.path}/_temporary/{self.shard:07d}-{self.part:05d}-{uuid.uuid4().hex}"
            self.fs.create_dir(f"{self.path}/_temporary", recursive=True)
            self.out, self.size, self.records = self.fs.open_output_stream(self.temporary), 0, 0
            info = b"software: lexforge\r\nformat: WARC File Format 1.1\r\n"
            self._write(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn(self.shard, self.part)),
                                 ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], info))
        self._write(record)
        self.records += 1
        if self.size >= self.file_bytes:
            yield self.close()

    def _write(self, record: bytes) -> None:
        member = gzip.compress(record, 6, mtime=0)
        self.out.write(member)
        self.size += len(member)

    def close(self) -> tuple:
        self.out.close()
        name = f"part-{self.shard:07d}-{self.part:05d}.warc.gz"
        self.fs.move(self.temporary, f"{self.path}/{name}")
        row = (name, self.shard, self.part, self.records, self.size)
        self.out, self.part = None, self.part + 1
        return row


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
               payload_col: str = "html", shard_bytes: int = 32 << 20, file_bytes: int = 8 << 20,
               revisit_from: int = 1000) -> tuple[str, DataFrame]:
    """Write a record per row; returns the folder and the manifest (file, shard, part, records, bytes)."""
    spark = pages.sparkSession
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))

    slim = written(rows.select("id", "digest", F.octet_length("payload").cast("long").alias("bytes")))
    order = ordered_running(slim, ["id", "digest"], pos_col=None, sums={"before": "bytes"})
    borders = (order.groupBy(F.expr(f"before div {shard_bytes}L").alias("s"))
               .agg(F.min(F.struct("id", "digest")).alias("k")).select("k.*").collect())

    def at(r):
        return (r["id"] is not None, r["id"] if r["id"] is not None else 0, r["digest"])
    keys = sorted(at(b) for b in borders)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series, digests: pd.Series) -> pd.Series:
        some = [not pd.isna(i) for i in ids]
        return pd.Series([max(0, bisect_right(keys, (ok, i if ok else 0, d)) - 1)
                          for ok, i, d in zip(some, ids, digests)], dtype="int32")

    copies = (slim.where(F.col("bytes") >= revisit_from).groupBy("digest")
              .agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    revisits = (slim.join(copies, "digest").where(~F.col("id").eqNullSafe(F.col("response")) & F.col("response").isNotNull())
                .select("id", "digest", F.col("response").cast("string").alias("refers")).distinct())
    stream = (rows.select("id", "digest", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("string").alias("refers"))
              .unionByName(revisits.withColumns({"kind": F.lit(0), "url": F.lit(None).cast("string"),
                                                 "payload": F.lit(None).cast("binary")})))
    stream = (stream.withColumn("shard", shard_of("id", "digest")).repartition(max(1, len(keys)), "shard")
              .sortWithinPartitions("shard", "id", "digest", "kind", "url")
              .withColumn("id", F.col("id").cast("string")))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, done, revisit = None, [], (None, None, None)
        for batch in batches:
            for shard, row_id, digest, kind, url, data, refers in zip(
                    batch["shard"], batch["id"], batch["digest"], batch["kind"], batch["url"],
                    batch["payload"], batch["refers"]):
                if files is None or files.shard != shard:
                    if files is not None and files.out is not None:
                        done.append(files.close())
                    files = _Files(folder, int(shard), file_bytes)
                if kind == 0:
                    revisit = (row_id, digest, refers)
                else:
                    to = revisit[2] if revisit[:2] == (row_id, digest) else None
                    done += files.add(_page(row_id, url, data, digest, to))
        if files is not None and files.out is not None:
            done.append(files.close())
        yield pd.DataFrame(done, columns=["file", "shard", "part", "records", "bytes"])

    return folder, written(stream.mapInPandas(write, _MANIFEST))


def _records(raw) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of every record of a gzip stream of members."""
    with gzip.GzipFile(fileobj=raw) as f, io.BufferedReader(f) as lines:
        while line := lines.readline():
            if line.strip() != b"WARC/1.1":
                raise ValueError(f"not a WARC record: {line[:60]!r}")
            headers = {}
            while (line := lines.readline().rstrip(b"\r\n")):
                k, _, v = line.decode().partition(": ")
                headers[k.lower()] = v
            block = lines.read(int(headers["content-length"]))
            if lines.read(4) != b"\r\n\r\n":
                raise ValueError("record is cut short")
            yield headers, block


def read_warc(folder: str, manifest: DataFrame) -> DataFrame:
    """(id as string, payload_bytes, payload_digest, record_type, refers_to, url) of the
    records in the manifest's files; digests of responses are checked against the payload.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = _filesystem(folder)
        for batch in batches:
            for name in batch["file"]:
                rows = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as raw:
                    for headers, block in _records(raw):
                        if headers["warc-type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                        if headers["warc-type"] == "response" and (
                                len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"payload of {headers['warc-record-id']} does not fit its digest")
                        rows.append((headers.get("x-row-id"), size, digest, headers["warc-type"],
                                     headers.get("x-refers-to-row"), headers.get("warc-target-uri")))
                yield pd.DataFrame(rows, columns=["id", "payload_bytes", "payload_digest", "record_type",
                                                  "refers_to", "url"])
    return manifest.select("file").repartition(max(1, manifest.count()), "file").mapInPandas(read, _RECORD)
