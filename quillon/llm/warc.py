"""WARC archives: a deterministic sharded writer and a reader.

Rows are dealt to shards by ranges of the page id, one shard a task, sorted in them, and streamed into
gzip members, one for each record; a file is closed when it reaches the roll size in compressed bytes.
The number of shards and the roll size follow from the payloads alone, as record ids, dates, lengths
and digests do from the row, so the same rows and parameters give the same bytes in any session. A
file is written under a temporary name and renamed when whole; so is each shard's manifest, and last
the archive's. A task that is lost and runs again replaces its files by equal ones; what lost tasks
leave under temporary names is removed before the archive's manifest is written.

Of equal payloads (SHA-1) of at least 1000 bytes the one with the largest page id is a response, the
others are revisits of it without payload; smaller payloads are always responses.

Defined cases: a null html is an empty payload, a null url an empty one; a null page id is written,
sorts first and is never the response of a group that has ids; rows that repeat the largest id
of a group are all responses; an empty table makes an archive without files; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, map_frames, scratch_path, written

MIN_DEDUP_BYTES = 1000
#: Payload bytes of a shard that are aimed at, the most shards of an archive, and files of a shard if nothing compresses.
SHARD_BYTES, MAX_SHARDS, SHARD_FILES = 16 << 20, 4096, 4
#: Compressed bytes that a file is closed at: a SHARD_FILES-th of a shard's payload, within these limits.
ROLL_BYTES = (256 << 10, 1 << 30)
#: Rows for each shard that the shard bounds are taken from, by hash; every row is written whatever the bounds.
BOUND_SAMPLE = 500
#: What a record costs besides its payload.
RECORD_BYTES = 200
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 6


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    return " ".join(value.split())


def record(page_id: int | None, url: str, payload: bytes, sha1_hex: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, uncompressed."""
    name = lambda pid, n: uuid.uuid5(uuid.NAMESPACE_URL, f"{pid}/{n}")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{name(page_id, sha1_hex + url)}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _line(url)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()),
        ("WARC-Block-Digest", _digest(block)),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("X-Refers-To-Page", str(refers_to))]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    fields += [("X-Target-URI", json.dumps(url)), ("X-Payload-Length", str(len(payload))), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _rename(fs, old: str, new: str) -> None:
    """A name that exists is replaced; its file has the same bytes."""
    try:
        fs.move(old, new)
    except OSError:  # some file systems don't replace
        fs.delete_file(new)
        fs.move(old, new)


def _commit(fs, root: str, name: str, write) -> None:
    """write(stream) under a temporary name, then the name itself."""
    temporary = f"{root}/.{name}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary, compression=None) as out:
        write(out)
    _rename(fs, temporary, f"{root}/{name}")


class _Shard:
    """Files of one shard: rolled by compressed size, each renamed when it is whole."""

    def __init__(self, fs, root: str, shard: int, roll: int):
        self.fs, self.root, self.shard, self.roll, self.files, self.out = fs, root, shard, roll, [], None

    def add(self, member: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:05d}-{len(self.files):05d}.warc.gz"
            self.temporary = f"{self.root}/.{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.bytes, self.records = self.fs.open_output_stream(self.temporary, compression=None), 0, 0
        self.out.write(member)
        self.bytes += len(member)
        self.records += 1
        if self.bytes >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            _rename(self.fs, self.temporary, f"{self.root}/{self.name}")
            self.files.append({"file": self.name, "records": self.records, "bytes": self.bytes})
            self.out = None

    def commit(self) -> list[dict]:
        self.close()
        _commit(self.fs, self.root, f"part-{self.shard:05d}.manifest.json", lambda out: out.write(json.dumps(self.files).encode()))
        return self.files


def _filesystem(uri: str):
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")
    return fs, path


def shard_bounds(rows: DataFrame, n_shards: int) -> list[int]:
    """Page ids that part the bytes into n_shards ranges, judged by a sample that the ids' hashes choose."""
    total, wanted = rows.count(), BOUND_SAMPLE * n_shards
    part = F.pmod(F.xxhash64("page_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, wanted / max(1, total)))
    # About BOUND_SAMPLE rows a shard; an id that many rows repeat is one.
    sample = rows.filter(F.col("page_id").isNotNull() & part).groupBy("page_id").agg(F.sum(F.col("payload_bytes") + RECORD_BYTES).alias("b")).collect()
    weight, at, bounds = sum(r["b"] for r in sample), 0, []
    for r in sorted(sample, key=lambda r: r["page_id"]):
        if at >= (len(bounds) + 1) * weight / n_shards:
            bounds.append(r["page_id"])
        at += r["b"]
    return bounds


def shard_of(page_id: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below an id, found in two steps; a null id is in shard 0."""
    ids = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs])
    upto = lambda xs: F.size(F.filter(xs, lambda b: b <= page_id))
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    firsts = upto(ids(bounds[::step]))
    inner = F.get(F.array(*[ids(bounds[i : i + step]) for i in range(0, len(bounds), step)]), firsts - 1)
    return F.when(page_id.isNull() | (firsts == 0), F.lit(0)).otherwise((firsts - 1) * step + upto(inner)).cast("int")


def write_archive(pages: DataFrame, root: str, html: str = "html", url: str = "url", page_id: str = "page_id", n_shards: int | None = None, roll_bytes: int | None = None) -> DataFrame:
    """Writes the archive under root (a URI that all executors share) and returns its manifest: shard, file, records, bytes."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8")
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("bigint").alias("payload_bytes"))
    narrow = written(rows.select("page_id", "sha1", "payload_bytes"), "payloads")
    groups = narrow.filter(F.col("payload_bytes") >= MIN_DEDUP_BYTES).groupBy("sha1").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha1", "response")
    groups = written(groups, "responses")
    size = narrow.agg(F.sum(F.col("payload_bytes") + RECORD_BYTES)).first()[0] or 0
    n_shards = n_shards or min(MAX_SHARDS, max(1, -(-size // SHARD_BYTES)))
    roll = roll_bytes or min(ROLL_BYTES[1], max(ROLL_BYTES[0], size // n_shards // SHARD_FILES))
    shard = shard_of(F.col("page_id"), shard_bounds(narrow, n_shards))
    rows = rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_IDS else groups, "sha1", "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    rows = rows.select(shard.alias("shard"), "page_id", "url", "payload", "sha1", F.when(revisit, F.col("response")).alias("refers_to"), revisit.alias("revisit"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = _filesystem(root)
        every = (x for b in batches for x in zip(b["shard"], b["page_id"], b["url"], b["payload"], b["sha1"], b["refers_to"], b["revisit"], strict=True))
        number = lambda x: None if x is None else int(x)
        for k, own in groupby(every, key=lambda x: x[0]):
            out = _Shard(fs, path, int(k), roll)
            for _, page, address, body, sha, refers, again in own:
                out.add(_member(record(number(page), address, body, sha, number(refers), bool(again))))
            yield pd.DataFrame(out.commit()).assign(shard=int(k))[["shard", "file", "records", "bytes"]]

    fs, path = _filesystem(root)
    fs.create_dir(path, recursive=True)
    dealt = rows.repartitionById(n_shards, "shard").sortWithinPartitions("shard", "page_id", "sha1", "url")
    manifest = written(map_frames(dealt, run, "shard int, file string, records bigint, bytes bigint"), "manifest")
    remove_leftovers(fs, path)
    total = manifest.agg(F.count(F.lit(1)), F.sum("records"), F.sum("bytes")).first()
    _commit(fs, path, "MANIFEST.json", lambda out: out.write(json.dumps({"files": total[0], "records": total[1] or 0, "bytes": total[2] or 0}).encode()))
    return manifest


def remove_leftovers(fs, path: str) -> None:
    """Removes the temporary files of tasks that were lost."""
    from pyarrow.fs import FileSelector

    for info in fs.get_file_info(FileSelector(path)):
        if info.base_name.startswith(".") and info.base_name.endswith(".tmp"):
            fs.delete_file(info.path)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a file of gzip members."""
    left, data, z = b"", b"", zlib.decompressobj(31)
    while True:
        if not left:
            left = stream.read(1 << 20)
            if not left:
                break
        data += z.decompress(left)
        left = b""
        if z.eof:
            left, z = z.unused_data, zlib.decompressobj(31)
            head, _, rest = data.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines)
            block = rest[: int(fields["Content-Length"])]
            if version != "WARC/1.1" or _digest(block) != fields["WARC-Block-Digest"] or rest[len(block) :] != b"\r\n\r\n":
                raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
            yield fields, block
            data = b""
    if data:
        raise ValueError("the last record is cut off")


def read_archive(manifest: DataFrame, root: str, payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload) of every record of the manifest's files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = _filesystem(root)
        columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
        frame = lambda rows: pd.DataFrame(rows, columns=columns)

        for b in batches:
            for name in b["file"]:
                rows = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for fields, block in records(stream):
                        body, digest = block.partition(b"\r\n\r\n")[2], base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
                        if fields["WARC-Type"] == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != int(fields["X-Payload-Length"])):
                            raise ValueError(f"broken payload {fields['WARC-Record-ID']}")
                        rows.append((fields.get("X-Page-Id"), json.loads(fields["X-Target-URI"]), int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], fields.get("X-Refers-To-Page"), *[body] * payloads))
                        if len(rows) >= 2000:
                            yield frame(rows)
                            rows = []
                if rows:
                    yield frame(rows)

    n = max(1, manifest.count())
    # Ids as text: pandas would turn a column of longs with nulls into doubles.
    schema = "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string" + ", payload binary" * payloads
    got = manifest.select("file").repartition(min(n, MAX_SHARDS)).mapInPandas(run, schema)
    return got.withColumns({c: F.col(c).cast("bigint") for c in ("page_id", "refers_to")})


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The records of pages, written and read back, without payloads."""
    root = scratch_path(spark, "warc")
    return read_archive(write_archive(pages, root), root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
s AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS d FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS r FROM s)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND r IS NOT NULL AND page_id IS DISTINCT FROM r THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND r IS NOT NULL AND page_id IS DISTINCT FROM r THEN r END AS refers_to FROM g"""
