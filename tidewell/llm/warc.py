"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding several whole
WARC records, and a skippable footer frame with the seek table (compressed and
plain size of every frame).  Beside the bundle stands an index from record id to
(frame, offset in the plain frame, length), so a reader inflates one frame to
get one record.  Bundles are rows of a table (bundle, archive, index) written by
Spark in a folder that all executors share; ``export`` writes one as a file.

Payloads: null html is empty.  Of records with equal payloads of at least
``MIN_REVISIT`` bytes the one with the largest page_id is the response (all of
them, if that id repeats), the others are revisit records without a payload
that name its page and target URI; smaller ones are all responses.  Null page_ids
never win over others and are kept as null; null urls give an empty target URI.
Every record has an id of its own, also where page_ids repeat; ``fetch`` reads
the records of some pages by the index alone.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import bounded_batches, cut, stored

MIN_REVISIT = 1000
FRAME_BYTES = 128 << 10
BUNDLE_BYTES = 4 << 20
# fixed values of the seekable format and of WARC
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
VERSION = b"WARC/1.1"
_EPOCH = b"2000-01-01T00:00:00Z"
_ENTRY = pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())])
_BUNDLES = pa.schema([("bundle", pa.string()), ("archive", pa.binary()), ("entries", pa.list_(_ENTRY))])
BUNDLES_DDL = "bundle string, archive binary, entries array<struct<record_id:string,page_id:bigint,frame:int,offset:int,length:int>>"


def _uri(url: str | None) -> bytes:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A").encode()


def record(record_id: str, page_id: int | None, url: str, digest: str, size: int, refers_to: int | None, payload: bytes, refers_url: str | None = None) -> bytes:
    """One WARC record; a revisit if refers_to is given, then without payload."""
    head = [
        VERSION,
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: <" + record_id.encode() + b">",
        b"WARC-Date: " + _EPOCH,
        b"WARC-Target-URI: " + _uri(url),
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"X-Payload-Length: %d" % size,
    ]
    if page_id is not None:
        head.append(b"X-Page-ID: %d" % page_id)
    if refers_to is not None:
        head.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(b"WARC-Refers-To-Target-URI: " + _uri(refers_url))
        head.append(b"X-Refers-To-Page-ID: %d" % refers_to)
        payload = b""
    head.append(b"Content-Length: %d" % len(payload))
    return b"\r\n".join(head) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.decode().split(": ", 1) for line in head.split(b"\r\n")[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record is cut off")
    return fields, rest[:size]


class BundleWriter:
    """Collects records into frames, frames into bundles."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = 3):
        self.frame_bytes, self.bundle_bytes = frame_bytes, bundle_bytes
        self.packer = zstandard.ZstdCompressor(level=level)
        self._reset()

    def _reset(self) -> None:
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int]] = []
        self.entries: list[dict] = []
        self.open: list[bytes] = []
        self.open_bytes = self.done_bytes = 0

    def add(self, record_id: str, data: bytes, page_id: int | None = None) -> dict | None:
        """A finished bundle, if this record completed one."""
        self.entries.append({"record_id": record_id, "page_id": page_id, "frame": len(self.frames), "offset": self.open_bytes, "length": len(data)})
        self.open.append(data)
        self.open_bytes += len(data)
        if self.open_bytes >= self.frame_bytes:
            self._close_frame()
        return self.finish() if self.done_bytes >= self.bundle_bytes else None

    def _close_frame(self) -> None:
        if self.open:
            packed = self.packer.compress(b"".join(self.open))
            self.frames.append(packed)
            self.table.append((len(packed), self.open_bytes))
            self.done_bytes += len(packed)
            self.open, self.open_bytes = [], 0

    def finish(self) -> dict | None:
        self._close_frame()
        if not self.frames:
            return None
        seek = b"".join(struct.pack("<II", *t) for t in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE_MAGIC)
        archive = b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(seek)) + seek
        out = {"bundle": hashlib.sha1(archive).hexdigest(), "archive": archive, "entries": self.entries}
        self._reset()
        return out


class BundleReader:
    """Random access to the frames of one bundle, by its footer alone."""

    def __init__(self, archive: bytes):
        count, flags, magic = struct.unpack_from("<IBI", archive, len(archive) - 9)
        if magic != SEEKABLE_MAGIC or flags & 0x80:
            raise ValueError("no seek table")
        at = len(archive) - 9 - 8 * count
        self.archive, self.start, self.size = archive, [0], []
        for packed, plain in struct.iter_unpack("<II", archive[at : at + 8 * count]):
            self.start.append(self.start[-1] + packed)
            self.size.append(plain)
        self.unpacker = zstandard.ZstdDecompressor()
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            self.last = (k, self.unpacker.decompress(self.archive[self.start[k] : self.start[k + 1]], max_output_size=max(1, self.size[k])))
        return self.last[1]

    def read(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def decide(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """pages with payload (binary), payload_bytes, payload_digest, refers_to (null: a response) and refers_url."""
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    base = base.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    small = base.select("page_id", "url", "payload_digest", "payload_bytes").where(F.col("payload_bytes") >= min_revisit)
    winners = small.groupBy("payload_digest").agg(F.max(F.struct("page_id", F.coalesce("url", F.lit("")).alias("url"))).alias("w"), F.count("*").alias("n")).where("n > 1 and w.page_id is not null")
    # written first, so that a digest of very many pages can be split
    winners = cut(winners.select("payload_digest", F.col("w.page_id").alias("winner"), F.col("w.url").alias("refers_url"))).hint("merge")
    # only ids and digests meet here; rows with payloads are joined by page, so a hot payload is not a hot key
    losers = small.join(winners, "payload_digest").where("page_id <> winner or page_id is null")
    losers = losers.select(F.col("page_id").alias("loser"), F.col("payload_digest").alias("loser_digest"), F.col("winner").alias("refers_to"), "refers_url").distinct()
    same = F.col("page_id").eqNullSafe(F.col("loser")) & (F.col("payload_digest") == F.col("loser_digest"))
    return base.join(cut(losers).hint("merge"), same, "left").drop("loser", "loser_digest")


def write(decided: DataFrame) -> DataFrame:
    """Bundles of the records, one or more from each partition."""

    def run(batches):
        writer, task, number = BundleWriter(), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for r in batch.slice(at, 64).to_pylist():
                    name = f"urn:page:{'' if r['page_id'] is None else r['page_id']}:{task}.{number}"
                    number += 1
                    full = writer.add(name, record(name, r["page_id"], r["url"] or "", r["payload_digest"], r["payload_bytes"], r["refers_to"], r["payload"], r["refers_url"]), r["page_id"])
                    if full:
                        yield pa.RecordBatch.from_pylist([full], schema=_BUNDLES)
        full = writer.finish()
        if full:
            yield pa.RecordBatch.from_pylist([full], schema=_BUNDLES)

    return decided.select("page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to", "refers_url").mapInArrow(run, BUNDLES_DDL)


READ_DDL = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def read(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of some bundles, each fetched by its index entry; payload digests of responses are checked."""
    ddl = READ_DDL if payloads else READ_DDL.rsplit(",", 1)[0]
    names = [c.split()[0] for c in ddl.split(", ")]
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def rows(row):
        reader = BundleReader(row["archive"])
        for e in row["entries"]:
            head, payload = parse(reader.read(e["frame"], e["offset"], e["length"]))
            digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
            response = head["WARC-Type"] == "response"
            if response and hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"payload of {e['record_id']} is damaged")
            out = {"page_id": int(head["X-Page-ID"]) if "X-Page-ID" in head else None, "url": head["WARC-Target-URI"], "record_type": head["WARC-Type"], "payload_digest": digest, "payload_bytes": len(payload) if response else int(head["X-Payload-Length"])}
            out["refers_to"] = None if response else int(head["X-Refers-To-Page-ID"])
            if payloads:
                out["payload"] = payload
            yield out

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                got = list(rows(batch.slice(k, 1).to_pylist()[0]))
                for at in range(0, len(got), 512):
                    yield pa.RecordBatch.from_pylist(got[at : at + 512], schema=schema)

    return bundles.select("bundle", "archive", "entries").mapInArrow(run, ddl)


def fetch(bundles: DataFrame, page_ids: list[int]) -> DataFrame:
    """The records of some pages; only bundles that hold them are opened, and of those only the frames concerned."""
    wanted = F.array(*[F.lit(i).cast("long") for i in page_ids])
    some = F.filter("entries", lambda e: F.array_contains(wanted, e["page_id"]))
    return read(bundles.withColumn("entries", some).where(F.size("entries") > 0))


def export(row, folder: str) -> str:
    """Writes one bundle row as a .warc.zst file; any Zstandard tool can inflate it."""
    path = f"{folder}/{row['bundle']}.warc.zst"
    with open(path, "wb") as f:
        f.write(row["archive"])
    return path


def archive(pages: DataFrame) -> DataFrame:
    """Writes the archives of `pages` in the shared folder and returns the table of bundles."""
    bounded_batches(pages.sparkSession)
    return stored(write(decide(pages)), "warc")


SQL = """
with p as (select page_id, encode(coalesce(html, '')) b from pages),
d as (select page_id, octet_length(b)::bigint payload_bytes, sha1(b) payload_digest from p),
w as (select *, max(page_id) over (partition by payload_digest) top from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> top then 'revisit' else 'response' end record_type,
  case when payload_bytes >= 1000 and page_id <> top then top end refers_to
from w
"""
