"""Removal of lines that many documents share, with an index that takes documents in and out.

A line's key is the line without ASCII white space at both ends, A-Z in lower case.
A key of at least ``MIN_CHARS`` characters that at least ``MIN_DOCS`` documents
hold is frequent; frequent lines go from every document, the others stay as they
are, joined by line feeds.

The index (`LineIndex`) lives in a folder as one version after the other:

* ``counts``: shard, hi, lo (128 bits of a key's digest) and n, the exact number of
  documents that hold the key;
* ``filters``: a cuckoo filter for each shard, with the fingerprints of the shard's
  frequent keys.

Taking documents in adds one to each of their keys, taking them out subtracts one;
a key that crosses the threshold is put into its shard's filter or deleted from
it, so taking a batch out leaves the index that never had it.  A filter that has
no room left is made anew, larger, from the exact counts.  A version is
complete once its filters are written; readers take the newest complete one, so a
job that dies leaves the index as it was.  Every batch has a name, and a name that
is in already is passed over, so jobs may be repeated.

Cleaning packs the documents into parts (Arrow batches, written once, so that they
are the same for every later step).  A part asks for each different key once,
however many lines hold it.  Questions are sorted by shard, the filter answers no
to nearly all of them, and what is left is confirmed by the exact counts; only
frequent keys travel back to their parts.  So a line that a third of all rows hold
costs one row a part.

A document is a row.  Null texts and empty ones are one empty line.  Equal rows
count each for themselves, rows without doc_id too.  All columns come back.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import bounded_batches, shared_dir, stored
from .textbuf import frugal, frugal_cogroup, frugal_group, mix, raw_texts

MIN_DOCS, MIN_CHARS = 10, 1
SPACE = b" \t\n\x0b\x0c\r"
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Keys that a shard is made for.
SHARD_KEYS = 1 << 19
SLOTS, KICKS = 4, 500


class Cuckoo:
    """A cuckoo filter: buckets of 4 fingerprints of 16 bits, two buckets for each key, no false no."""

    def __init__(self, table: np.ndarray):
        self.table = table  # buckets x SLOTS, 0 is free
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        """With room for so many keys at a load of 0.84 or less."""
        return cls(np.zeros((1 << max(1, int(-(-keys * 6 // (5 * SLOTS)) - 1).bit_length()), SLOTS), np.uint16))

    def _print(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(48)).astype(np.uint16) | (keys >> np.uint64(48) == 0)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys & self.mask).astype(np.int64)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(prints.astype(np.uint64)) & self.mask).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        prints, home = self._print(keys), self._home(keys)
        there = self.table[home] == prints[:, None]
        return (there | (self.table[self._other(home, prints)] == prints[:, None])).any(1)

    def add(self, keys: np.ndarray) -> bool:
        """Puts all keys in, each once more if it is there; False if one found no room."""
        prints, bucket = self._place(self._print(keys), self._home(keys))
        bucket = self._other(bucket, prints)
        for turn in range(KICKS):
            prints, bucket = self._place(prints, bucket)
            if not len(prints):
                return True
            # one newcomer a bucket takes the place of an older fingerprint, which moves on to its other bucket
            _, first = np.unique(bucket, return_index=True)
            slot = turn % SLOTS
            out = self.table[bucket[first], slot].copy()
            self.table[bucket[first], slot] = prints[first]
            prints[first] = out
            bucket[first] = self._other(bucket[first], out)
        return False

    def _place(self, prints: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fills free slots; what found none."""
        order = np.argsort(bucket, kind="stable")
        prints, bucket = prints[order], bucket[order]
        rank = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
        free = self.table[bucket] == 0
        fits = rank < free.sum(1)
        # the rank-th free slot of the bucket
        slot = np.argmax((np.cumsum(free, 1) == (rank + 1)[:, None]) & free, 1)
        self.table[bucket[fits], slot[fits]] = prints[fits]
        return prints[~fits], bucket[~fits]

    def remove(self, keys: np.ndarray) -> None:
        """Deletes one fingerprint for each key; keys must be in."""
        prints, home = self._print(keys), self._home(keys)
        for p, a, b in zip(prints.tolist(), home.tolist(), self._other(home, prints).tolist()):
            row = a if (self.table[a] == p).any() else b
            at = np.flatnonzero(self.table[row] == p)
            if not len(at):
                raise ValueError("a key that is not in the filter")
            self.table[row, at[0]] = 0


def line_keys(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Lines of a text and a 16-byte digest of each key; a key that is too short has the digest b''."""
    lines = text.split(b"\n")
    out = []
    for line in lines:
        key = line.strip(SPACE).translate(_LOWER)
        short = len(key) < MIN_CHARS or (MIN_CHARS > 1 and len(key.decode()) < MIN_CHARS)
        out.append(b"" if short else hashlib.blake2b(key, digest_size=16).digest())
    return lines, out


_KEYS = [("hi", pa.int64()), ("lo", pa.int64()), ("n", pa.int64())]


def _parts(documents: DataFrame) -> tuple[DataFrame, list[T.StructField]]:
    """The documents with part and, in one row a part, keys (hi, lo, n: in how many rows); columns are c0, c1, ... and text."""
    other = [c for c in documents.columns if c != "text"]
    fields = [T.StructField(f"c{k}", documents.schema[c].dataType) for k, c in enumerate(other)]
    plain = documents.select(F.spark_partition_id().alias("p"), F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`").alias(f.name) for c, f in zip(other, fields)])
    kind = pa.list_(pa.struct(_KEYS))

    def run(batches):
        for number, batch in enumerate(batches):
            if not len(batch):
                continue
            part = batch.column(0)[0].as_py() << 32 | number
            found: dict[bytes, int] = {}
            for text in raw_texts(batch.column(1)):
                for key in set(line_keys(text)[1]):
                    found[key] = found.get(key, 0) + 1
            found.pop(b"", None)
            both = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            # by their first half, so that the stored table packs better
            order = np.argsort(both[:, 0], kind="stable")
            many = np.fromiter(found.values(), np.int64, len(found))
            listed = pa.StructArray.from_arrays([pa.array(v[order]) for v in (both[:, 0], both[:, 1], many)], ["hi", "lo", "n"])
            offset = pa.array([0] + [len(found)] * len(batch), pa.int32())
            keys = pa.ListArray.from_arrays(offset, listed).cast(kind)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(batch), pa.int64()), keys, *batch.columns[1:]], ["part", "keys", "text", *[f.name for f in fields]])

    keys = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n, _ in _KEYS]))
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("keys", keys), T.StructField("text", T.StringType()), *fields])
    return stored(plain.mapInArrow(frugal(run), schema), "line-parts"), fields


def _asked(parts: DataFrame) -> DataFrame:
    """part, hi, lo, n of every different key of every part."""
    return parts.select("part", F.inline("keys"))


def _shard(count: int):
    return F.pmod("lo", F.lit(count)).alias("shard")


_FILTERS = "shard long, filter binary"


class LineIndex:
    """Reference counts of line keys and the filters over the frequent ones, in versions under `path`."""

    def __init__(self, spark: SparkSession, path: str | None = None, shards: int | None = None, least: int = MIN_DOCS):
        """Without a path the index has a folder of its own in the shared one.

        `shards` holds for a new index; without it, it follows the first batch.
        """
        self.spark, self.least = spark, least
        self.path = path or f"{shared_dir(spark)}/line-index-{self._fresh()}"
        self.shards = shards
        bounded_batches(spark)

    @staticmethod
    def _fresh() -> str:
        import uuid

        return uuid.uuid4().hex

    # ---- versions ----

    def _fs(self):
        sc = self.spark.sparkContext
        root = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        return sc._jvm.org.apache.hadoop.fs.Path, root.getFileSystem(sc._jsc.hadoopConfiguration()), root

    def version(self) -> int:
        """The newest complete version, 0 if there is none."""
        path, fs, root = self._fs()
        if not fs.exists(root):
            return 0
        numbers = [int(s.getPath().getName()[1:]) for s in fs.listStatus(root) if s.getPath().getName()[1:].isdigit()]
        return max((v for v in numbers if fs.exists(path(f"{self.path}/v{v}/filters/_SUCCESS"))), default=0)

    def _read(self, name: str, version: int) -> DataFrame:
        kinds = {"counts": "shard long, hi long, lo long, n long", "filters": _FILTERS, "batches": "batch string, shards long"}
        if not version:
            return self.spark.createDataFrame([], kinds[name])
        return self.spark.read.schema(kinds[name]).parquet(f"{self.path}/v{version}/{name}")

    def counts(self) -> DataFrame:
        """shard, hi, lo, n of the newest version."""
        return self._read("counts", self.version())

    def filters(self) -> DataFrame:
        return self._read("filters", self.version())

    # ---- changes ----

    def insert(self, documents: DataFrame, batch: str | None = None) -> None:
        """Takes documents in."""
        self._change(documents, 1, batch)

    def delete(self, documents: DataFrame, batch: str | None = None) -> None:
        """Takes documents out; a document that is not in is a ValueError, and the index stays as it is."""
        self._change(documents, -1, batch)

    def _change(self, documents: DataFrame, sign: int, batch: str | None) -> None:
        self.change_by(_asked(_parts(documents)[0]), sign, batch)

    def change_by(self, asked: DataFrame, sign: int, batch: str | None = None) -> None:
        """The same for keys (hi, lo, n) that were taken from documents already."""
        batch = batch or self._fresh()
        old = self.version()
        known = self._read("batches", old)
        if not known.where(F.col("batch") == batch).isEmpty():
            return
        if old:
            self.shards = known.first()["shards"]
        elif self.shards is None:
            self.shards = max(1, -(-asked.count() // SHARD_KEYS))
        at = f"{self.path}/v{old + 1}"
        # keys are added up in the tasks that read the parts, so a frequent one is a row a task
        new = asked.groupBy("hi", "lo").agg((sign * F.sum("n")).alias("d"))
        both = self._read("counts", old).select("hi", "lo", "n", F.lit(0).alias("d")).unionByName(new.select("hi", "lo", F.lit(0).alias("n"), "d"))
        both = both.groupBy(_shard(self.shards), "hi", "lo").agg(F.sum("n").alias("was"), F.sum("d").alias("d")).withColumn("n", F.col("was") + F.col("d"))
        both.write.mode("overwrite").option("compression", "zstd").parquet(f"{at}/changes")
        changes = self.spark.read.schema("shard long, hi long, lo long, was long, d long, n long").parquet(f"{at}/changes")
        if not changes.where("n < 0").isEmpty():
            raise ValueError("documents that are not in the index")
        changes.where("n > 0").select("shard", "hi", "lo", "n").write.mode("overwrite").option("compression", "zstd").parquet(f"{at}/counts")
        known.unionByName(self.spark.createDataFrame([(batch, self.shards)], "batch string, shards long")).coalesce(1).write.mode("overwrite").parquet(f"{at}/batches")
        crossed = changes.where((F.col("was") >= self.least) != (F.col("n") >= self.least)).select("shard", "lo", (F.col("n") >= self.least).alias("up"))
        made = self._read("filters", old).groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(frugal_cogroup(_turn), _FILTERS)
        made = stored(made, "line-filters")
        full = made.where("filter is null").select("shard")
        frequent = changes.where(F.col("n") >= self.least).select("shard", "lo")
        anew = frequent.join(F.broadcast(full), "shard").groupBy("shard").applyInArrow(frugal_group(_built), _FILTERS)  # full shards: at most all shards' numbers
        made.where("filter is not null").unionByName(anew).write.mode("overwrite").parquet(f"{at}/filters")
        path, fs, _ = self._fs()
        fs.delete(path(f"{at}/changes"), True)

    # ---- questions ----

    def frequent(self, asked: DataFrame) -> DataFrame:
        """part, hi, lo of the asked keys that are frequent: filters first, then the exact counts."""
        version = self.version()
        if version and self.shards is None:
            self.shards = self._read("batches", version).first()["shards"]
        shards = self.shards or 1
        zero = F.lit(0).cast("long")
        filters = self._read("filters", version).select("shard", F.lit(-1).cast("long").alias("part"), zero.alias("hi"), zero.alias("lo"), "filter")
        rows = filters.unionByName(asked.select(_shard(shards), "part", "hi", "lo", F.lit(None).cast("binary").alias("filter")))

        def run(batches):
            # a shard's filter comes before its questions
            at, have = None, None
            for batch in batches:
                shard, part, hi, lo = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
                edge = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
                take = np.zeros(len(shard), bool)
                for a, z in zip(edge.tolist(), [*edge[1:].tolist(), len(shard)]):
                    if shard[a] != at:
                        at, have = shard[a], None
                    if part[a] < 0:
                        have, a = _opened(batch.column(4)[a].as_py()), a + 1
                    if have is not None and z > a:
                        take[a:z] = have.has(_mixed(lo[a:z]))
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(take)) for k in (1, 2, 3)], ["part", "hi", "lo"])

        maybe = rows.repartition("shard").sortWithinPartitions("shard", "part").mapInArrow(frugal(run), "part long, hi long, lo long")
        sure = self._read("counts", version).where(F.col("n") >= self.least).select("hi", "lo")
        return maybe.join(sure, ["hi", "lo"])

    def clean(self, documents: DataFrame) -> DataFrame:
        """The documents without frequent lines, and n_lines and n_dropped of each: their own columns, then these two."""
        parts, fields = _parts(documents)
        return self._cleaned(documents, parts, fields)

    def _cleaned(self, documents: DataFrame, parts: DataFrame, fields: list[T.StructField]) -> DataFrame:
        found = self.frequent(_asked(parts))
        schema = T.StructType([T.StructField("text", T.StringType()), *fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
        out = parts.drop("keys").groupBy("part").cogroup(found.groupBy("part")).applyInArrow(frugal_cogroup(_strip([f.name for f in fields])), schema)
        other = iter(fields)
        own = [F.col("text") if c == "text" else F.col(next(other).name).alias(c) for c in documents.columns]
        return out.select(*own, F.col("n_lines").alias("n_lines" if "n_lines" not in documents.columns else "n_lines_seen"), F.col("n_dropped").alias("n_dropped" if "n_dropped" not in documents.columns else "n_lines_dropped"))


def _mixed(lo: np.ndarray) -> np.ndarray:
    """Filter keys of the halves that shards are dealt by."""
    return mix(lo.view(np.uint64))


def _opened(blob: bytes) -> Cuckoo:
    return Cuckoo(np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy())


def _table(shard: int, have: Cuckoo | None) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int64()), "filter": pa.array([None if have is None else have.table.tobytes()], pa.binary())})


def _turn(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """A shard's filter after keys crossed the threshold; null if it has no room for them."""
    have = _opened(left.column("filter")[0].as_py()) if left.num_rows else None
    if right.num_rows:
        keys, up = _mixed(right.column("lo").to_numpy()), np.asarray(right.column("up"), bool)
        have = have or Cuckoo.sized(int(up.sum()))
        have.remove(keys[~up])
        have = have if have.add(keys[up]) else None
    return _table(key[0].as_py(), have)


def _built(key, table: pa.Table) -> pa.Table:
    """A shard's filter from its frequent keys, twice as large for as long as they find no room."""
    keys, room = _mixed(table.column("lo").to_numpy()), table.num_rows
    while not (have := Cuckoo.sized(room)).add(keys):
        room *= 2
    return _table(key[0].as_py(), have)


def _strip(names: list[str]):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        drop: set[bytes] = set()
        if right.num_rows:
            drop = {v.tobytes() for v in np.stack([right.column(c).to_numpy() for c in ("hi", "lo")], 1)}
        texts, lines, dropped = [], [], []
        for text in raw_texts(left.column("text").combine_chunks()):
            all_lines, keys = line_keys(text)
            kept = [x for x, k in zip(all_lines, keys) if k not in drop] if drop else all_lines
            texts.append(b"\n".join(kept).decode())
            lines.append(len(all_lines))
            dropped.append(len(all_lines) - len(kept))
        made = [pa.array(texts, pa.string()), *[left.column(c) for c in names], pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
        return pa.Table.from_arrays(made, ["text", *names, "n_lines", "n_dropped"])

    return run


def drop_frequent_lines(documents: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """Takes the documents in (an index of their own, unless one is given) and cleans them, packing them once."""
    index = index or LineIndex(documents.sparkSession)
    parts, fields = _parts(documents)
    index.change_by(_asked(parts), 1)
    return index._cleaned(documents, parts, fields)


SQL = """with d as (select row_number() over () r, doc_id, coalesce(text, '') as txt from documents),
p as (select r, string_split(txt, chr(10)) a from d),
l as (select r, unnest(a) line, unnest(range(len(a))) i from p),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as linekey from l),
f as (select linekey from k where linekey <> '' group by linekey having count(distinct r) >= 10),
g as (select r, count(*)::bigint n_lines, count(f.linekey)::bigint n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where f.linekey is null), '')) kept_sha256 from k left join f using (linekey) group by r)
select doc_id, n_lines, n_dropped, kept_sha256 from d join g using (r)"""
