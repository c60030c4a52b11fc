"""Byte-level BPE encoding and decoding with padded numpy matrices.

Each match of the pre-tokenizer's pattern is encoded by itself.  Pieces are put
in length buckets and each bucket becomes a padded matrix of token ids.  In every
round each row merges its leftmost pair of minimum rank; pair ranks come from an
open-addressing hash table.  A row's ranks are kept with the least of every
``BLOCK`` of them, so a round looks at one block and the blocks' minima, however
long the piece; merged cells are skipped by links, and columns are compacted when
half of them are empty.  Rows that are done leave the matrix.  Every worker
keeps a cache of pieces already encoded, bounded in number and bytes.

Null texts count as empty and give no ids; texts are encoded whole, however
long; ids that are null or unknown decode to nothing.  Repeated rows are handled
row by row and extra columns are ignored.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import bounded_batches
from .textbuf import frugal, text_slices

BLOCK = 32
CACHE, CACHE_BYTES = 200_000, 8 << 20
_NONE = np.int32(0x7FFFFFFF)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def _closed_up(cells: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The cells of each row that are in use (`size` of them), without gaps, padded with -1."""
    out = np.full((len(cells), int(size.max())), -1, np.int32)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = cells[cells >= 0]
    return out


class PieceCache:
    """Ids of pieces already encoded, in flat arrays."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.bytes = 0
        self.ids, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def add(self, pieces: list[str], ids: np.ndarray, count: np.ndarray) -> None:
        if pieces:
            self.place.update(zip(pieces, range(len(self.place), len(self.place) + len(pieces))))
            self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(count) - count))
            self.count = np.concatenate((self.count, count.astype(np.int32)))
            self.ids = np.concatenate((self.ids, ids))
            self.bytes += sum(map(len, pieces))


class Vocabulary:
    """Ranks, the hashed pair table and the token bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.token_size = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.byte_id = np.full(256, -1, np.int32)
        for b in range(256):
            self.byte_id[b] = ranks.get(bytes([b]), -1)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self._build(np.array(pairs, np.int64).reshape(-1, 3))

    def _build(self, pairs: np.ndarray) -> None:
        bits = max(4, int(4 * len(pairs) + 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.key = np.full(1 << bits, -1, np.int64)
        self.value = np.full(1 << bits, _NONE, np.int32)
        key, value = (pairs[:, 0] << 32) | pairs[:, 1], pairs[:, 2].astype(np.int32)
        slot = self._slot(key)
        left = np.arange(len(key))
        while len(left):
            at = slot[left]
            free = self.key[at] == -1
            self.key[at[free]] = key[left[free]]  # of several for one slot the last stays
            won = self.key[at] == key[left]
            self.value[at[won]] = value[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & (len(self.key) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        k = key.astype(np.uint64)
        return (((k ^ (k >> np.uint64(29))) * _A ^ (k * _B)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each merged pair; _NONE if the pair does not merge."""
        shape = left.shape
        key = ((left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)).ravel()
        out = np.full(len(key), _NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._slot(key[todo])
        while len(todo):
            found = self.key[slot]
            hit = found == key[todo]
            out[todo[hit]] = self.value[slot[hit]]
            go = ~hit & (found != -1)
            todo, slot = todo[go], (slot[go] + 1) & (len(self.key) - 1)
        return out.reshape(shape)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all pieces in order, and how many each has."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        start = np.concatenate(([0], np.cumsum(size)))
        raw = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        count = np.zeros(len(pieces), np.int64)
        wide = np.full(len(raw), -1, np.int32)  # ids of a piece, from where its bytes begin
        bucket = np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
        for b in np.unique(bucket[size > 0]).tolist():
            rows = np.flatnonzero((bucket == b) & (size > 0))
            width = int(size[rows].max())
            step = max(1, (1 << 18) // width)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                cols = np.arange(width)[None, :]
                ids = np.where(cols < size[part][:, None], raw[np.minimum(start[part][:, None] + cols, len(raw) - 1)], np.int32(-1))
                ids, count[part] = self._merge(ids, size[part])
                inside = cols < count[part][:, None]
                wide[(start[part][:, None] + cols)[inside]] = ids[inside]
        return wide[wide >= 0], count

    def _merge(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        done, total = np.full(ids.shape, -1, np.int32), np.zeros(len(ids), np.int64)
        row, size = np.arange(len(ids)), size.copy()
        while len(row):
            row, ids, size = self._rounds(row, ids, size, done, total)
        return done, total

    def _rounds(self, row: np.ndarray, ids: np.ndarray, size: np.ndarray, done: np.ndarray, total: np.ndarray):
        """Merges until half of the columns are empty; rows that are done go to `done`.  Returns the others, compacted."""
        n, width = ids.shape
        block = min(BLOCK, 1 << width.bit_length())
        across = width // block + 1
        # the column behind the last one is always empty; links point there at the ends
        cells = np.full((n, across * block), -1, np.int32)
        cells[:, :width] = ids
        after = np.minimum(np.arange(across * block, dtype=np.int32) + 1, width)[None, :].repeat(n, 0)
        before = np.where(np.arange(across * block, dtype=np.int32) > 0, np.arange(across * block, dtype=np.int32) - 1, width)[None, :].repeat(n, 0)
        rank = np.full((n, across * block), _NONE, np.int32)
        rank[:, : width - 1] = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        least = rank.reshape(n, across, block).min(2)
        while True:
            low = least.min(1)
            ended = low == _NONE
            if ended.any():
                over = size[ended]
                done[row[ended], : int(over.max())] = _closed_up(cells[ended], over)
                total[row[ended]] = over
                go = ~ended
                row, cells, after, before, rank, least, low, size = (x[go] for x in (row, cells, after, before, rank, least, low, size))
            if not len(row):
                return row, cells, size
            if width > 8 and size.max() <= width // 2:
                return row, _closed_up(cells, size), size
            every = np.arange(len(row))
            first = least.argmin(1)
            at = first * block + rank.reshape(len(row), across, block)[every, first].argmin(1)
            gone = after[every, at]
            nxt, prv = after[every, gone], before[every, at]
            cells[every, at], cells[every, gone] = low, -1
            after[every, at], before[every, nxt] = nxt, at
            rank[every, gone] = _NONE
            made = self.pair_ranks(np.stack((low, cells[every, prv])), np.stack((cells[every, nxt], low)))
            rank[every, at], rank[every, prv] = made
            size = size - 1
            view = rank.reshape(len(row), across, block)
            for x in (at // block, gone // block, prv // block):
                least[every, x] = view[every, x].min(1)

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text], PieceCache())[0].tolist()

    def encode_many(self, texts: list[str], cache: PieceCache) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts in order, and how many each has."""
        find = regex.compile(self.pattern).findall
        split = [find(t) for t in texts]
        new = list(set(chain.from_iterable(split)).difference(cache.place))
        if len(cache.place) + len(new) > CACHE or cache.bytes > CACHE_BYTES:
            cache.__init__()
            new = list(set(chain.from_iterable(split)))
        cache.add(new, *self.encode_pieces([p.encode() for p in new]))
        pieces = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(cache.place.__getitem__, chain.from_iterable(split)), np.int64, int(pieces.sum()))
        count = cache.count[at]
        own = np.repeat(np.arange(len(at)), count)
        flat = cache.ids[np.arange(len(own)) - np.concatenate(([0], np.cumsum(count)))[own] + cache.start[at][own]]
        total = np.concatenate(([0], np.cumsum(count)))[np.concatenate(([0], np.cumsum(pieces)))]
        return flat, np.diff(total)

    def decode(self, ids: list) -> bytes:
        """Bytes of one list of ids."""
        return b"".join(self.tokens[i] for i in ids if i is not None and 0 <= i < len(self.tokens))

    def decode_many(self, flat: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of many lists (given as one array and offsets), and their offsets; gathers from one byte buffer."""
        known = (flat >= 0) & (flat < len(self.tokens))
        size = np.where(known, self.token_size[np.where(known, flat, 0)], 0)
        ends = np.concatenate(([0], np.cumsum(size)))
        shift = self.token_start[np.where(known, flat, 0)] - ends[:-1]
        return self.token_bytes[np.repeat(shift, size) + np.arange(int(ends[-1]))], ends[offset]


def share(spark: SparkSession, ranks_path: str, pattern: str):
    """The vocabulary as a broadcast; its size is that of the vocabulary file."""
    bounded_batches(spark)
    return spark.sparkContext.broadcast(Vocabulary(read_ranks(ranks_path), pattern))


def encode(documents: DataFrame, vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and ids (array of int) of every row."""

    def run(batches):
        v = vocabulary.value
        cache = PieceCache()
        for batch in batches:
            for a, z in text_slices(batch.column(1), 4 << 20):
                flat, count = v.encode_many([t or "" for t in batch.column(1)[a:z].to_pylist()], cache)
                offset = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offset), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:z], ids], ["doc_id", "ids"])

    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(frugal(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary) -> DataFrame:
    """doc_id, ids and the decoded bytes of every row of encode()'s result."""

    def run(batches):
        v = vocabulary.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column(1)
                flat = np.asarray(lists.flatten().fill_null(-1), dtype=np.int64)
                offset = np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64))))
                data, ends = v.decode_many(flat, offset)
                texts = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
                yield pa.RecordBatch.from_arrays([part.column(0), lists, texts], ["doc_id", "ids", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(frugal(run), "doc_id long, ids array<int>, decoded binary")


def round_trip(documents: DataFrame, vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids and the bytes decoded from them, of every row: encode() and decode() in one Python worker."""

    def run(batches):
        v = vocabulary.value
        cache = PieceCache()
        for batch in batches:
            for a, z in text_slices(batch.column(1), 1 << 20):
                flat, count = v.encode_many([t or "" for t in batch.column(1)[a:z].to_pylist()], cache)
                offset = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
                data, ends = v.decode_many(flat.astype(np.int64), offset.astype(np.int64))
                ids = pa.ListArray.from_arrays(pa.array(offset), pa.array(flat, pa.int32()))
                texts = pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:z], ids, texts], ["doc_id", "ids", "decoded"])

    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(frugal(run), "doc_id long, ids array<int>, decoded binary")
