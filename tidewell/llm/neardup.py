"""Near-duplicate classes: consistent weighted sampling over TF-IDF shingles.

A document is the set of its five-word shingles, each weighted by damped term
frequency times inverse document frequency.  Document frequencies come from a
counting sketch of fixed size that every document is added to; a shingle that
fewer than one document in ``RARE`` has gets the full weight.  Improved
consistent weighted sampling gives ``BANDS * ROWS`` samples a document; documents
that agree on all samples of a band are candidates, and candidates are linked if
the weighted Jaccard similarity of their whole shingle sets is ``THRESHOLD`` or
more.  Classes are the connected components of links and exact copies.

Exact copies are folded first.  Inside a bucket candidates are not paired each
with each.  First every bucket has one leader, the text with the fullest buckets
(in a group of near copies, the text they come from); every other member is held
against it, and classes are formed.  Members of a bucket that are still in
different classes are then joined by an exact prefix filter over their shingles,
and only pairs that it leaves are verified.  So every pair of a bucket is either
verified, or in one class, or proven to be below the threshold.

Null texts count as empty; texts without a word only match exact copies.  Rows
that repeat a doc_id are one document.  Rows without a doc_id are in no class
(class_id null).  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .deal import FAN, Route, picks
from .lineage import bounded_batches, cut, drop_stored, stored
from .textbuf import SLICE_BYTES, TextBlock, frugal, frugal_cogroup, frugal_group, mix, raw_texts, shingles, text_slices

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 10, 4
CELLS = 1 << 20
RARE, STRENGTH = 256, 0.25
GROUP = 128
PART_BYTES = 4 << 20
_ID_BITS = 44


def shingle_sets(block: TextBlock, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle ids of each row in one array, how often each occurs, and row offsets."""
    hashes, offset = shingles(block, width)
    rows = len(offset) - 1
    owner = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(offset))
    key = np.sort((owner << np.uint64(_ID_BITS)) | (hashes >> np.uint64(64 - _ID_BITS)))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(key)))
    key = key[first]
    bound = np.searchsorted(key >> np.uint64(_ID_BITS), np.arange(rows + 1, dtype=np.uint64))
    return key & np.uint64((1 << _ID_BITS) - 1), times, bound


class Weights:
    """Weight of a shingle from the sketch; the same for every text that has it."""

    def __init__(self, cells: np.ndarray, documents: int):
        share = np.clip(cells / max(documents, 1), 1 / RARE, 1)
        self.idf = (1 + STRENGTH * np.log(1 / share) / np.log(RARE)).astype(np.float32)

    def __call__(self, ids: np.ndarray, times: np.ndarray) -> np.ndarray:
        return self.idf[(ids & np.uint64(len(self.idf) - 1)).astype(np.int64)] * (1 + np.log(times)).astype(np.float32)


def sketch(documents: DataFrame, cells: int = CELLS) -> Weights:
    """Counts in how many documents the shingles of each cell occur, over all documents.

    Tables of tasks are added up in two steps, by runs of tasks first, so that no
    group holds one for every task.
    """
    part, run = 4096, 64

    def count(batches):
        table, n = np.zeros(cells, np.int32), 0
        for batch in batches:
            for a, z in text_slices(batch.column(0)):
                ids, _, bound = shingle_sets(TextBlock(raw_texts(batch.column(0)[a:z])))
                n += int((np.diff(bound) > 0).sum())
                table += np.bincount((ids & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.int32)
        packer = zstandard.ZstdCompressor(level=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(cells // part), pa.int32()), pa.array([TaskContext.get().partitionId() // run] * (cells // part), pa.int32()), pa.array([packer.compress(table[k * part : (k + 1) * part].tobytes()) for k in range(cells // part)]), pa.array([n] * (cells // part), pa.int64())], ["k", "slot", "blob", "n"])

    def add(key, table):
        total, n = np.zeros(part, np.int64), 0
        for blob, m in zip(table.column("blob").to_pylist(), table.column("n").to_pylist()):
            data = zstandard.ZstdDecompressor().decompress(blob)
            total += np.frombuffer(data, np.int32 if len(data) == 4 * part else np.int64)
            n += m
        return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([zstandard.ZstdCompressor().compress(total.tobytes())], pa.binary()), "n": pa.array([n], pa.int64())})

    # the sketch has a fixed size, however many documents there are
    tables = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(frugal(count), "k int, slot int, blob binary, n long")
    for by in (["k", "slot"], ["k"]):
        tables = tables.groupBy(*by).applyInArrow(frugal_group(add), "k int, blob binary, n long")
    got = tables.collect()
    whole, n = np.zeros(cells, np.int64), 0
    for r in got:
        whole[r["k"] * part : (r["k"] + 1) * part] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["blob"]), np.int64)
        n = max(n, r["n"])
    return Weights(whole, n)


# quantiles of Gamma(2, 1) at the middle of 4096 equal shares, by bisection
def _gamma2_table(n: int = 4096) -> np.ndarray:
    p = (np.arange(n) + 0.5) / n
    lo, hi = np.zeros(n), np.full(n, 50.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - np.exp(-mid) * (1 + mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return ((lo + hi) / 2).astype(np.float32)


_GAMMA2 = _gamma2_table()
_U = np.float32(1 / (1 << 20))


def icws(ids: np.ndarray, weight: np.ndarray, bound: np.ndarray, samples: int) -> np.ndarray:
    """Improved consistent weighted samples of each row that has shingles: a hash of (shingle, step)."""
    rows = np.flatnonzero(np.diff(bound) > 0)
    out = np.zeros((len(bound) - 1, samples), np.uint64)
    if not len(rows):
        return out
    start = bound[rows]
    owner = np.repeat(np.arange(len(rows)), np.diff(bound)[rows])
    log_weight = np.log(weight).astype(np.float32)
    with np.errstate(over="ignore"):
        for k in range(samples):
            h = (ids + np.uint64(1)) * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF)
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            r = _GAMMA2[(h & np.uint64(4095)).astype(np.int64)]
            beta = ((h >> np.uint64(12)) & np.uint64(4095)).astype(np.float32) * np.float32(1 / 4096)
            u = (((h >> np.uint64(24)) & np.uint64(0xFFFFF)).astype(np.float32) + np.float32(0.5)) * _U
            u *= ((h >> np.uint64(44)).astype(np.float32) + np.float32(0.5)) * _U
            step = np.floor(log_weight / r + beta)
            value = np.log(-np.log(u)) - r * (step - beta + np.float32(1))
            low = np.minimum.reduceat(value, start)
            at = np.flatnonzero(value == low[owner])
            at = at[np.concatenate(([True], owner[at][1:] != owner[at][:-1]))]
            out[rows, k] = mix(ids[at] * np.uint64(0x2545F4914F6CDD1D) + (step[at].astype(np.int64) + 1000).astype(np.uint64))
    return out


def signatures(documents: DataFrame, weights, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_key (digest of the text), total (weight) and band hashes of every document."""

    def run(batches):
        w = weights.value
        for batch in batches:
            for a, z in text_slices(batch.column(1)):
                texts = raw_texts(batch.column(1)[a:z])
                block = TextBlock(texts)
                ids, times, bound = shingle_sets(block)
                weight = w(ids, times)
                sig = icws(ids, weight, bound, bands * rows).reshape(len(texts), bands, rows)
                key = np.zeros((len(texts), bands), np.uint64)
                for r in range(rows):
                    key = mix(key * np.uint64(3) + sig[:, :, r] + np.uint64(r))
                key += np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
                size = np.diff(bound)
                total = np.concatenate(([0.0], np.cumsum(weight, dtype=np.float64)))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(size > 0, bands, 0)))).astype(np.int32)), pa.array(key[size > 0].reshape(-1).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:z], pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary()), pa.array(total[bound[1:]] - total[bound[:-1]]), lists], ["doc_id", "text_key", "total", "bands"])

    return documents.mapInArrow(frugal(run), "doc_id long, text_key binary, total double, bands array<long>")


def packed_texts(documents: DataFrame) -> DataFrame:
    """doc and its Zstandard-packed text."""

    def run(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for a, z in text_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:z], pa.array([packer.compress(t) for t in raw_texts(batch.column(1)[a:z])], pa.binary())], ["doc", "z"])

    return documents.mapInArrow(frugal(run), "doc long, z binary")


def _opened(packed: pa.Array, limit: int = SLICE_BYTES):
    """Packed texts unpacked in runs of about `limit` bytes: (first row, texts)."""
    unpacker = zstandard.ZstdDecompressor()
    start, texts, used = 0, [], 0
    for k in range(len(packed)):
        text = unpacker.decompress(packed[k].as_py())
        if texts and used + len(text) > limit:
            yield start, texts
            start, texts, used = k, [], 0
        texts.append(text)
        used += len(text)
    if texts:
        yield start, texts


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (sorted ids, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    if len(a[0]) > len(b[0]):
        a, b = b, a
    spot = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][spot] == a[0]
    low = np.minimum(a[1][both], b[1][spot[both]]).sum(dtype=np.float64)
    whole = a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - low
    return float(low / whole) if whole > 0 else 0.0


def verify(pairs: DataFrame, texts: DataFrame, weights, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough; the members of one `a` are dealt over several tasks."""
    size = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts")))
    # texts are never sent to all executors, however few pairs there are
    texts = texts.hint("merge")
    lead = size.join(texts, size["a"] == texts["doc"]).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "z")
    member = pairs.join(size, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts").cast("long")).cast("int").alias("part"), "b").join(texts, F.col("b") == F.col("doc")).select("a", "part", "b", "z")
    dealt = lead.unionByName(member).repartition(F.col("a"), F.col("part")).sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches):
        w = weights.value
        at, leaders = None, []
        for batch in batches:
            a, part, b = (batch.column(i).to_pylist() for i in range(3))
            out_a, out_b = [], []
            for first, texts in _opened(batch.column(3)):
                ids, times, bound = shingle_sets(TextBlock(texts))
                weight = w(ids, times)
                for k in range(len(texts)):
                    i = first + k
                    one = ids[bound[k] : bound[k + 1]], weight[bound[k] : bound[k + 1]]
                    if (a[i], part[i]) != at:
                        at, leaders = (a[i], part[i]), []
                    if b[i] is None:
                        leaders.append((one[0].copy(), one[1].copy()))
                    elif any(similarity(one, x) >= threshold for x in leaders):
                        out_a.append(a[i])
                        out_b.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(frugal(run), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """doc, comp (smallest doc of its connected component) for every doc of links (a, b)."""
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(edges.groupBy(F.col("a").alias("doc")).agg(F.min(F.least("a", "b")).alias("comp")))
    last = None
    while True:
        old = label.select(F.col("doc").alias("up_doc"), F.col("comp").alias("up_comp"))
        near = edges.join(old.hint("merge"), F.col("b") == F.col("up_doc")).groupBy("a").agg(F.min("up_comp").alias("low"))
        step = label.join(near.hint("merge"), F.col("doc") == F.col("a")).select("doc", F.least("comp", "low").alias("comp"))
        # each label goes on to the label that its own document had
        label = cut(step.join(old.hint("merge"), F.col("comp") == F.col("up_doc"), "left").select("doc", F.least("comp", "up_comp").alias("comp")))
        total = label.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]
        if total == last:
            return label
        last = total


# ---- pairs inside a bucket that no leader has joined ----


def _blob(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(arrays[0])], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays))


def _unblob(blob: bytes, *kinds) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _summed(ids: np.ndarray, comp: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry for each shingle and class, in order."""
    order = np.lexsort((comp, ids))
    ids, comp, times = ids[order], comp[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (comp[1:] != comp[:-1])))) if len(ids) else np.zeros(0, np.int64)
    return ids[first], comp[first], np.add.reduceat(times, first) if len(first) else times


_PACKET = "place long, blob binary"
#: What parts tell of their shingles, and what they are told: see `rival_offers`.
_COUNT = {"part": np.int64, "id": np.uint64, "total": np.int64, "main": np.int64, "votes": np.int64, "lo": np.int64, "hi": np.int64}
_TOLD = {"part": np.int64, "id": np.uint64, "total": np.int64, "main": np.int64, "open": np.uint8}


def _columns(blobs: list[bytes], kinds: dict) -> list[np.ndarray]:
    got = [_unblob(b, *kinds.values()) for b in blobs]
    return [np.concatenate([np.zeros(0, k), *[g[i] for g in got]]) for i, k in enumerate(kinds.values())]


def _dealt(columns: list[np.ndarray], to: np.ndarray) -> pa.Table:
    """One packet for each place in `to`."""
    rows = [(place, _blob(*[c[at] for c in columns])) for place, at in picks(to)]
    return pa.table({"place": pa.array([r[0] for r in rows], pa.int64()), "blob": pa.array([r[1] for r in rows], pa.binary())})


def _sent(packets: DataFrame, route: Route, kinds: dict, goal) -> DataFrame:
    """Packets after all hops but the first, which the sender has made."""

    def relay(hop):
        def run(key, table):
            columns = _columns(table.column("blob").to_pylist(), kinds)
            return _dealt(columns, route.toward(key[0].as_py(), goal(columns), hop))

        return run

    for hop in range(1, route.hops):
        packets = packets.groupBy("place").applyInArrow(frugal_group(relay(hop)), _PACKET)
    return packets


def _by_most(ids: np.ndarray, comp: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of entries in order of shingle and class: the shingles, where each begins, the class with most, the smallest on a tie, and how many it has."""
    value, start = np.unique(ids, return_index=True)
    rank = np.lexsort((comp, -times, ids))[start]
    return value, start, comp[rank], times[rank]


_TOKENS = "token long, doc long, comp long, total double, most double, main boolean, bands array<long>"


def rival_offers(held: DataFrame, texts: DataFrame, weights, threshold: float = THRESHOLD) -> DataFrame:
    """The shingles by which a text may meet one of another class (held: doc, comp, total and bands, its keys).

    An exact prefix filter: shingles are ordered by the number of these texts that
    have them; of two texts that are similar enough, the first shingle that both
    have must leave enough weight after it in either.  A text offers only shingles
    of two classes or more for which that can be, with the most weight that the
    other text can have.

    A part tells shards one entry for each of its shingles: how many texts have it,
    the class with most of them, the smallest and the largest class.  A shard adds
    up and names one main class for all parts, the one with most votes.  Which class
    that is decides how many texts are held against each other, not which pairs are
    found.  Shards follow the bytes as parts do, and packets go in hops (``deal``).
    """
    spark = held.sparkSession
    held = held.join(texts.hint("merge"), "doc")
    packed = held.agg(F.sum(F.octet_length("z"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(packed) // PART_BYTES))
    route = Route(parts, FAN)
    held = cut(held.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(parts))))

    def count(key, table):
        got = []
        docs = table.column("comp").to_numpy()
        for first, some in _opened(table.column("z").combine_chunks()):
            ids, _, bound = shingle_sets(TextBlock(some))
            got.append(_summed(ids, np.repeat(docs[first : first + len(some)], np.diff(bound)), np.ones(len(ids), np.int64)))
        ids, comp, times = _summed(*(np.concatenate(x) for x in zip(*got)))
        value, start, main, votes = _by_most(ids, comp, times)
        me = key[0].as_py()
        told = [np.full(len(value), me), value, np.add.reduceat(times, start) if len(start) else times, main, votes, comp[start], comp[np.append(start[1:], len(ids))[: len(start)] - 1]]
        return _dealt(told, route.toward(me, route.goal(value), 0))

    def tell(key, table):
        part, ids, total, main, votes, lo, hi = _columns(table.column("blob").to_pylist(), _COUNT)
        value, _, best, _ = _by_most(*_summed(ids, main, votes))
        order = np.argsort(ids, kind="stable")
        start = np.searchsorted(ids[order], value)
        total, lo, hi = np.add.reduceat(total[order], start), np.minimum.reduceat(lo[order], start), np.maximum.reduceat(hi[order], start)
        at = np.searchsorted(value, ids)
        again = total[at] > 1
        part, at = part[again], at[again]
        return _dealt([part, value[at], total[at], best[at], (lo < hi)[at].astype(np.uint8)], route.toward(key[0].as_py(), part, 0))

    def offer(key, left, right):
        w = weights.value
        _, ids_, many_, main_, open_ = _columns(right.column("blob").to_pylist() if "blob" in right.column_names else [], _TOLD)
        order = np.argsort(ids_)
        ids_, many_, main_, open_ = ids_[order], many_[order], main_[order], open_[order]
        out = []
        if "z" in left.column_names and len(ids_):
            comps = left.column("comp").to_numpy()
            for first, some in _opened(left.column("z").combine_chunks()):
                ids, times, bound = shingle_sets(TextBlock(some))
                weight = w(ids, times).astype(np.float64)
                owner = np.repeat(np.arange(len(some)), np.diff(bound))
                spot = np.minimum(np.searchsorted(ids_, ids), len(ids_) - 1)
                there = ids_[spot] == ids
                many = np.where(there, many_[spot], 1)
                order = np.lexsort((ids, many, owner))
                ids, weight, there, spot = ids[order], weight[order], there[order], spot[order]
                whole = np.concatenate(([0.0], np.cumsum(weight)))
                total = whole[bound[1:]] - whole[bound[:-1]]
                left_over = whole[bound[1:]][owner] - whole[:-1]
                most = left_over * (1 + threshold) / threshold - total[owner]  # the other text's weight at most
                at = np.flatnonzero(there & (open_[spot] > 0) & (most >= threshold * total[owner] * (1 - 1e-6)))
                doc = first + owner[at]
                out.append((ids[at].astype(np.int64), doc, comps[doc], total[owner[at]], most[at], main_[spot[at]] == comps[doc]))
        token, doc, comp, total, most, main = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 6
        mine = left.select(["doc", "bands"]).take(pa.array(doc)) if out else None
        return pa.table({
            "token": pa.array(token, pa.int64()),
            "doc": mine.column("doc") if out else pa.array([], pa.int64()),
            "comp": pa.array(comp, pa.int64()),
            "total": pa.array(total, pa.float64()),
            "most": pa.array(most, pa.float64()),
            "main": pa.array(main, pa.bool_()),
            "bands": mine.column("bands").cast(pa.list_(pa.int64())) if out else pa.array([], pa.list_(pa.int64())),
        })

    counts = held.select("part", "comp", "z").groupBy("part").applyInArrow(frugal_group(count), _PACKET)
    counts = _sent(counts, route, _COUNT, lambda columns: route.goal(columns[1]))
    told = counts.groupBy("place").applyInArrow(frugal_group(tell), _PACKET)
    told = _sent(told, route, _TOLD, lambda columns: columns[0]).withColumnRenamed("place", "part")
    return held.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(frugal_cogroup(offer), _TOKENS)


def rival_pairs(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b) of different classes that share a bucket and may reach the threshold, from their offers.

    Texts meet by shingle and size class; members of a shingle's largest class are
    held against those of other classes only.
    """
    size = lambda x: F.floor(F.log(x) / F.log(F.lit(1.1)))
    # the text of more weight asks, the other one answers
    asks = rows.withColumn("size", F.explode(F.sequence(size(F.col("total") * threshold * (1 - 1e-6)), size(F.least("total", "most") * (1 + 1e-6)))))
    asks = asks.select("token", "size", *[F.col(c).alias(f"ask_{c}") for c in ("doc", "comp", "total", "most", "main", "bands")])
    answers = rows.where(F.col("most") >= F.col("total") * (1 - 1e-6)).withColumn("size", size("total"))
    possible = (F.col("comp") != F.col("ask_comp")) & (F.col("total") <= F.col("ask_most") * (1 + 1e-6)) & (F.col("ask_total") <= F.col("most") * (1 + 1e-6)) & (F.col("total") <= F.col("ask_total") * (1 + 1e-6)) & F.arrays_overlap("bands", "ask_bands")

    def met(asking: DataFrame, answering: DataFrame) -> DataFrame:
        return asking.join(answering.hint("merge"), ["token", "size"]).where(possible).select(F.least("doc", "ask_doc").alias("a"), F.greatest("doc", "ask_doc").alias("b"))

    return met(asks.where("not ask_main"), answers).unionByName(met(asks.where("ask_main"), answers.where("not main"))).where("a < b").distinct()


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id and class_id (smallest doc_id of the class) of every row."""
    spark = documents.sparkSession
    bounded_batches(spark)
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = base.where("doc_id is not null")
    weights = spark.sparkContext.broadcast(sketch(known))
    made = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(stored(df, name))
        return made[-1]

    sig = kept(signatures(known, weights, bands, rows), "signatures")
    # copies of one text are folded to their smallest id
    copies = sig.groupBy("text_key").agg(F.min("doc_id").alias("doc"), F.first("total").alias("total"), F.first("bands").alias("bands"))
    copies = kept(copies, "distinct-texts")
    placed = copies.select(F.explode("bands").alias("key"), "doc", "total")
    # small sides are written first, so that a join against a hot key can be split
    shared = cut(placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    bucket = kept(placed.join(shared.hint("merge"), "key"), "buckets")
    involved = bucket.select("doc").distinct()
    texts = kept(packed_texts(known.select(F.col("doc_id").alias("doc"), "text")).join(involved.hint("merge"), "doc"), "texts")
    # rows that repeat a doc_id with other texts are linked as they are
    links = sig.select("doc_id", "text_key").join(copies.select("text_key", "doc").hint("merge"), "text_key").where("doc <> doc_id").select(F.col("doc").alias("a"), F.col("doc_id").alias("b"))
    repeated = sig.groupBy("doc_id").agg(F.count_distinct("text_key").alias("n")).where("n > 1")
    links = links.join(repeated.hint("merge"), F.col("b") == F.col("doc_id"), "left_semi")
    # a text whose buckets are full stands in the middle of a group: it leads
    central = bucket.groupBy("doc").agg(F.sum(F.log("n")).alias("central"))
    lead = bucket.join(central.hint("merge"), "doc").groupBy("key").agg(F.max(F.struct(F.round("central", 6).alias("c"), (-F.col("doc")).alias("low"), "doc", "total")).alias("l"))
    lead = cut(lead.select(F.col("key").alias("lead_key"), F.col("l.doc").alias("a"), F.col("l.total").alias("lead_total")))
    alike = F.least("total", "lead_total") >= threshold * (1 - 1e-6) * F.greatest("total", "lead_total")
    star = cut(bucket.join(lead.hint("merge"), F.col("key") == F.col("lead_key")).where((F.col("doc") != F.col("a")) & alike).select("a", F.col("doc").alias("b")).distinct())
    links = cut(links.unionByName(verify(star, texts, weights, threshold)))
    label = components(links)
    # buckets that hold several classes still
    named = bucket.join(label.hint("merge"), "doc", "left").select("key", "doc", "total", F.coalesce("comp", "doc").alias("comp"))
    named = kept(named, "classes")
    several = cut(named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"))
    held = named.join(several.hint("merge"), "key").groupBy("doc").agg(F.first("comp").alias("comp"), F.max("total").alias("total"), F.collect_set("key").alias("bands"))
    held = cut(held)
    if not held.isEmpty():
        offers = kept(rival_offers(held, texts, weights, threshold), "prefixes")
        pairs = cut(rival_pairs(offers, threshold))
        more = verify(pairs, texts, weights, threshold)
        own = held.select("doc", "comp")
        more = more.join(own.select(F.col("doc").alias("a"), F.col("comp").alias("x")).hint("merge"), "a").join(own.select(F.col("doc").alias("b"), F.col("comp").alias("y")).hint("merge"), "b")
        more = cut(more.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct())
        if not more.isEmpty():
            joined = components(more).select(F.col("doc").alias("old"), F.col("comp").alias("new"))
            alone = more.select(F.explode(F.array("a", "b")).alias("doc")).distinct().withColumn("comp", F.col("doc"))
            label = label.unionByName(alone.join(label.hint("merge"), "doc", "left_anti"))
            label = label.join(joined.hint("merge"), F.col("comp") == F.col("old"), "left").select("doc", F.coalesce("new", "comp").alias("comp"))
    folded = sig.select("doc_id", "text_key").distinct().join(copies.select("text_key", "doc").hint("merge"), "text_key").select("doc_id", "doc")
    folded = folded.join(label.hint("merge"), "doc", "left").select("doc_id", F.coalesce("comp", "doc").alias("class_id"))
    folded = folded.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    folded = stored(folded, "near-duplicates")
    drop_stored(*made)
    return base.select("doc_id").join(folded.hint("merge"), "doc_id", "left")


def keep_one(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """The document of each class that gives it its name; rows without an id stay.

    Rows that repeat a doc_id are one document: the one with the smallest text
    stays, of equal texts the one with the smallest other columns.
    """
    keep = classes.where("doc_id = class_id").select(F.col("doc_id").alias("kept_id")).distinct()
    one = documents.where("doc_id is not null").join(keep, F.col("doc_id") == F.col("kept_id"), "left_semi")
    rest = [c for c in documents.columns if c not in ("doc_id", "text")]
    order = F.struct("text", *[F.col(f"`{c}`") for c, k in documents.dtypes if c in rest and "map<" not in k])
    # summed up before the shuffle, so an id of very many rows is one row of each task
    one = one.groupBy("doc_id").agg(F.min_by(F.struct("text", *[F.col(f"`{c}`") for c in rest]), order).alias("row"))
    one = one.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"row.`{c}`").alias(c) for c in documents.columns])
    return one.unionByName(documents.where("doc_id is null"))
