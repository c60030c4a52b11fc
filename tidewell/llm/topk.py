"""Exact top-k by integer inner product, exhaustive and term at a time.

Vector components are terms.  The rows of a candidate block become postings (for
each component the rows that have it, with their weights); a query scatters its
weighted postings into a dense score array over the block, the best k are taken
by partition selection, and the lists of all blocks are merged.  Queries come in
hashed groups of about ``QUERY_GROUP``, candidates in blocks of ``BLOCK``: every
block meets every group once, in one task of a grid of (group, slice) keys.

A vector that is null or holds a null or non-finite component takes no part.
Vectors of other lengths count as padded with zeros.  Components and inner
products are exact at any size of the components: blocks whose products could
leave 64 bits are scored in whole numbers without a bound, and only the score
column is held to the range of a long.  If an id repeats, the smallest vector of a query id asks
and no row of the same id answers it; every other row answers.  Ties go to the
smaller vec_id.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
QUERY_GROUP = 4096
#: Candidates that one task of the grid scores.
SLICE_ROWS = 1 << 16
_BLOB = "kind string, part long, blob binary, n int, dim int"


def quantised(batch_ids: pa.Array, vectors: pa.Array, scale: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Ids and integer matrix of the vectors that take part; of objects if 64 bits would not hold every component."""
    rows = []
    keep = []
    ids = batch_ids.to_pylist()
    for i, v in enumerate(vectors.to_pylist()):
        if ids[i] is None or v is None or None in v:
            continue
        x = np.asarray(v, np.float64)
        if np.isfinite(x).all():
            # a float beyond 2**52 is a whole number
            wide = np.abs(x).max(initial=0) >= 2.0**52
            rows.append(np.array([scale * int(c) if abs(c) >= 2.0**52 else math.floor(scale * c) for c in x.tolist()], object) if wide else np.floor(scale * x).astype(np.int64))
            keep.append(ids[i])
    dim = max(map(len, rows), default=0)
    out = np.zeros((len(rows), dim), object if any(r.dtype == object for r in rows) else np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return np.array(keep, np.int64), out


def _pack(ids: np.ndarray, m: np.ndarray) -> bytes:
    if m.dtype == object:
        return np.array([0], np.int64).tobytes() + ids.tobytes() + json.dumps(m.tolist()).encode()
    small = m.astype(np.int16) if len(m) == 0 or (np.abs(m) < 1 << 15).all() else m
    return np.array([small.dtype.itemsize], np.int64).tobytes() + ids.tobytes() + small.tobytes()


def _unpack(blob: bytes, n: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    size = int(np.frombuffer(blob, np.int64, 1)[0])
    if not size:
        m = np.zeros((n, dim), object)
        m[:] = json.loads(blob[8 + 8 * n :])
        return np.frombuffer(blob, np.int64, n, 8), m
    kind = np.int16 if size == 2 else np.int64
    return np.frombuffer(blob, np.int64, n, 8), np.frombuffer(blob, kind, n * dim, 8 + 8 * n).reshape(n, dim)


def blocks(vectors: DataFrame, id_col: str, vec_col: str, size: int = BLOCK) -> DataFrame:
    """Packed blocks of rows, never mixed from two partitions."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids, m = quantised(part.column(0), part.column(1))
                if len(ids):
                    yield pa.RecordBatch.from_pylist([{"blob": _pack(ids, m), "n": len(ids), "dim": m.shape[1], "part": int(ids[0])}], schema=pa.schema([("blob", pa.binary()), ("n", pa.int32()), ("dim", pa.int32()), ("part", pa.int64())]))

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(run, "blob binary, n int, dim int, part long")


def block_scores(queries: np.ndarray, candidates: np.ndarray):
    """Yields the dense score array of each query over a block: term-at-a-time accumulation."""
    dim = min(queries.shape[1], candidates.shape[1])
    size = lambda m: max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0
    kind = np.int64 if size(queries) * size(candidates) * max(dim, 1) < 1 << 62 else object
    queries = queries.astype(kind)
    postings = []
    for t in range(dim):
        at = np.flatnonzero(candidates[:, t])
        postings.append((slice(None) if len(at) == len(candidates) else at, candidates[at, t].astype(kind)))
    for q in queries:
        score = np.zeros(len(candidates), kind)
        for t in np.flatnonzero(q[:dim]).tolist():
            at, weight = postings[t]
            score[at] += q[t] * weight
        yield score


def select_best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by (score descending, id ascending)."""
    at = np.arange(len(score))
    if score.dtype == object:
        return at[sorted(range(len(score)), key=lambda i: (-score[i], ids[i]))[:k]]
    if len(score) > k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= kth)
    return at[np.lexsort((ids[at], -score[at]))[:k]]


_NINES = str.maketrans("0123456789", "9876543210")


def sortable(score: int) -> str:
    """A text that sorts like the whole number, whatever its size."""
    digits = str(abs(score))
    text = f"{len(digits):05d}{digits}"
    return "1" + text if score >= 0 else "0" + text.translate(_NINES)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of `vectors` for each row of `queries`."""
    spark = vectors.sparkSession
    asks = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    asks = asks.groupBy("id").agg(F.min("v").alias("v"))
    groups = max(1, -(-asks.count() // QUERY_GROUP))
    slices = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() // SLICE_ROWS))

    def packed(key, table):
        ids, m = quantised(table.column("id").combine_chunks(), table.column("v").combine_chunks())
        return pa.Table.from_pylist([{"g": key[0].as_py(), "blob": _pack(ids, m), "n": len(ids), "dim": m.shape[1]}] if len(ids) else [], schema=pa.schema([("g", pa.int64()), ("blob", pa.binary()), ("n", pa.int32()), ("dim", pa.int32())]))

    # the number of groups follows the number of queries, so a group stays small
    q = asks.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups))).groupBy("g").applyInArrow(packed, "g long, blob binary, n int, dim int")
    q = q.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    c = blocks(vectors, id_col, vec_col).withColumn("s", F.pmod(F.xxhash64("part", "n"), F.lit(slices)).cast("int"))
    c = c.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("g", F.col("g").cast("long"))

    def score(left, right):
        out, order = ([], [], []), []
        for ask in left.to_pylist():
            qid, qm = _unpack(ask["blob"], ask["n"], ask["dim"])
            best: list = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(qid)
            for blob, n, dim in zip(right.column("blob").to_pylist(), right.column("n").to_pylist(), right.column("dim").to_pylist()):
                ids, m = _unpack(blob, n, dim)
                for i, s in enumerate(block_scores(qm, m)):
                    at = select_best(s, ids, k + int((ids == qid[i]).sum()))
                    at = at[ids[at] != qid[i]]
                    both, who = np.concatenate((best[i][0], s[at])), np.concatenate((best[i][1], ids[at]))
                    keep = select_best(both, who, k)
                    best[i] = (both[keep], who[keep])
            for i, (s, who) in enumerate(best):
                out[0].append(np.full(len(s), qid[i]))
                out[1].append(who)
                order += [sortable(int(v)) for v in s]
                out[2].append(np.array([min(max(int(v), -(1 << 63)), (1 << 63) - 1) for v in s], np.int64))
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
        return pa.Table.from_arrays([*[pa.array(x, pa.int64()) for x in flat], pa.array(order, pa.string())], ["query_id", "vec_id", "score", "exact"])

    found = q.groupBy("g", "s").cogroup(c.groupBy("g", "s")).applyInArrow(score, "query_id long, vec_id long, score long, exact string")
    order = Window.partitionBy("query_id").orderBy(F.desc("exact"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id query_id, b.vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::bigint score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select query_id, rank::integer rank, vec_id, score from r where rank <= 5
"""
