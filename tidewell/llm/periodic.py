"""Stretches of words that repeat with a period, found by Karp-Miller-Rosenberg naming.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) of at least ``max(MIN_WORDS, TIMES * q)`` words that no neighbouring
word extends keeping the period.

Every place of a batch of texts gets a name for the 2**k words that begin there:
names of level k + 1 are the ranks of pairs of names of level k, so equal names
mean equal words and no hash is taken.  A name belongs to one text, and a place
whose name is alone gets none, so higher levels shrink to what does repeat.  The
longest common extension of two places follows the levels downwards.  A run of
period q with four turns holds a place i divisible by 2q with q equal words from
i and i + q on, so those grid places are the only candidates; each that passes one
comparison of names is extended to both sides.  Multiples of a smaller period give
the same stretch and leave with it.

Each text is handled alone, whatever its length; texts are taken in slices of
about a megabyte, and candidates in chunks, so a longer text only costs memory of
its own: 4 bytes for each word and level on which something repeats.  Null texts
have no words.  Every row counts for itself, with or without a doc_id; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import bounded_batches
from .textbuf import frugal, raw_texts, text_slices

MIN_WORDS, TIMES = 6, 4
#: Candidates that are looked at together.
CHUNK = 1 << 20

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def _ranked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of pairs in order of their sizes, and how often each occurs."""
    key = a.astype(np.int64) << np.int64(32) | b.astype(np.int64)
    _, name, times = np.unique(key, return_inverse=True, return_counts=True)
    return name, times


def names(words: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    """Levels of names for words numbered over all texts, `owner` the text of each; one more place at the end has none.

    Places with equal names (from 0) at level k begin with the same 2**k words of one text.
    """
    n = len(words)
    levels: list[np.ndarray] = []
    at = np.arange(n)
    left, right = owner, words
    while len(at):
        name, times = _ranked(left, right)
        again = times[name] > 1
        at, name = at[again], name[again]
        level = np.full(n + 1, -1, np.int32)
        level[at] = name
        levels.append(level)
        size = 1 << (len(levels) - 1)
        # the second half must lie in the text, and repeat in it as well
        half = np.minimum(at + size, n)
        right = level[half]
        use = (right >= 0) & (owner[np.minimum(half, n - 1)] == owner[at])
        at, left, right = at[use], name[use], right[use]
    return levels


def extension(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words from places a and b on are equal; with `back`, how many before them."""
    n = len(levels[0]) - 1
    got = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        x, y = (a - got - size, b - got - size) if back else (a + got, b + got)
        x, y = np.where((x < 0) | (x > n), n, x), np.where((y < 0) | (y > n), n, y)
        name = levels[k][x]
        got += size * ((name >= 0) & (name == levels[k][y]))
    return got


def _grid(begin: np.ndarray, size: np.ndarray, first: int):
    """Candidates (place, period) of periods from `first` to twice that: every 2q-th word of each text, in chunks."""
    upto = np.minimum(size // TIMES, 2 * first - 1)
    upto[size < MIN_WORDS] = 0
    many = np.maximum(upto - first + 1, 0)
    own = np.repeat(np.arange(len(size)), many)
    q = first + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
    steps = -(-size[own] // (2 * q))
    total = np.cumsum(steps)
    at = 0
    while at < len(q):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK, side="right")))
        n = steps[at:stop]
        turn = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        each = np.repeat(q[at:stop], n)
        yield np.repeat(begin[own[at:stop]], n) + 2 * each * turn, each
        at = stop


def _least(rows: np.ndarray) -> np.ndarray:
    """Of rows (start, stop, period) those with the smallest period of each stretch, in order."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return rows[new]


def runs_of(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows (start, stop, period) of all runs of some texts, places counted over all; `size` words belong to each text."""
    n = int(size.sum())
    none = np.zeros((0, 3), np.int64)
    if not n:
        return none
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(size)), size)
    levels = names(words, owner)
    if not levels:
        return none
    period, upto = np.zeros(n, np.int64), np.zeros(n, np.int64)  # a run around each place that is known already
    found = [none]
    first, longest = 1, int(size.max()) // TIMES
    while first <= longest:
        level = first.bit_length() - 1  # its names stand for `first` words
        if level >= len(levels):
            break  # nothing of that length repeats
        for place, q in _grid(end - size, size, first):
            name = levels[level][place]
            may = (name >= 0) & (name == levels[level][np.minimum(place + q, n)])
            place, q = place[may], q[may]
            known = period[place]
            # inside a run of a period that divides q there is nothing else of period q
            fresh = (known == 0) | (q % np.maximum(known, 1) != 0) | (place + 2 * q > upto[place])
            place, q = place[fresh], q[fresh]
            start = place - extension(levels, place, place + q, back=True)
            stop = place + q + extension(levels, place, place + q)
            long = stop - start >= np.maximum(MIN_WORDS, TIMES * q)
            # a multiple of the period seen from near the end of a run that is known
            long &= (known[fresh] == 0) | (q % np.maximum(known[fresh], 1) != 0) | (stop != upto[place])
            new = _least(np.stack((start[long], stop[long], q[long]), 1))
            found.append(new)
            for s, e, p in new[np.argsort(-new[:, 2], kind="stable")].tolist():
                period[s:e], upto[s:e] = p, e
        first *= 2
    return _least(np.concatenate(found))


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of some texts, and how many each text has."""
    known: dict[bytes, int] = {}
    size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    number = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, int(size.sum()))
    return number, size


def _kept(words: list[bytes], own: np.ndarray) -> bytes:
    """Words outside the later turns of all runs (rows start, stop, period)."""
    if not len(own):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, own[:, 0] + own[:, 2], 1)
    np.add.at(edge, own[:, 1], -1)
    return b" ".join(words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist())


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(documents: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period) and collapsed of every row.

    Words are `[^\\x20\\x09-\\x0D]+`; `collapsed` has them joined by one space, each
    run cut to its first turn.  `rewrite(doc_id, words)` may change a text's words first.
    """

    def run(batches):
        for batch in batches:
            for a, z in text_slices(batch.column(1)):
                ids = batch.column(0)[a:z]
                texts = [t.split() for t in raw_texts(batch.column(1)[a:z])]
                if rewrite is not None:
                    texts = [rewrite(i, t) for i, t in zip(ids.to_pylist(), texts)]
                number, size = _numbered(texts)
                found = runs_of(number, size)
                begin = np.cumsum(size) - size
                # runs come in order of their places, so in order of texts
                bound = np.searchsorted(found[:, 0], np.append(begin, int(size.sum())))
                own = [found[s:e] - np.array([b, b, 0]) for s, e, b in zip(bound[:-1].tolist(), bound[1:].tolist(), begin.tolist())]
                flat = np.concatenate([o[np.lexsort((o[:, 2], o[:, 0]))] for o in own])
                parts = [pa.array(v) for v in (flat[:, 0], flat[:, 1] - flat[:, 0], flat[:, 2])]
                offset = np.concatenate(([0], np.cumsum([len(o) for o in own]))).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offset), pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
                collapsed = pa.array([_kept(t, o).decode() for t, o in zip(texts, own)], pa.string())
                yield pa.RecordBatch.from_arrays([ids, listed.cast(_RUNS), collapsed], ["doc_id", "runs", "collapsed"])

    bounded_batches(documents.sparkSession)
    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(frugal(run), "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of all texts, by a checksum of their doc_id, repeat a stretch of their own to the end; texts without doc_id don't."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def digests(found: DataFrame) -> DataFrame:
    """The report of `periodic_runs`: number of runs, the longest one (ties: smallest start, then period) and digests of runs and words."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = found.withColumn("best", best)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
