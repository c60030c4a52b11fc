"""Benchmark decontamination: edit-tolerant search for benchmark items in texts.

Texts and items are compared as their words (ASCII and Latin capitals folded)
joined by single spaces, in UTF-8 bytes.  A text matches an item if some part of
it is within ``RATE`` of the item's length in edits.

Every whole text is looked at.  Windows begin at every word of a text (and at
marks that follow from the letters inside very long words; at every byte for
items under ``SHORT`` bytes) and are as long as an item.  A CGK walk reads a
window: at each step it notes the byte under it and stays or goes on by a random
bit of step and byte, so strings at a small edit distance come to be at a small
Hamming distance.  Bit-sampling tables hash a few noted bytes; the tables of ``WALKS``
walks meet the items' own windows, taken at up to ``STARTS`` of their words.  All samples lie in the first steps of a walk, so no
walk goes further.  Windows that meet an item in a table and agree with it in
enough steps (Hamming distance) are candidates, and the place is verified by
exact edit distance (bit-parallel).  ``CLASSES`` says how many tables, samples
and steps items of a size take.  As an item is met from each of its words, the recall
stays near 1 up to the full rate, at any item length and kind of edit; tests
measure it against brute force.

Null and empty texts and items match nothing.  Repeated rows are searched row by
row.  Extra columns are ignored by ``find`` and kept by ``clean``.  Items are
sent to the executors in groups of at most ``ITEM_BYTES``, one pass a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import bounded_batches
from .textbuf import TextBlock, frugal, mix, raw_texts, text_slices

RATE = 0.1
ITEM_BYTES = 8 << 20
WALKS, STARTS = 2, 64
SHORT = 24
#: Item sizes that share tables: from how many bytes on, steps of a walk, tables a walk, samples a table, share of steps that must agree.
CLASSES = ((1, 1, 1, 1, 1.0), (2, 2, 1, 2, 1.0), (4, 4, 1, 3, 1.0), (8, 8, 4, 4, 0.6), (16, 16, 8, 4, 0.55), (24, 24, 8, 4, 0.55), (40, 40, 8, 4, 0.55), (80, 64, 4, 7, 0.7))
_FILTER_BITS = 22


def normalised(block: TextBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows, a space after each, as bytes; where each byte was; where each row begins."""
    keep = block.buf != 0
    keep[block.word_end] = True
    at = np.flatnonzero(keep)
    flat = block.buf[at]
    flat[flat == 0] = 32
    return flat, at, np.searchsorted(at, np.append(block.start, len(block.buf)))


def window_starts(flat: np.ndarray) -> np.ndarray:
    """Where words begin; inside words of more than 24 bytes also where a hash of the next four bytes says so."""
    mark = np.ones(len(flat), bool)
    np.equal(flat[:-1], 32, out=mark[1:])
    at = np.flatnonzero(mark)
    length = np.diff(np.append(at, len(flat)))
    long = np.flatnonzero(length > 24)
    if not len(long):
        return at
    own = np.repeat(long, length[long] - 4)
    more = at[own] + np.arange(len(own)) - np.repeat(np.cumsum(length[long] - 4) - (length[long] - 4), length[long] - 4)
    gram = sum(flat[more + k].astype(np.uint64) << np.uint64(8 * k) for k in range(4))
    mark[more[mix(gram) % np.uint64(4) == 0]] = True
    return np.flatnonzero(mark)


def walk_bits(steps: int = CLASSES[-1][1]) -> np.ndarray:
    """Whether each walk goes on after each step, by the byte it is on: bits of a hash."""
    key = np.arange(WALKS * steps * 256, dtype=np.uint64) + np.uint64(0x51ED27)
    return (mix(key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)).astype(np.int64).reshape(WALKS, steps, 256)


def walk(flat: np.ndarray, start: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """CGK embeddings of the windows at `start`: the byte noted at each step (steps x windows); flat is padded behind."""
    out = np.empty((len(bits), len(start)), np.uint8)
    # in runs that stay in the cache
    for a in range(0, len(start), 1 << 13):
        at = start[a : a + (1 << 13)].astype(np.int64)
        step = np.empty(len(at), np.int64)
        for j, go in enumerate(bits):
            noted = out[j, a : a + (1 << 13)]
            np.take(flat, at, out=noted, mode="clip")
            np.take(go, noted, out=step, mode="clip")
            at += step
    return out


def edit_end(item: bytes, text: bytes) -> tuple[int, int]:
    """Smallest edit distance of item to any part of text, and the first end of such a part (bit-parallel)."""
    m = len(item)
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        pv = ((mh << 1) | (full & ~(xv | ph))) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Items:
    """Benchmark items in the bit-sampling tables of their size's class."""

    def __init__(self, ids: list[int], texts: list[bytes], rate: float = RATE):
        norm = []
        for t in texts:
            flat, _, _ = normalised(TextBlock([t]))
            norm.append(flat.tobytes().strip())
        keep = [i for i, t in enumerate(norm) if t and ids[i] is not None]
        self.ids = np.array([ids[i] for i in keep], np.int64)
        self.text = [norm[i] for i in keep]
        self.size = np.array([len(t) for t in self.text], np.int64)
        self.edits = np.floor(rate * self.size + 1e-9).astype(np.int64)
        self.bits = walk_bits()
        self.classes = []
        edges = [c[0] for c in CLASSES] + [1 << 62]
        for (low, *rule), high in zip(CLASSES, edges[1:]):
            mine = np.flatnonzero((self.size >= low) & (self.size < high))
            if len(mine):
                self.classes.append(Tables(self, mine, low < SHORT, *rule))


class Tables:
    """The windows of some items by the bytes that each table samples."""

    def __init__(self, items: Items, mine: np.ndarray, every: bool, steps: int, tables: int, samples: int, agree: float):
        self.every, self.steps, self.need = every, steps, int(np.ceil(agree * steps))
        room = items.bits.shape[1]
        item, offset, start = [], [], []
        flat, at = [], 0
        for i in mine.tolist():
            text = np.frombuffer(items.text[i], np.uint8)
            own = np.arange(len(text)) if every else window_starts(text)
            own = own[own <= max(0, len(text) - steps // 3)]
            own = own[np.unique(np.linspace(0, len(own) - 1, min(len(own), STARTS)).astype(np.int64))]
            item.append(np.full(len(own), i))
            offset.append(own)
            start.append(own + at)
            flat += [text, np.zeros(room, np.uint8)]
            at += len(text) + room
        self.item, self.offset = np.concatenate(item), np.concatenate(offset)
        start, flat = np.concatenate(start), np.concatenate(flat)
        self.walks = [walk(flat, start, b[:steps]) for b in items.bits]
        rng = np.random.default_rng(17)
        self.samples = [[np.sort(rng.choice(steps, samples, replace=False)) for _ in range(tables)] for _ in range(WALKS)]
        key = [self.keys(w, t, self.walks[w]) for w in range(WALKS) for t in range(len(self.samples[w]))]
        entry = np.tile(np.arange(len(self.item)), len(key))
        key = np.concatenate(key)
        order = np.argsort(key, kind="stable")
        self.entry = entry[order]
        self.key, self.first = np.unique(key[order], return_index=True)
        self.first = np.append(self.first, len(key))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.key >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def keys(self, w: int, t: int, noted: np.ndarray) -> np.ndarray:
        key = np.full(noted.shape[1], w * 64 + t + 1, np.uint64)
        for j in self.samples[w][t].tolist():
            key *= np.uint64(0x9E3779B97F4A7C15)
            np.add(key, noted[j], out=key, casting="unsafe")
        return mix(key)

    def meet(self, walks: list[np.ndarray], start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, window start, place where the item would begin) of windows that meet an item's window in a table and agree with it."""
        items, starts, places = ([np.zeros(0, np.int64)] for _ in range(3))
        for w, noted in enumerate(walks):
            for t in range(len(self.samples[w])):
                key = self.keys(w, t, noted)
                at = np.flatnonzero(self.filter[(key >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
                k = np.minimum(np.searchsorted(self.key, key[at]), len(self.key) - 1)
                ok = self.key[k] == key[at]
                at, k = at[ok], k[ok]
                many = self.first[k + 1] - self.first[k]
                # windows of common words meet many items: taken in runs of bounded size
                edge = np.cumsum(many)
                a = 0
                while a < len(at):
                    z = max(a + 1, int(np.searchsorted(edge, (edge[a - 1] if a else 0) + (1 << 18), side="right")))
                    n = many[a:z]
                    own = np.repeat(np.arange(a, z), n)
                    entry = self.entry[np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + self.first[k[own]]]
                    window = at[own]
                    # most fail in the first half already
                    for steps in (slice(0, self.steps // 2), slice(0, self.steps)):
                        apart = (noted[steps, window] != self.walks[w][steps, entry]).sum(0)
                        near = apart <= self.steps - self.need
                        window, entry = window[near], entry[near]
                    items.append(self.item[entry])
                    starts.append(start[window])
                    places.append(starts[-1] - self.offset[entry])
                    a = z
        return np.concatenate(items), np.concatenate(starts), np.concatenate(places)


def places(items: Items, flat: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, item, first and last place where the item may begin) of all candidates, places near each other as one."""
    padded = np.concatenate((flat, np.zeros(items.bits.shape[1] + 1, np.uint8)))
    got = []
    for every in {c.every for c in items.classes}:
        classes = [c for c in items.classes if c.every == every]
        start = np.arange(len(flat)) if every else window_starts(flat)
        for at in range(0, len(start), 1 << 18):
            part = start[at : at + (1 << 18)]
            walks = [walk(padded, part, b[: max(c.steps for c in classes)]) for b in items.bits]
            for c in classes:
                item, where, place = c.meet(walks, part)
                row = np.searchsorted(begin, where, side="right") - 1
                got.append(np.unique(np.stack((row, item, place)), axis=1))
    row, item, place = np.unique(np.concatenate(got, axis=1), axis=1) if got else np.zeros((3, 0), np.int64)
    head = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (place[1:] - place[:-1] > 2 * items.edits[item[1:]] + 1)))) if len(row) else np.zeros(0, np.int64)
    tail = np.append(head[1:], len(row)) - 1 if len(row) else head
    return row[head], item[head], place[head], place[tail]


def search(items: Items, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
    """(row, item number, distance, start byte, stop byte), the best of each row and item."""
    if not len(items.ids):
        return []
    cand: list[tuple[int, int, bytes, int]] = []
    maps: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        stop, used = at, 0
        while stop < len(texts) and (stop == at or used + len(texts[stop]) <= 1 << 20):
            used += len(texts[stop])
            stop += 1
        block = TextBlock(texts[at:stop])
        flat, place, begin = normalised(block)
        for r, i, s, t in zip(*(x.tolist() for x in places(items, flat, begin))):
            lo, hi, n, e = int(begin[r]), int(begin[r + 1]), int(items.size[i]), int(items.edits[i])
            # a match begins within e of where its windows say
            a, z = max(lo, s - e), min(hi, t + n + 2 * e)
            cand.append((at + r, i, flat[a:z].tobytes(), len(maps)))
            maps.append(place[a:z] - int(block.start[r]))
        at = stop
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    seen: set[tuple[int, int, bytes]] = set()
    for row, i, text, m in cand:
        if (row, i, text) in seen:
            continue
        seen.add((row, i, text))
        distance, end = edit_end(items.text[i], text)
        if distance > items.edits[i]:
            continue
        back, length = edit_end(items.text[i][::-1], text[:end][::-1])
        got = (distance, int(maps[m][max(end - length, 0)]), int(maps[m][end - 1]) + 1)
        if (row, i) not in best or got < best[row, i]:
            best[row, i] = got
    return [(r, i, *v) for (r, i), v in sorted(best.items())]


def item_groups(benchmark: DataFrame, rate: float = RATE):
    """Broadcasts of Items, each of at most about ITEM_BYTES of text."""
    bounded_batches(benchmark.sparkSession)
    text = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-total // ITEM_BYTES) or 1
    for g in range(groups):
        rows = text.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).orderBy("item_id", "text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Items([r["item_id"] for r in rows], [r["text"].encode() for r in rows], rate))


FOUND = "doc_id long, item_id long, distance int, start_byte int, stop_byte int"


def find(documents: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """One row for each document and item it holds: the best place and its edit distance."""
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for shared in item_groups(benchmark, rate):

        def run(batches, shared=shared):
            items = shared.value
            for batch in batches:
                for a, z in text_slices(batch.column(1), 16 << 20):
                    got = search(items, raw_texts(batch.column(1)[a:z]))
                    ids = batch.column(0)[a:z].take(pa.array([g[0] for g in got], pa.int64()))
                    cols = [pa.array([g[k] for g in got], pa.int32()) for k in (2, 3, 4)]
                    yield pa.RecordBatch.from_arrays([ids, pa.array([int(items.ids[g[1]]) for g in got], pa.int64()), *cols], ["doc_id", "item_id", "distance", "start_byte", "stop_byte"])

        found = base.mapInArrow(frugal(run), FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def clean(documents: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents, with all their columns, that hold no item."""
    at = documents.columns.index("text")
    for shared in item_groups(benchmark, rate):

        def run(batches, shared=shared):
            items = shared.value
            for batch in batches:
                for a, z in text_slices(batch.column(at), 16 << 20):
                    keep = np.ones(z - a, bool)
                    keep[[g[0] for g in search(items, raw_texts(batch.column(at)[a:z]))]] = False
                    yield batch.slice(a, z - a).filter(pa.array(keep))

        documents = documents.mapInArrow(frugal(run), documents.schema)
    return documents
