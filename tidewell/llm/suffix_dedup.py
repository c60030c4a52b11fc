"""Exact removal of repeated byte strings with logarithmic families of suffix arrays.

A byte goes if some string of ``MATCH`` bytes that covers it also starts earlier:
in a text with a smaller doc_id or earlier in the same text.

Suffixes are sampled by content: every window of MATCH bytes has an anchor, the
leftmost of its ``GRAM``-byte strings with the least hash, so equal windows have
equal anchors at equal offsets.  Anchors that occur once in the corpus are left
out.  The others go, with the bytes of the windows they stand for, to shards by
anchor.  A shard takes its anchors in text order in batches: a batch gets the
suffix array of its windows, which is merge-scanned against the existing levels
for matches of full length, and is then added as a level; levels of equal size
merge geometrically.  Windows of an anchor that occurs more than ``HOT`` times
are dealt to shards one by one, by a hash of all their bytes, and each different
one is sent once by every part; they go through the same families, so the answer
is exact and no shard gathers a frequent passage.  What parts and shards send to
each other goes in hops (``deal``), so packets grow with the input, not with its
square; equal windows that meet on the way are sent on once.

Order: doc_id, nulls last, then the text's digest.  Of identical texts only the
first is searched; a later copy of MATCH bytes or more goes whole.  Rows that
repeat doc_id and text count as later copies of the first of them.  Null texts
count as empty; texts under MATCH bytes stay as they are.  Extra columns are
ignored by ``repeats`` and kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .deal import FAN, Route, picks
from .lineage import bounded_batches, cut
from .textbuf import frugal, frugal_cogroup, frugal_group, mix, raw_texts, text_slices

MATCH, GRAM = 100, 24
HOT = 4096
BATCH, SCAN = 1 << 16, 1 << 14
_POS_BITS = 31  # no string is longer
_LAST = (1 << 63) - 1
_RAND = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_B1 = 0x5851F42D4C957F2D
PART_BYTES = 16 << 20


def rolling(data: np.ndarray, width: int, base: int) -> np.ndarray:
    """64-bit polynomial hash of every run of `width` bytes, by doubling."""
    with np.errstate(over="ignore"):
        h, size, out, done = _RAND[data], 1, None, 0
        while True:
            if width & size:  # stands before the `done` bytes that are there already
                n = len(data) - done - size + 1
                out = h if out is None else h[:n] * np.uint64(pow(base, done, 1 << 64)) + out[size : size + n]
                done += size
            if size * 2 > width:
                break
            h = h[: len(h) - size] * np.uint64(pow(base, size, 1 << 64)) + h[size:]
            size *= 2
    return out


def anchors(data: np.ndarray, begin: np.ndarray, end: np.ndarray, match: int = MATCH, gram: int = GRAM):
    """Anchors of all windows inside rows [begin, end): (hash, position, first window, last window), in order."""
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    if len(data) < match:
        return none
    hashed = mix(rolling(data, gram, _B1))
    low = (hashed & np.uint64(((1 << 64) - 1) ^ ((1 << _POS_BITS) - 1))) | np.arange(len(hashed), dtype=np.uint64)
    width, size = match - gram + 1, 1
    while size * 2 <= width:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    inside = np.zeros(len(data) + 1, np.int8)
    has = end - begin >= match
    np.add.at(inside, begin[has], 1)
    np.add.at(inside, end[has] - match + 1, -1)
    start = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8)[: len(low)] > 0)
    if not len(start):
        return none
    at = (low[start] & np.uint64((1 << _POS_BITS) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.append(new[1:], len(at)) - 1
    return hashed[at[new]], at[new], start[new], start[last]


class Family:
    """Levels of sorted windows; a window is given by its place in a text buffer."""

    def __init__(self, match: int = MATCH):
        self.match = match
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (text buffer, suffix array), largest first

    def _keys(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(sliding_window_view(text, self.match)[at]).view(f"S{self.match}").ravel()

    def add(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each window, in order, has occurred before: in a level or earlier in this batch."""
        if not len(at):
            return np.zeros(0, bool)
        keys = self._keys(text, at)
        order = np.argsort(keys, kind="stable")
        sorted_keys = keys[order]
        repeat = np.concatenate(([False], sorted_keys[1:] == sorted_keys[:-1]))
        for level_text, level in self.levels:
            repeat |= self._scan(level_text, level, text, at[order])[1]
        fresh = order[~repeat]
        if len(fresh):
            self._push(text, at[fresh])
        out = np.empty(len(at), bool)
        out[order] = repeat
        return out

    def _scan(self, text: np.ndarray, array: np.ndarray, other_text: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge scan of two sorted arrays: how many entries of the first come before each one of the other, and whether an equal one is there."""
        before, same, done = np.full(len(other), len(array), np.int64), np.zeros(len(other), bool), 0
        for at in range(0, len(array), SCAN):
            have = self._keys(text, array[at : at + SCAN])
            while done < len(other):
                part = self._keys(other_text, other[done : done + SCAN])
                stop = int(np.searchsorted(part, have[-1], side="right"))
                spot = np.searchsorted(have, part[:stop])
                before[done : done + stop] = at + spot
                same[done : done + stop] = have[spot] == part[:stop]
                done += stop
                if stop < len(part):
                    break
        return before, same

    def _push(self, text: np.ndarray, array: np.ndarray) -> None:
        while self.levels and len(self.levels[-1][1]) <= len(array):
            old_text, old = self.levels.pop()
            # where each entry of the new array comes to stand between those of the old one
            spot = self._scan(old_text, old, text, array)[0] + np.arange(len(array))
            both = np.empty(len(old) + len(array), np.int64)
            from_old = np.ones(len(both), bool)
            from_old[spot] = False
            both[spot], both[from_old] = array + len(old_text), old
            text, array = np.concatenate((old_text, text)), both
        self.levels.append((text, array))


def _leaders(data: np.ndarray, at: np.ndarray, hashed: np.ndarray, match: int = MATCH) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of `data` at some places: which are the first of their content, and for each the first one with its content.

    Hashes only sort; bytes decide.  Windows with one hash and other bytes lead for themselves.
    """
    order = np.argsort(hashed, kind="stable")
    view = sliding_window_view(data, match)
    new = np.ones(len(at), bool)
    for k in range(1, len(order), 1 << 16):
        a, b = order[k - 1 : k - 1 + (1 << 16)], order[k : k + (1 << 16)]
        a = a[: len(b)]
        equal = hashed[a] == hashed[b]
        equal[equal] = (view[at[a[equal]]] == view[at[b[equal]]]).all(1)
        new[k : k + len(b)] = ~equal
    group = np.cumsum(new) - 1
    lead = order[new]
    same = np.empty(len(at), np.int64)
    same[order] = lead[group]
    return np.sort(lead), same


# ---- parts: groups of texts that stay together through all steps ----


def _open(table: pa.Table, firsts: pa.Table | None):
    """Texts of a part that are searched, in order: (row number, doc_id, bytes) and the table's sorted rows."""
    if "doc_id" not in table.column_names:  # a part without texts
        return []
    ids = [_LAST if i is None else i for i in table.column("doc_id").to_pylist()]
    keys = table.column("digest").to_pylist()
    packed = table.column("z")
    order = sorted(range(len(ids)), key=lambda i: (ids[i], keys[i], not packed[i].is_valid))
    wanted = None if firsts is None else set(zip(firsts.column("owner").to_pylist(), firsts.column("mark").to_pylist()))
    unpacker = zstandard.ZstdDecompressor()
    texts, seen = [], set()
    for rank, i in enumerate(order):
        mark = (ids[i], keys[i])
        if mark in seen or not packed[i].is_valid or (wanted is not None and mark not in wanted):
            continue
        seen.add(mark)
        texts.append((rank, ids[i], unpacker.decompress(packed[i].as_py()), i))
    return texts


def _runs(texts, limit: int = 1 << 20):
    """Texts in runs of about `limit` bytes, each as one buffer with the rows' bounds."""
    at = 0
    while at < len(texts):
        stop, used = at, 0
        while stop < len(texts) and (stop == at or used + len(texts[stop][2]) <= limit):
            used += len(texts[stop][2])
            stop += 1
        sizes = np.array([len(t[2]) for t in texts[at:stop]], np.int64)
        end = np.cumsum(sizes)
        yield texts[at:stop], np.frombuffer(b"".join(t[2] for t in texts[at:stop]), np.uint8), end - sizes, end
        at = stop


_PACK = zstandard.ZstdCompressor(level=1)


def _blob(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[len(a.tobytes()) for a in arrays]], np.int64).tobytes()
    return _PACK.compress(head + b"".join(a.tobytes() for a in arrays))


def _unblob(blob: bytes, *kinds) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = len(kinds)
    size = np.frombuffer(data, np.int64, n, 8)
    at = 8 + 8 * n + np.cumsum(size) - size
    return [np.frombuffer(data, k, int(s) // np.dtype(k).itemsize, int(a)) for k, s, a in zip(kinds, size, at)]


_SIDE_PA = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("owner", pa.int64()), ("mark", pa.binary()), ("blob", pa.binary())])
_PACKET = "kind int, place long, blob binary"
_PACKET_PA = pa.schema([("kind", pa.int32()), ("place", pa.int64()), ("blob", pa.binary())])
FIRSTS, KNOWN, RANGES, ANCHORS, STRETCHES, SINGLES = range(6)
#: What packets hold; the columns after a stretch's reference have one entry for each different stretch.
_COLUMNS = {
    KNOWN: {"part": np.int64, "hash": np.uint64, "hot": np.uint8},
    RANGES: {"part": np.int64, "row": np.int32, "first": np.int32, "last": np.int32},
    ANCHORS: {"part": np.int64, "hash": np.uint64, "times": np.uint16},
    STRETCHES: {"part": np.int64, "doc": np.int64, "row": np.int32, "first": np.int32, "last": np.int32, "ref": np.int32, "size": np.int32, "hash": np.uint64, "text": np.uint8},
    SINGLES: {"part": np.int64, "doc": np.int64, "row": np.int32, "place": np.int32, "hash": np.uint64, "text": np.uint8},
}


def _merged(kind: int, blobs: list[bytes]) -> dict[str, np.ndarray]:
    """The columns of packets of one kind, one after the other."""
    names = list(_COLUMNS[kind])
    got = [dict(zip(names, _unblob(b, *_COLUMNS[kind].values()))) for b in blobs]
    if kind == STRETCHES:
        base = np.cumsum([0] + [len(g["size"]) for g in got])
        for g, b in zip(got, base.tolist()):
            g["ref"] = g["ref"] + np.int32(b)
    return {c: np.concatenate([np.zeros(0, k), *[g[c] for g in got]]) for c, k in _COLUMNS[kind].items()}


def _goal(kind: int, columns: dict[str, np.ndarray], route: Route) -> np.ndarray:
    if kind in (KNOWN, RANGES):
        return columns["part"]
    goal = route.goal(columns["hash"])
    return goal[columns["ref"]] if kind == STRETCHES else goal


def _packets(kind: int, columns: dict[str, np.ndarray], to: np.ndarray) -> list[dict]:
    """One packet for each place in `to`."""
    rows = []
    if kind == STRETCHES:
        size = columns["size"].astype(np.int64)
        begin = np.cumsum(size) - size
    for place, at in picks(to):
        if kind == STRETCHES:
            lead, ref = np.unique(columns["ref"][at], return_inverse=True)
            shift = np.cumsum(size[lead]) - size[lead]
            take = np.repeat(begin[lead] - shift, size[lead]) + np.arange(int(size[lead].sum()))
            own = [*[columns[c][at] for c in ("part", "doc", "row", "first", "last")], ref, columns["size"][lead], columns["hash"][lead], columns["text"][take]]
        elif kind == SINGLES:
            own = [*[columns[c][at] for c in ("part", "doc", "row", "place", "hash")], columns["text"].reshape(-1, MATCH)[at]]
        else:
            own = [c[at] for c in columns.values()]
        rows.append({"kind": kind, "place": place, "blob": _blob(*[a.astype(k, copy=False) for a, k in zip(own, _COLUMNS[kind].values())])})
    return rows


def _in_order(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Single windows in text order."""
    order = np.lexsort((columns["place"], columns["row"], columns["part"], columns["doc"]))
    return {c: (v.reshape(-1, MATCH)[order].reshape(-1) if c == "text" else v[order]) for c, v in columns.items()}


def _starts(columns: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    place = columns["place"][at]
    return {"part": columns["part"][at], "row": columns["row"][at], "first": place, "last": place}


def _relay(route: Route, hop: int, back: bool):
    """What stands at a place, one hop nearer to its goal; ranges that are found on the way wait for the way back."""

    def run(key, table):
        kind, here = (k.as_py() for k in key)
        if kind == RANGES and not back:
            return table.select(_PACKET_PA.names)
        columns, rows = _merged(kind, table.column("blob").to_pylist()), []
        if kind == SINGLES:
            # of equal windows only the first goes on, so a frequent one does not pile up at its shard
            columns = _in_order(columns)
            lead, _ = _leaders(columns["text"], np.arange(len(columns["place"])) * MATCH, columns["hash"])
            again = np.ones(len(columns["place"]), bool)
            again[lead] = False
            found = _starts(columns, np.flatnonzero(again))
            rows = _packets(RANGES, found, np.full(len(found["part"]), here))
            columns = {c: (v.reshape(-1, MATCH)[lead].reshape(-1) if c == "text" else v[lead]) for c, v in columns.items()}
        rows += _packets(kind, columns, route.toward(here, _goal(kind, columns, route), hop))
        return pa.Table.from_pylist(rows, schema=_PACKET_PA)

    return run


def _sent(packets: DataFrame, route: Route, back: bool = False) -> DataFrame:
    """Packets after all hops but the first, which the sender has made."""
    for hop in range(1, route.hops):
        packets = packets.groupBy("kind", "place").applyInArrow(frugal_group(_relay(route, hop, back)), _PACKET)
    return packets


def _of_kind(table: pa.Table, kind: int) -> pa.Table:
    if "kind" not in table.column_names:  # the part has nothing on this side
        return _SIDE_PA.empty_table()
    return table.filter(pa.compute.equal(table.column("kind"), kind))


def _anchor_step(route: Route):
    """Distinct anchors of a part, and how often each occurs there, dealt to shards."""

    def run(key, left, right):
        me = key[0].as_py()
        found = [anchors(data, b, e)[0] for _, data, b, e in _runs(_open(left, _of_kind(right, FIRSTS)))]
        hashed, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
        columns = {"part": np.full(len(hashed), me), "hash": hashed, "times": np.minimum(times, 1 << 15)}
        return pa.Table.from_pylist(_packets(ANCHORS, columns, route.toward(me, route.goal(hashed), 0)), schema=_PACKET_PA)

    return run


def _repeated_step(route: Route, often: int):
    """For every part, which of its anchors occur twice or more in the corpus, and which more than `often` times."""

    def run(key, table):
        columns = _merged(ANCHORS, table.column("blob").to_pylist())
        value, place = np.unique(columns["hash"], return_inverse=True)
        total = np.bincount(place, columns["times"], len(value))[place]
        again = np.flatnonzero(total > 1)
        columns = {"part": columns["part"][again], "hash": columns["hash"][again], "hot": total[again] > often}
        return pa.Table.from_pylist(_packets(KNOWN, columns, route.toward(key[1].as_py(), columns["part"], 0)), schema=_PACKET_PA)

    return run


def _window_step(route: Route):
    """Windows of a part's repeated anchors, dealt to shards; equal stretches are sent once."""

    def run(key, left, right):
        side = _merged(KNOWN, _of_kind(right, KNOWN).column("blob").to_pylist())
        if not len(side["hash"]):
            return _PACKET_PA.empty_table()
        order = np.argsort(side["hash"])
        known, hot = side["hash"][order], side["hot"][order]
        texts = _open(left, _of_kind(right, FIRSTS))
        data = b"".join(t[2] for t in texts)
        whole, done = np.frombuffer(data, np.uint8), 0
        # stretches and windows are kept as places in `whole`; their bytes are taken shard by shard
        cold: list[tuple] = []
        marks: list[tuple] = []
        later: list[tuple] = []
        for some, buffer, begin, end in _runs(texts):
            hashed, at, first, last = anchors(buffer, begin, end)
            spot = np.minimum(np.searchsorted(known, hashed), len(known) - 1)
            use = known[spot] == hashed
            hashed, first, last, often = hashed[use], first[use], last[use], hot[spot[use]] > 0
            row = np.searchsorted(end, first, side="right")
            doc = np.array([t[1] for t in some], np.int64)
            rank = np.array([t[0] for t in some], np.int32)
            own = row[~often]
            cold.append((hashed[~often], doc[own], rank[own], (first[~often] - begin[own]).astype(np.int32), (last[~often] - begin[own]).astype(np.int32), first[~often] + done))
            if often.any():
                many = last[often] - first[often] + 1
                own = np.repeat(row[often], many)
                place = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[often], many)
                key_of = mix(rolling(buffer, MATCH, _B1)[place])
                # texts come in order, so the first of equal windows stands first
                lead, same = _leaders(buffer, place, key_of)
                follow = np.flatnonzero(same != np.arange(len(place)))
                later.append((rank[own[follow]], (place[follow] - begin[own[follow]]).astype(np.int32)))
                place, own = place[lead], own[lead]
                marks.append((key_of[lead], doc[own], rank[own], (place - begin[own]).astype(np.int32), place + done))
            done += len(buffer)
        del texts
        rows = []
        me = key[0].as_py()
        if cold:
            hashed, doc, row, first, last, begin = (np.concatenate(x) for x in zip(*cold))
            del cold
            size = last - first + MATCH
            for place, at in picks(route.toward(me, route.goal(hashed), 0)):
                # equal stretches have one anchor and so one shard; they are sent once, and referred to
                seen: dict[bytes, int] = {}
                ref = np.array([seen.setdefault(data[i : i + n], len(seen)) for i, n in zip(begin[at].tolist(), size[at].tolist())], np.int32)
                lead = at[np.unique(ref, return_index=True)[1]]
                blob = _blob(np.full(len(at), me, np.int64), doc[at], row[at], first[at], last[at], ref, size[lead].astype(np.int32), hashed[lead], np.frombuffer(b"".join(seen), np.uint8))
                rows.append({"kind": STRETCHES, "place": place, "blob": blob})
        if marks:
            key_of, doc, rank, place, begin = (np.concatenate(x) for x in zip(*marks))
            del marks
            lead, same = _leaders(whole, begin, key_of)
            follow = np.flatnonzero(same != np.arange(len(begin)))
            later.append((rank[follow], place[follow]))
            row, at = (np.concatenate(x) for x in zip(*later))
            rows += _packets(RANGES, {"part": np.full(len(row), me), "row": row, "first": at, "last": at}, np.full(len(row), me))
            view = sliding_window_view(whole, MATCH)
            for goal, at in picks(route.toward(me, route.goal(key_of[lead]), 0)):
                pick = lead[at]
                rows.append({"kind": SINGLES, "place": goal, "blob": _blob(np.full(len(pick), me, np.int64), doc[pick], rank[pick], place[pick], key_of[pick], view[begin[pick]])})
        return pa.Table.from_pylist(rows, schema=_PACKET_PA)

    return run


def _shard_step(route: Route):
    """Which windows of a shard occurred before: ranges of window starts for every part."""

    def run(key, table):
        kind, here = (k.as_py() for k in key)
        blobs = table.column("blob").to_pylist()
        columns = _windows(blobs) if kind == SINGLES else _family(blobs) if kind == STRETCHES else _merged(RANGES, blobs)
        return pa.Table.from_pylist(_packets(RANGES, columns, route.toward(here, columns["part"], 0)), schema=_PACKET_PA)

    return run


def _windows(blobs: list[bytes]) -> dict[str, np.ndarray]:
    """Single windows of hot anchors through a family, in text order."""
    columns = _in_order(_merged(SINGLES, blobs))
    window = columns["text"].reshape(-1, MATCH)
    family, again = Family(), np.zeros(len(window), bool)
    for at in range(0, len(window), BATCH):
        batch = window[at : at + BATCH]
        again[at : at + BATCH] = family.add(batch.reshape(-1), np.arange(len(batch)) * MATCH)
    return _starts(columns, np.flatnonzero(again))


def _family(blobs: list[bytes]) -> dict[str, np.ndarray]:
    """Stretches of repeated anchors through a family, in text order."""
    part, doc, row, first, last, stretch, size, anchor, text = _merged(STRETCHES, blobs).values()
    size = size.astype(np.int64)
    begin = np.cumsum(size) - size
    data = text.tobytes()
    seen: dict[bytes, int] = {}
    same = np.fromiter((seen.setdefault(data[a : a + n], k) for k, (a, n) in enumerate(zip(begin.tolist(), size.tolist()))), np.int64, len(size))
    stretch = same[stretch]
    del seen, data
    order = np.lexsort((first, row, part, doc))
    lead = np.zeros(len(order), bool)
    lead[np.unique(stretch[order], return_index=True)[1]] = True
    whole = order[~lead]  # an equal stretch stands earlier
    out = [(part[whole], row[whole], first[whole], last[whole])]
    family = Family()
    leaders = order[lead]
    # a stretch can only meet others of its anchor
    _, place, times = np.unique(anchor[stretch[leaders]], return_inverse=True, return_counts=True)
    leaders = leaders[times[place] > 1]
    many = (last[leaders] - first[leaders] + 1).astype(np.int64)
    upto = np.cumsum(many)
    at = 0
    while at < len(leaders):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BATCH, side="right")))
        batch = leaders[at:stop]
        n = many[at:stop]
        piece = stretch[batch]
        own = np.repeat(np.arange(len(batch)), n)
        step = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        # only this batch's stretches go into its level
        length = size[piece]
        shift = np.cumsum(length) - length
        take = np.repeat(begin[piece] - shift, length) + np.arange(int(length.sum()))
        repeat = family.add(text[take], shift[own] + step)
        hit = np.flatnonzero(repeat)
        start = first[batch][own[hit]] + step[hit]
        out.append((part[batch][own[hit]], row[batch][own[hit]], start, start))
        at = stop
    return dict(zip(_COLUMNS[RANGES], (np.concatenate(x) for x in zip(*out))))


def _span_step(key, left, right):
    """Removed spans and what is left of every text of a part that is searched, with the carried columns."""
    texts = _open(left, _of_kind(right, FIRSTS))
    _, row, first, last = _merged(RANGES, _of_kind(right, RANGES).column("blob").to_pylist()).values()
    order = np.lexsort((first, row))
    row, first, last = row[order], first[order].astype(np.int64), last[order].astype(np.int64) + MATCH
    all_spans, all_kept = [], []
    for rank, _, text, _ in texts:
        a, z = np.searchsorted(row, [rank, rank + 1])
        spans, kept, done = [], [], 0
        for s, e in zip(first[a:z].tolist(), last[a:z].tolist()):
            if spans and s <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], e)
            else:
                spans.append([s, e])
        for s, e in spans:
            kept.append(text[done:s])
            done = e
        kept.append(text[done:])
        all_spans.append([{"start": s, "stop": e} for s, e in spans])
        all_kept.append(b"".join(kept))
    mine = left.take(pa.array([t[3] for t in texts], pa.int64()))
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    carried = [c for c in mine.column_names if c.startswith("c")]
    columns = [mine.column("doc_id"), mine.column("n"), pa.array(all_spans, span), pa.array([t[2] for t in texts], pa.binary()), pa.array(all_kept, pa.binary()), *[mine.column(c) for c in carried]]
    return pa.Table.from_arrays(columns, ["doc_id", "n_bytes", "spans", "text", "kept", *carried])


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))


def _part(parts: int):
    """A text's part: rows without an id or with one id are spread by what they hold."""
    return F.pmod(F.xxhash64("doc_id", "digest"), F.lit(parts)).alias("part")


def _packed(documents: DataFrame, carry: list[T.StructField]) -> DataFrame:
    """doc_id, digest, n, z (packed text), times and the carried columns.

    Of rows of one task that repeat doc_id and text only the first is packed; a
    row without z counts the others.
    """
    names = ["doc_id", "digest", "n", "z", "times", *[f.name for f in carry]]

    def run(batches):
        packer = zstandard.ZstdCompressor(level=1)
        seen: dict[tuple, list] = {}
        kinds = None
        for batch in batches:
            kinds = batch.schema
            for a, z in text_slices(batch.column(1)):
                texts = raw_texts(batch.column(1)[a:z])
                digest = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
                new = []
                for k, mark in enumerate(zip(batch.column(0)[a:z].to_pylist(), digest)):
                    if mark in seen:
                        seen[mark][0] += 1
                    else:
                        seen[mark] = [0, len(texts[k])]
                        new.append(k)
                part, at = batch.slice(a, z - a), pa.array(new, pa.int64())
                made = [pa.array([digest[k] for k in new], pa.binary()), pa.array([len(texts[k]) for k in new], pa.int64()), pa.array([packer.compress(texts[k]) for k in new], pa.binary()), pa.array([1] * len(new), pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), *made, *[part.column(k).take(at) for k in range(2, part.num_columns)]], names)
        more = [(*mark, n, times) for mark, (times, n) in seen.items() if times]
        if more:
            ids, digest, size, times = zip(*more)
            made = [pa.array(ids, pa.int64()), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.nulls(len(more), pa.binary()), pa.array(times, pa.int64())]
            yield pa.RecordBatch.from_arrays([*made, *[pa.nulls(len(more), kinds.field(k).type) for k in range(2, len(kinds))]], names)

    kinds = [T.LongType(), T.BinaryType(), T.LongType(), T.BinaryType(), T.LongType()]
    fields = [T.StructField(c, k) for c, k in zip(names, kinds)]
    long = documents.where(F.octet_length("text") >= MATCH)
    return long.select("doc_id", "text", *[f.name for f in carry]).mapInArrow(frugal(run), T.StructType([*fields, *[T.StructField(f.name, f.dataType) for f in carry]]))


def repeats(documents: DataFrame, carry: list[str] | None = None, copies: bool = True, hot: int = HOT, fan: int = FAN) -> DataFrame:
    """doc_id, n_bytes, spans (removed, in bytes), text and kept (bytes) of every row.

    Carried columns come back as c0, c1, ...  Without `copies`, rows that go
    whole as later copies are left out.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    fields = [T.StructField(f"c{k}", documents.schema[c].dataType) for k, c in enumerate(carry or [])]
    named = [F.col(f"`{c}`").alias(f.name) for c, f in zip(carry or [], fields)]
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *named)
    # parts and shards follow the amount of text, so neither outgrows a task
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // PART_BYTES))
    # every later step needs the texts by part, so they are dealt out once, packed
    held = _packed(base, fields).withColumn("part", _part(width)).repartition(width, "part").persist(StorageLevel.DISK_ONLY)
    same = held.groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(_LAST))).alias("doc_id"))
    firsts = same.select(F.when(F.col("doc_id") < _LAST, F.col("doc_id")).alias("doc_id"), F.col("doc_id").alias("owner"), "digest")
    firsts = firsts.select(_part(width), F.lit(FIRSTS).alias("kind"), "owner", F.col("digest").alias("mark"), F.lit(None).cast("binary").alias("blob"))
    firsts = cut(firsts)
    with_side = lambda side: held.groupBy("part").cogroup(side.groupBy("part"))
    # what comes back to a part
    side = lambda packets: packets.select(F.col("place").alias("part"), "kind", F.lit(None).cast("long").alias("owner"), F.lit(None).cast("binary").alias("mark"), "blob")
    at_place = lambda packets, step: packets.groupBy("kind", "place").applyInArrow(frugal_group(step), _PACKET)
    route = Route(width, fan)
    found = _sent(with_side(firsts).applyInArrow(frugal_cogroup(_anchor_step(route)), _PACKET), route)
    repeated = _sent(at_place(found, _repeated_step(route, hot)), route, back=True)
    windows = _sent(with_side(firsts.unionByName(side(repeated))).applyInArrow(frugal_cogroup(_window_step(route)), _PACKET), route)
    ranges = _sent(at_place(windows, _shard_step(route)), route, back=True)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("spans", _SPANS), T.StructField("text", T.BinaryType()), T.StructField("kept", T.BinaryType()), *fields])
    out = with_side(firsts.unionByName(side(ranges))).applyInArrow(frugal_cogroup(_span_step), schema)
    carried = [f.name for f in fields]
    none, empty = F.array().cast(_SPANS), F.lit(b"")
    short = base.where(F.octet_length("text") < MATCH)
    out = out.unionByName(short.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("spans"), F.col("text").cast("binary").alias("text"), F.col("text").cast("binary").alias("kept"), *carried))
    if copies:
        # all rows of a text but one row of its first id
        rows = cut(held.groupBy("doc_id", "digest", "n").agg(F.sum("times").alias("times"), *[F.first(c, True).alias(c) for c in carried]))
        first = firsts.select("mark", F.col("owner").alias("first"))
        rows = rows.join(first, F.col("digest") == F.col("mark")).withColumn("times", F.col("times") - (F.coalesce("doc_id", F.lit(_LAST)) == F.col("first")).cast("int")).where("times > 0")
        rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
        whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("stop"))).cast(_SPANS)
        out = out.unionByName(rows.select("doc_id", F.col("n").alias("n_bytes"), whole.alias("spans"), empty.alias("text"), empty.alias("kept"), *carried))
    return out


def _whole_chars(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left if only whole characters go."""
    kept, done = [], 0
    for s, e in spans:
        while s < e and text[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
            e -= 1
        kept.append(text[done:s])
        done = e
    kept.append(text[done:])
    return b"".join(kept)


def without_repeats(documents: DataFrame) -> DataFrame:
    """The documents without repeated stretches: same columns, text cut at whole characters, n_chars counted anew.

    Texts of which nothing is left go; texts that were empty stay.
    """
    carry = [c for c in documents.columns if c not in ("doc_id", "text")]
    got = repeats(documents, carry, copies=False)

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            spans = [[(s["start"], s["stop"]) for s in v] for v in batch.column(names.index("spans")).to_pylist()]
            texts = batch.column(names.index("text")).to_pylist()
            kept = [_whole_chars(t, v) for t, v in zip(texts, spans)]
            keep = pa.array([bool(k) or not t for k, t in zip(kept, texts)], pa.bool_())
            rest = [batch.column(names.index(f"c{k}")) for k in range(len(carry))]
            yield pa.RecordBatch.from_arrays([batch.column(names.index("doc_id")), pa.array([k.decode() for k in kept], pa.string()), *rest], ["doc_id", "text", *[f"c{k}" for k in range(len(carry))]]).filter(keep)

    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(f"c{k}", documents.schema[c].dataType) for k, c in enumerate(carry)]]
    out = got.mapInArrow(frugal(run), T.StructType(fields))
    columns = []
    for c in documents.columns:
        value = F.col(c) if c in ("doc_id", "text") else F.col(f"c{carry.index(c)}")
        columns.append((F.length("text").cast(documents.schema[c].dataType) if c == "n_chars" else value).alias(c))
    return out.select(*columns)
