"""Arrow text columns as flat byte buffers, for vectorised numpy passes.

A batch of texts becomes one ``uint8`` buffer in which every byte that is not
part of a word is zero.  Word bytes are 0-9, a-z and everything from 0x80 on
(A-Z and the two-byte Latin capitals are folded to lower case first).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Bytes of text handled at a time inside one Arrow batch; bounds numpy scratch memory.
SLICE_BYTES = 1 << 20
PAD = 16

_FOLD = np.zeros(256, np.uint8)
for _b in range(256):
    if 0x30 <= _b <= 0x39 or 0x61 <= _b <= 0x7A or _b >= 0x80:
        _FOLD[_b] = _b
    elif 0x41 <= _b <= 0x5A:
        _FOLD[_b] = _b + 32


def text_slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about max_bytes each; a longer text gets a range of its own."""
    n = len(column)
    if not n:
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64)
    total = np.cumsum(sizes)
    start = 0
    while start < n:
        base = total[start - 1] if start else 0
        stop = int(np.searchsorted(total, base + max_bytes, side="right"))
        stop = min(n, max(stop, start + 1))
        yield start, stop
        start = stop


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row; null counts as empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [v if v is not None else b"" for v in column.to_pylist()]


class TextBlock:
    """Texts of some rows, folded, in one buffer with zero bytes around each."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.start = PAD + np.concatenate(([0], np.cumsum(sizes + 2)[:-1])).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        self.end = self.start + sizes
        total = int(self.end[-1]) + PAD if len(texts) else 2 * PAD
        raw = np.zeros(total, np.uint8)
        for s, t in zip(self.start.tolist(), texts):
            if t:
                raw[s : s + len(t)] = np.frombuffer(t, np.uint8)
        low = _FOLD[raw]
        two = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        low[1:][two] += 32
        self.raw, self.buf = raw, low
        word = low != 0
        self.word_start = np.flatnonzero(word[1:] & ~word[:-1]) + 1
        self.word_end = np.flatnonzero(word[:-1] & ~word[1:]) + 1
        #: Words of row i are first_word[i] .. first_word[i + 1] - 1.
        self.first_word = np.searchsorted(self.word_start, np.append(self.start, total))


_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(block: TextBlock) -> np.ndarray:
    """A 64-bit hash of each word, from wrap-around polynomial prefix sums.

    Texts are sliced to about a megabyte, so the power table stays small.
    """
    n = len(block.buf)
    power = _powers(n)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum((block.buf.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)))
    s, e = block.word_start, block.word_end
    return mix((prefix[e] - prefix[s]) * _inverse_powers(n)[s] + (e - s).astype(np.uint64))


_POW: dict[str, np.ndarray] = {}
_BASE = 0x5851F42D4C957F2D


def _table(name: str, base: int, n: int) -> np.ndarray:
    have = _POW.get(name)
    if have is None or len(have) < n:
        m = 1 << max(20, int(n - 1).bit_length())
        have = np.empty(m, np.uint64)
        have[0] = 1
        done = 1
        while done < m:
            have[done : 2 * done] = have[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        _POW[name] = have
    return have


def _powers(n: int) -> np.ndarray:
    return _table("up", _BASE, n)


def _inverse_powers(n: int) -> np.ndarray:
    return _table("down", pow(_BASE, -1, 1 << 64), n)


def shingles(block: TextBlock, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words inside one row, and the offsets of the rows.

    A row with fewer words, but one at least, has one shingle of all its words.
    """
    words = word_hashes(block)
    first = block.first_word
    count = np.diff(first)
    per = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    offset = np.concatenate(([0], np.cumsum(per)))
    out = np.empty(int(offset[-1]), np.uint64)
    n = len(words)
    if n >= width:
        full = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            full = full * _MULT + words[k : n - width + 1 + k]
        full = mix(full)
    for_rows = np.repeat(np.arange(len(per)), per)
    at = np.arange(len(out)) - offset[for_rows] + first[for_rows]
    long = count[for_rows] >= width
    if long.any():
        out[long] = full[at[long]]
    for i in np.flatnonzero((count > 0) & (count < width)).tolist():
        h = 1
        for w in words[first[i] : first[i + 1]].tolist():
            h = (h * 0x9E3779B97F4A7C15 + w + 1) & 0xFFFFFFFFFFFFFFFF
        out[offset[i]] = mix(np.array([h], np.uint64))[0]
    return out, offset


# ---- what Python workers hold ----


def give_back() -> None:
    """Hands free memory back to the system; workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()  # the C library's, where numpy's arrays are


def frugal(run):
    """The mapInArrow function `run`, giving memory back after each batch that it makes."""

    def inner(batches):
        for out in run(batches):
            yield out
            give_back()

    return inner


def frugal_group(run):
    """The same for an applyInArrow function of one group."""

    def inner(key, table):
        out = run(key, table)
        give_back()
        return out

    return inner


def frugal_cogroup(run):
    """The same for an applyInArrow function of two groups."""

    def inner(key, left, right):
        out = run(key, left, right)
        give_back()
        return out

    return inner
