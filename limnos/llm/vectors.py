"""Numpy helpers on Arrow string columns: word and character n-gram hashes.

All work is on whole byte buffers in blocks of at most ``BLOCK`` bytes (more
only when one word is longer), so memory stays bounded for texts of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

BLOCK = 1 << 20
U = np.uint64
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32                               # A-Z as a-z
_PRIME = U(0x9E3779B97F4A7C15)
_Q = np.random.default_rng(20240229).integers(1, 1 << 63, 64, dtype=np.uint64) | U(1)
BLOCKS = 4              # words of 8 bytes that are hashed in numpy
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (in place where possible)."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def span_blocks(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The first 8 * BLOCKS bytes of each span of ``b`` as 64-bit words, 0 beyond its end."""
    padded = np.concatenate([b, np.zeros(8, np.uint8)])
    wide = np.ndarray(len(b) + 1, "<u8", padded, strides=(1,))         # the 8 bytes from each place on
    n = ends - starts
    return [np.where(n > 8 * k, wide[np.minimum(starts + 8 * k, len(b))] & _MASK[np.clip(n - 8 * k, 0, 8)], U(0))
            for k in range(BLOCKS)]


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, blocks: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of each span: its words are mixed in one after the other (a
    sum of powers would have collisions for any base); longer spans by xxHash."""
    n = ends - starts
    h = mix(blocks[0] + n.astype(np.uint64) * _Q[0])
    for k in range(1, BLOCKS):
        more = np.flatnonzero(n > 8 * k)
        if len(more):
            h[more] = mix((h[more] ^ blocks[k][more]) * _PRIME + _Q[k])
    for i in np.flatnonzero(n > 8 * BLOCKS).tolist():
        h[i] = xxhash.xxh3_64_intdigest(b[starts[i]:ends[i]].tobytes())
    return h


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n + 1) of a string column; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def _blocks(data: np.ndarray, offsets: np.ndarray):
    """(lo, hi) spans at most BLOCK bytes long, cut at row starts or white space."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        hi = min(at + BLOCK, end)
        if hi < end:
            row = int(offsets[np.searchsorted(offsets, hi, "right") - 1])
            if row > at:
                hi = row
            else:
                space = np.flatnonzero(_WS[data[at:hi]])
                while not len(space) and hi < end:      # one word longer than a block
                    hi = min(hi + BLOCK, end)
                    space = np.flatnonzero(_WS[data[at:hi]])
                if len(space):
                    hi = at + int(space[-1]) + 1
        yield at, hi
        at = hi


def word_hashes(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _WS,
                prefixes: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word (A-Z as a-z) and word offsets per row.

    ``breaks``: table of the bytes between words.  With ``prefixes`` the hashes
    have further columns: those of the first p bytes, at most 8 (0 for shorter words).
    """
    hashes, starts_all = [], []
    for lo, hi in _blocks(data, offsets):
        b = data[lo:hi]
        n = hi - lo
        word = ~breaks[b]
        edge = np.zeros(n + 1, bool)
        rows = offsets[np.searchsorted(offsets, lo):np.searchsorted(offsets, hi, "right")] - lo
        edge[rows] = True
        edge[0] = edge[n] = True
        begin = word.copy()
        begin[1:] &= ~word[:-1] | edge[1:n]
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[1:n]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
        if not len(starts):
            continue
        folded = _LOWER[b]
        blocks = span_blocks(folded, starts, ends)
        h = span_hashes(folded, starts, ends, blocks)
        if prefixes:
            cols = [h]
            for k in prefixes:
                p = mix((blocks[0] & _MASK[k]) + np.array([k], np.uint64) * _Q[30])
                cols.append(np.where(ends - starts >= k, p, U(0)))
            h = np.stack(cols, axis=1)
        hashes.append(h)
        starts_all.append(starts + lo)
    if not hashes:
        shape = (0, 1 + len(prefixes)) if prefixes else 0
        return np.zeros(shape, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts_all), offsets)


def shingles(words: np.ndarray, offsets: np.ndarray, size: int):
    """Per row the sorted distinct hashes of its ``size``-word windows; a row
    with fewer words has its whole sequence as one; none has an empty set."""
    grams = np.zeros(0, np.uint64)
    if len(words) >= size:
        m = len(words) - size + 1
        grams = words[:m] * _Q[1]
        for k in range(1, size):
            grams += words[k:m + k] * _Q[k + 1]
        grams = mix(grams)
    for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        n = z - a
        if n >= size:
            yield np.unique(grams[a:z - size + 1])
        elif n:
            yield mix((words[a:z] * _Q[16:16 + n]).sum(keepdims=True) + np.array([n], np.uint64) * _Q[40])
        else:
            yield grams[:0]


def char_shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-character windows of a text; a
    shorter text is one window."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < size:
        return mix((c * _Q[1:1 + len(c)]).sum(keepdims=True) + np.array([len(c)], np.uint64) * _Q[41])
    m = len(c) - size + 1
    h = c[:m] * _Q[1]
    for k in range(1, size):
        h += c[k:m + k] * _Q[k + 1]
    return np.unique(mix(h))
