"""Vectorised word and shingle hashes over Arrow text buffers.

Texts are handled as UTF-8 bytes. A word is cut into lanes of 8 bytes; every lane is mixed with its place by a bijection
that is not linear, and the lanes are summed and mixed with the length. Words of 8 bytes or fewer therefore only meet by
their length, and no structure of a long word (as in hashes that are polynomials modulo a power of two) makes two words
meet: any two differing words share a hash with a chance of about 2 ** -64. A shingle hash combines five word hashes. All
hashes are 64 bits and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_STEP = np.uint64(0xD6E8FEB86659FD93)
_LANE = np.uint64(0x9E3779B97F4A7C15)
#: Lanes that are taken for all words of a slice at once; a longer word is hashed by itself.
_LANES = 8
_PLACES = _LANE * np.arange(1, _LANES + 1, dtype=np.uint64)
#: What of a lane belongs to a word that has 0 to 8 bytes of it.
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
#: Bytes of text handled at once; a longer text forms a slice of its own.
SLICE_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Separators of words [^\x20\x09-\x0D]+ and of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing A-Z).
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])

def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of slices of about limit bytes; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple:
    """(word hashes, first word of each document and the end): documents in order. With prefixes, lengths in bytes, also
    a list of (words, hashes of their prefixes, 8 bytes at most) of all words that are longer."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)) + (([],) if prefixes else ())
    inside = ~separators[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    at, to = np.flatnonzero(starts), np.flatnonzero(ends)
    length = to - at + 1
    padded = np.zeros(n + 8, np.uint8)
    np.take(_LOWER, data, out=padded[:n])
    lanes = np.ndarray((n,), "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    first = lanes[at]
    total = mix((first & _KEEP[np.minimum(length, 8)]) + _LANE)
    longer, k = np.flatnonzero(length > 8), 1
    while len(longer) and k < _LANES:
        total[longer] += mix((lanes[at[longer] + 8 * k] & _KEEP[np.minimum(length[longer] - 8 * k, 8)]) + _PLACES[k])
        k += 1
        longer = longer[length[longer] > 8 * k]
    for w in longer:
        rest = padded[at[w] + 8 * k : to[w] + 1]
        own = np.zeros(-(-len(rest) // 8) * 8, np.uint8)
        own[: len(rest)] = rest
        own = own.view("<u8")
        total[w : w + 1] += mix(own + _LANE * np.arange(k + 1, k + 1 + len(own), dtype=np.uint64)).sum(dtype=np.uint64)
    out = mix(total + length.astype(np.uint64) * _STEP), np.searchsorted(at, offsets)
    if not prefixes:
        return out
    starts = []
    for k in prefixes:
        longer = np.flatnonzero(length > k)
        starts.append((longer, mix((first[longer] & _KEEP[k]) ^ np.uint64(0x3C6EF372FE94F82B + k))))
    return *out, starts


def shingles(word: np.ndarray, firsts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes in order of position, first shingle of each document and the end).

    A document with 1 to k-1 words has one shingle, its whole sequence; one without words has none.
    """
    counts = np.diff(firsts)
    n_out = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_firsts = np.concatenate([[0], np.cumsum(n_out)])
    m = len(word)
    if not m:
        return np.zeros(0, np.uint64), out_firsts
    rolled = np.zeros(m, dtype=np.uint64)
    for i in range(k):
        rolled[: m - i if m > i else 0] = rolled[: m - i if m > i else 0] * _STEP + word[i:]
    keep = np.zeros(m, dtype=bool)
    doc_of_word = np.repeat(np.arange(len(counts)), counts)
    position = np.arange(m) - firsts[:-1][doc_of_word]
    keep = position <= counts[doc_of_word] - k
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        h = np.uint64(counts[d])
        with np.errstate(over="ignore"):
            for w in word[firsts[d] : firsts[d + 1]]:
                h = h * _STEP + w
        rolled[firsts[d]], keep[firsts[d]] = h ^ np.uint64(0x5851F42D4C957F2D), True
    return mix(rolled[keep]), out_firsts


def document_shingles(column: pa.Array, separators: np.ndarray = SPACE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingle hashes by position) of every row."""
    for lo, hi, data, offsets in slices(column):
        found, firsts = shingles(*words(data, offsets, separators))
        for i in range(hi - lo):
            yield lo + i, found[firsts[i] : firsts[i + 1]]
