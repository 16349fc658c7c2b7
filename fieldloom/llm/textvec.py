"""Vectorised text primitives over Arrow string buffers.

Everything here works on the UTF-8 bytes of whole Arrow batches with NumPy, so
no Python object is made per word, line or character. Long batches are cut at
document boundaries into slices of about ``SLICE_BYTES``; a document is never
cut, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

_WORD = np.zeros(256, dtype=bool)
for _r in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
    _WORD[list(_r)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every other."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    b = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES, rows: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes and at most ``rows`` rows; a longer row makes a range alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        j = min(j, n, i + rows)
        yield i, j
        i = j


def _pow(n: int, base: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        m = max(n, SLICE_BYTES + 1)
        have = np.empty(m, np.uint64)
        have[0] = 1
        filled = 1
        while filled < m:  # doubling: B^(k+i) = B^k * B^i
            k = min(filled, m - filled)
            have[filled : filled + k] = have[:k] * np.uint64(pow(base, filled, 1 << 64))
            filled += k
        if n <= 1 << 24:
            _powers[base] = have
    return have[:n]


def prefix_hash(b: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash of the bytes, modulo 2**64."""
    out = np.zeros(len(b) + 1, np.uint64)
    term = b.astype(np.uint64)
    term += np.uint64(1)
    term *= _pow(len(b), _BASE)
    np.cumsum(term, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent 64-bit hash of each byte span."""
    h = prefix[end] - prefix[start]
    h *= _pow(len(prefix), _INV)[start]
    h += (end - start).astype(np.uint64)
    return mix(h)


def words(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and document index of each word, and the word offset of each document.

    A word is a maximal run of letters, digits and bytes of non-ASCII characters.
    """
    n_docs = len(o) - 1
    w = _WORD[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[o] = True
    before = np.concatenate(([False], w[:-1])) if len(w) else w
    start = np.flatnonzero(w & (~before | edge[:-1]))
    after = np.concatenate((w[1:], [False])) if len(w) else w
    end = np.flatnonzero(w & (~after | edge[1:])) + 1
    h = span_hash(prefix_hash(b), start, end)
    first = np.searchsorted(start, o)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    return h, doc, first


_COEF = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def ngrams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams in document order, and each document's offset.

    A document of 1 to n-1 words has one gram made of all of its words; one
    without words has none.
    """
    count = np.diff(first)
    grams = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    out = np.zeros(len(grams) + 1, np.int64)
    np.cumsum(grams, out=out[1:])
    at = np.repeat(first[:-1] - out[:-1], grams) + np.arange(out[-1])
    last = np.repeat(first[1:], grams)
    acc = np.zeros(len(at), np.uint64)
    padded = np.concatenate((h, np.zeros(n, np.uint64)))
    for j in range(n):
        acc += np.where(at + j < last, padded[at + j], np.uint64(0)) * _COEF[j]
    return mix(acc), out


def lines(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each line (split at newline), and each document's line offset.

    An empty document has one empty line, as ``split`` gives.
    """
    nl = np.flatnonzero(b == 10)
    per = np.searchsorted(nl, o[1:]) - np.searchsorted(nl, o[:-1]) + 1
    first = np.zeros(len(o), np.int64)
    np.cumsum(per, out=first[1:])
    start = np.empty(first[-1], np.int64)
    end = np.empty(first[-1], np.int64)
    is_first = np.zeros(first[-1], bool)
    is_first[first[:-1]] = True
    start[is_first] = o[:-1]
    start[~is_first] = nl + 1
    is_last = np.zeros(first[-1], bool)
    is_last[first[1:] - 1] = True
    end[is_last] = o[1:]
    end[~is_last] = nl
    return start, end, first


def codes(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts of a slice, and each text's offset in them."""
    raw = b.tobytes()
    try:
        out = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        starts = np.zeros(len(b) + 1, np.int64)
        np.cumsum((b & 0xC0) != 0x80, out=starts[1:])
        return out, starts[o]
    except UnicodeDecodeError:
        parts = [np.frombuffer(raw[i:j].decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for i, j in zip(o[:-1], o[1:])]
        at = np.zeros(len(o), np.int64)
        np.cumsum([len(p) for p in parts], out=at[1:])
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), at


def sum_by(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the runs that start at the offsets; 0 for an empty run."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]
