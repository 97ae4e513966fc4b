"""Vectorised word helpers on Arrow string batches, shared by the operators of this package.

A batch is cut into runs of whole documents of about ``CHUNK_BYTES`` bytes (one document may
be longer), so the temporaries of a task stay small whatever the batch holds. Nulls count as
empty texts. Words are found on the UTF-8 bytes: every word class used here is a set of ASCII
bytes plus "all bytes from 0x80", so byte and code-point words are the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18

_B = np.uint64(0x9E3779B97F4A7C15)  # odd: invertible modulo 2**64
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict = {"n": 0}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_b = np.arange(256)
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z: digits, letters, all bytes of longer code points
ALNUM_WORD = ((_b >= 48) & (_b <= 57)) | ((_b >= 65) & (_b <= 90)) | ((_b >= 97) & (_b <= 122)) | (_b >= 128)
#: [^\x20\x09-\x0D]
SPACED_WORD = ~((_b == 32) | ((_b >= 9) & (_b <= 13)))


def _pow(n: int):
    """Powers of the hash base and of its inverse, at least ``n`` of each."""
    if _powers["n"] < n:
        size = max(n, CHUNK_BYTES + 1)
        for key, base in (("up", _B), ("down", _B_INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                _powers[key] = np.cumprod(p)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def chunks(arr):
    """Yield (first row, bytes as uint8, int64 offsets of the rows) of consecutive runs of whole documents."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    if not n:
        return
    width = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    offs = np.frombuffer(arr.buffers()[1], dtype=width)[arr.offset:arr.offset + n + 1].astype(np.int64)
    data = arr.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + CHUNK_BYTES, "right")) - 1)
        hi = min(hi, n)
        yield lo, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def word_spans(buf: np.ndarray, offs: np.ndarray, table: np.ndarray):
    """Byte starts and ends of all words, and the document of each word."""
    m = table[buf]
    first, last = offs[:-1][offs[:-1] < offs[1:]], offs[1:][offs[:-1] < offs[1:]] - 1
    start = m.copy()
    start[1:] &= ~m[:-1]
    start[first] = m[first]
    end = m.copy()
    end[:-1] &= ~m[1:]
    end[last] = m[last]
    s = np.flatnonzero(start)
    e = np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offs, s, "right") - 1


def word_hashes(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each word of the (already lower-cased) bytes."""
    if not len(s):
        return np.zeros(0, np.uint64)
    up, down = _pow(len(low) + 1)
    with np.errstate(over="ignore"):
        c = np.zeros(len(low) + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:len(low)], out=c[1:])
        return mix((c[e] - c[s]) * down[s] + (e - s).astype(np.uint64))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words (runs may cross documents: mask them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        g = np.full(n, np.uint64(k), np.uint64)
        for j in range(k):
            g = g * np.uint64(0xD6E8FEB86659FD93) + h[j:j + n]
        return mix(g)


def same_doc(doc: np.ndarray, k: int) -> np.ndarray:
    """Which runs of ``k`` words lie within one document."""
    return doc[:len(doc) - k + 1] == doc[k - 1:] if len(doc) >= k else np.zeros(0, bool)
