"""Whole Arrow columns of texts as bytes, words and hashes, vectorised in numpy.

A batch's texts lie in one byte buffer with offsets, so words and hashes are found for all of its texts at once. Work
goes in slices of about ``SLICE`` bytes of whole texts, so memory follows the slice and the longest text, not the batch.
Words are named by 64-bit hashes under a key that the driver draws at random for each process (see ``salt``), so nobody can
write texts whose words collide; what is then said of words is checked on their bytes wherever that can be done in place.
Runs of bytes (``prefix_hash``) have polynomials modulo 2**64 (odd base, so powers can be inverted); who uses these must
compare bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from glossweave.functions.session import salt

SLICE = 1 << 21
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)

#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z is lower-cased: digits, a-z, and all bytes of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Bytes of words `[^\x20\x09-\x0D]+`.
SOLID = np.ones(256, bool)
SOLID[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_pow: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**0 .. BASE**n (or of its inverse), kept between calls up to a few slices."""
    key = "inv" if inverse else "pow"
    if key not in _pow or len(_pow[key]) <= n:
        with np.errstate(over="ignore"):
            p = np.full(max(n, SLICE) + 1, BASE_INV if inverse else BASE, U64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
        if n > 8 * SLICE:
            return p[: n + 1]
        _pow[key] = p
    return _pow[key][: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose every output bit depends on all input bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow column of texts or byte strings; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_binary())
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    at = np.frombuffer(offs, np.int64, len(col) + 1, 8 * col.offset)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def texts(col, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of each slice of a column."""
    data, offs = utf8(col)
    for i, j in slices(offs, most):
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def words(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of maximal runs of ``inside`` bytes that stay in one text; first[i]:first[i+1] are text i's."""
    n = len(data)
    mask = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start, end = mask.copy(), mask.copy()
    if n:
        start[1:] &= ~mask[:-1] | edge[1:n]
        end[:-1] &= ~mask[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = sum over s <= i < e of (data[i] + 1) * BASE**i."""
    out = np.zeros(len(data) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(U64) + U64(1)) * powers(len(data))[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Unmixed hashes of data[s:e], alike for equal bytes wherever they stand."""
    with np.errstate(over="ignore"):
        return (prefix[e] - prefix[s]) * powers(len(prefix), True)[s]


#: Words of more bytes are hashed one by one, by a keyed cryptographic hash.
LONG = 64
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)


def eight(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number."""
    return np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))[at]


def _eight(padded: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; those beyond ``left`` are zero. ``padded`` has eight bytes to spare."""
    return eight(padded, at) & _MASK[np.minimum(left, 8)]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit keyed hashes of words of (already lower-cased) bytes."""
    if not len(starts):
        return np.zeros(0, U64)
    secret = salt()
    key = np.frombuffer(hashlib.shake_128(secret).digest(8 * (LONG // 8 + 1)), "<u8").astype(U64)
    padded, size = np.append(data, np.zeros(8, np.uint8)), ends - starts
    with np.errstate(over="ignore"):
        h = mix((_eight(padded, starts, size) ^ key[0]) + size.astype(U64) * (key[1] | U64(1)))
        live = np.flatnonzero((size > 8) & (size <= LONG))
        for k in range(1, LONG // 8):
            live = live[size[live] > 8 * k]
            if not len(live):
                break
            h[live] = mix((h[live] ^ _eight(padded, starts[live] + 8 * k, size[live] - 8 * k)) + key[k + 1])
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, key=secret).digest(), "little")
    return h


def same(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[at_a : at_a + size] equals b[at_b : at_b + size], for each of many places."""
    out = np.ones(len(size), bool)
    pad_a, pad_b = np.append(a, np.zeros(8, np.uint8)), np.append(b, np.zeros(8, np.uint8))
    live = np.flatnonzero(size <= 2 * LONG)
    for k in range(0, 2 * LONG, 8):
        live = live[size[live] > k]
        if not len(live):
            break
        out[live] &= _eight(pad_a, at_a[live] + k, size[live] - k) == _eight(pad_b, at_b[live] + k, size[live] - k)
    for i in np.flatnonzero(size > 2 * LONG).tolist():
        out[i] = np.array_equal(a[at_a[i] : at_a[i] + size[i]], b[at_b[i] : at_b[i] + size[i]])
    return out


def hash_of(word: str) -> int:
    """The hash that ``word_hashes`` gives a single word."""
    b = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(b, np.array([0]), np.array([len(b)]))[0])


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hashes of all runs of ``n`` consecutive hashes (across texts as well; the caller masks those)."""
    m = max(0, len(h) - n + 1)
    with np.errstate(over="ignore"):
        out = np.full(m, n, U64)
        for k in range(n):
            out = (out + h[k : k + m]) * U64(BASE | 1)
            out ^= out >> U64(29)
        return mix(out)
