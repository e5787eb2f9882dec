"""Vectorised text work for Arrow batches: fingerprints of byte and code-point ranges, runs, word ids.

A range fingerprint is made of polynomials over random symbol values modulo the prime 2**31 - 1, each at a random point of
its own, read from prefix sums: the fingerprint of any [start, end) costs two lookups a residue.  Equal ranges have equal
fingerprints.  Two different ranges of n symbols agree in one residue with a chance of at most n / 2**31, whatever they
hold (a modulus that is a power of two has no such bound: Thue-Morse words collide there for any symbol values).  ranges()
joins two residues, checks() is a third.  Who needs certainty compares the symbols.
"""

from __future__ import annotations

import ctypes
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
_PRIME = (1 << 31) - 1
_P, _BITS = U(_PRIME), U(31)
_rng = np.random.default_rng(6180339887)
#: The points that the residues are taken at, and the values of the bytes.
_POINTS = [int(x) for x in _rng.integers(1 << 20, _PRIME - 1, 3)]
_BYTES = _rng.integers(1, _PRIME, (3, 256)).astype(U)
#: Bytes or characters that array operations work on at once, and rows of a batch that are unpacked at once.
CHUNK = 250_000
ROWS = 1_000

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Code points with the Unicode property White_Space (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, for a fresh array."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x *= U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(31)
    return x


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for a fresh array."""
    for _ in range(2):
        high = x >> _BITS
        x &= _P
        x += high
    x -= _P * (x >= _P)
    return x


_powers = [np.ones(1, np.uint32) for _ in _POINTS]


def powers(k: int, n: int) -> np.ndarray:
    """The residue's point to the i for i up to n at least; the last entry's inverse scales the rest to negative powers."""
    if len(_powers[k]) <= n:
        steps = np.ones(max(n + 1, 5 * len(_powers[k]) // 4, 1 << 16), np.uint32)
        have = 1
        while have < len(steps):
            more = min(have, len(steps) - have)
            steps[have : have + more] = _reduced(steps[:more].astype(U) * U(pow(_POINTS[k], have, _PRIME)))
            have += more
        _powers[k] = steps
    return _powers[k]


def prefixes(values: np.ndarray) -> np.ndarray:
    """Prefix sums of symbol values (residues x symbols) from which ranges() and checks() read fingerprints."""
    n = values.shape[1]
    out = np.zeros((len(values), n + 1), U)
    for k, x in enumerate(values):
        x = x * powers(k, n)[:n]
        high = x >> _BITS
        x &= _P
        x += high
        np.cumsum(x, out=out[k, 1:])  # terms below 2**32: no overflow under 2**32 symbols
    return out


def _residue(prefix: np.ndarray, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up = powers(k, prefix.shape[1])
    # the point to the -start is its power to the (last - start) times the inverse of the last power
    down = _reduced(up[len(up) - 1 - start].astype(U) * U(pow(_POINTS[k], -(len(up) - 1), _PRIME)))
    return _reduced(_reduced(prefix[k][end] - prefix[k][start]) * down)


def ranges(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first two residues of each range, mixed into 64 bits."""
    return mix(_residue(prefix, 0, start, end) | (_residue(prefix, 1, start, end) << _BITS))


def checks(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The third residue of each range."""
    return _residue(prefix, 2, start, end).astype(np.int32)


def byte_values(data: np.ndarray, residues: int = 2) -> np.ndarray:
    return np.stack([_BYTES[k][data] for k in range(residues)])


@lru_cache(1)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows; freed memory goes back to the system after each batch."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)
        pa.default_memory_pool().release_unused()
        _trim()(0)


def chunks(sizes: np.ndarray, limit: int = CHUNK):
    """(first, last) row ranges whose sizes sum to about limit; a row is never split."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield first, last
        first = last


def utf8_chunks(column: pa.Array, limit: int = CHUNK):
    """(first, last, bytes, offsets) for groups of a string column's rows; null reads as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    for first, last in chunks(np.diff(offsets), limit):
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]


@lru_cache(1)
def classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            out[point] = LETTER
        elif kind == "N":
            out[point] = NUMBER
    out[WHITE_SPACE] = SPACE
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts one after another, and where each text begins (one more entry: the end)."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), bounds


def text_chunks(column: pa.Array, limit: int = CHUNK):
    """(first, last, texts) for groups of a string column's rows; null reads as empty."""
    texts = [t or "" for t in column.to_pylist()]
    for first, last in chunks(np.array([len(t) for t in texts], np.int64), limit) if texts else ():
        yield first, last, texts[first:last]


def point_values(points: np.ndarray) -> np.ndarray:
    """Two values below the prime for each code point, above 0."""
    x = mix((points.astype(U) + U(1)) * U(0xD6E8FEB86659FD93))
    return np.stack([(x & U(0x3FFFFFFF)) + U(1), (x >> U(33)) % U(_PRIME - 1) + U(1)])


def runs(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that don't cross a bound."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.empty(len(mask), bool)
    first[0] = True
    np.not_equal(mask[1:], mask[:-1], out=first[1:])
    inner = bounds[(bounds > 0) & (bounds < len(mask))]
    first[inner] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(mask))
    keep = mask[starts]
    return starts[keep], ends[keep]


def segment(reduce, values: np.ndarray, bounds: np.ndarray, empty) -> np.ndarray:
    """reduce.reduceat over [bounds[i], bounds[i+1]), with a value for empty segments."""
    out = np.full((len(bounds) - 1, *values.shape[1:]), empty, values.dtype)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full] = reduce.reduceat(values, bounds[:-1][full], axis=0)
    return out


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices starts[i], starts[i] + 1, ... of all segments one after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)
