"""Word and k-gram kernels: numpy over the UTF-8 buffers of an Arrow column.

Every operator of this subpackage that works on words or shingles reads its
texts through :func:`words`.  One call tokenises and hashes a whole slice of
rows without a Python object per word, so the cost is a few nanoseconds a
byte and the memory is bounded by the size of a slice (:func:`slices`).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64

#: Bytes of text that one slice holds, unless a single row is longer.
SLICE_BYTES = 3 << 20

_BYTE = np.arange(256)
#: `[^\x20\x09-\x0D]+`: what is not ASCII white space.
NOT_SPACE = ~((_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D)))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: digits, letters, all non-ASCII.
ALNUM = (
    ((_BYTE >= 0x30) & (_BYTE <= 0x39))
    | ((_BYTE >= 0x41) & (_BYTE <= 0x5A))
    | ((_BYTE >= 0x61) & (_BYTE <= 0x7A))
    | (_BYTE >= 0x80)
)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of the result depends on every bit of x."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


_BASE = stream(11, 256)
_LOWER_BASE = _BASE[np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE)]
_POWERS = np.ones(1, U)
_STEP = U(0xD6E8FEB86659FD93)


def _powers(n: int) -> np.ndarray:
    """The first n powers of the odd step modulo 2**64; the table grows by doubling."""
    global _POWERS
    while len(_POWERS) < n:
        with np.errstate(over="ignore"):
            top = _POWERS[-1] * _STEP
            _POWERS = np.concatenate([_POWERS, _POWERS * top])
    return _POWERS


class Words(NamedTuple):
    """Words of a slice of rows, in order.

    data: the bytes; start, end: byte offsets of each word; first: index of
    the first word of each row, with one more entry at the end; hash: a
    64-bit hash of each word's (folded) bytes.
    """

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def as_text(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one large_string array; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a large_string array."""
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def slices(text: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes; a longer row stands alone."""
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1)
    at = 0
    while at < len(text):
        stop = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        stop = max(at + 1, min(stop, len(text)))
        yield at, stop
        at = stop


def words(text: pa.Array, inside: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    """Maximal runs of bytes for which `inside` holds, by row; lower folds A-Z in the hash only."""
    offsets, data = buffers(text)
    n = len(data)
    flags = np.zeros(n + 2, bool)
    flags[1:-1] = inside[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    here = flags[1:-1]
    start = np.flatnonzero(here & (cut[:-1] | ~flags[:-2]))
    end = np.flatnonzero(here & (cut[1:] | ~flags[2:])) + 1
    first = np.searchsorted(start, offsets)
    if not len(start):
        return Words(data, start, end, first, np.empty(0, U))
    longest = int((end - start).max())
    with np.errstate(over="ignore"):
        where = np.arange(start[0], n, dtype=np.int32) - np.repeat(start.astype(np.int32), np.diff(np.append(start, n)))
        here = here[start[0] :]
        np.minimum(where, longest - 1, out=where)
        value = (_LOWER_BASE if lower else _BASE)[data[start[0] :]]
        value *= _powers(longest)[where]
        value *= here
        total = np.add.reduceat(value, start - start[0])
        total += (end - start).astype(U) * U(0xA24BAED4963EE407)
        return Words(data, start, end, first, mix(total))


def kgrams(hashes: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of the k words from each position; the last k - 1 positions are left out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U)
    with np.errstate(over="ignore"):
        out = np.zeros(n, U)
        for j, c in enumerate(stream(seed * 1000 + k, k)):
            out += hashes[j : j + n] * c
        return mix(out)


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def pack_gaps(ascending: np.ndarray) -> bytes:
    """Ascending non-negative integers as gaps of 2 or 4 bytes."""
    gaps = np.diff(ascending, prepend=0)
    if len(gaps) and gaps.max() > 0xFFFF:
        return b"\x04" + gaps.astype("<u4").tobytes()
    return b"\x02" + gaps.astype("<u2").tobytes()


def unpack_gaps(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, f"<u{packed[0]}", offset=1), dtype=np.int64)
