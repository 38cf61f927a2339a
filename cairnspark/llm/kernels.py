"""Vectorised helpers that run inside Spark tasks: word tables, rolling fingerprints, anchors.

A task gets Arrow batches; every helper works on slices of about SLICE_BYTES of text, so that its memory does not
depend on the batch size (one document longer than that forms a slice by itself).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
#: The word separators of every contract here: space, and tab to carriage return.
SEPARATORS = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True

#: Fingerprints are polynomials over the field of this many elements at two bases, so that no structure of the content
#: (doublings, swaps, Thue-Morse order) cancels out as it does modulo a power of two.
PRIME = (1 << 31) - 1
_P, _BITS = np.uint64(PRIME), np.uint64(31)
_BASES = tuple(int(b) for b in np.random.default_rng(20250711).integers(1 << 20, PRIME - 1, 2))
_BYTE_CODES = np.random.default_rng(20240607).integers(1, 2**64, 256, dtype=np.uint64)


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, but for a multiple of it left once: below 2**34 for any x."""
    return (x & _P) + (x >> _BITS)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = _fold(_fold(x))
    return np.where(x >= _P, x - _P, x)


@lru_cache(maxsize=4)
def _powers(bits: int) -> np.ndarray:
    """Per base: its powers and those of its inverse."""
    out = np.ones((4, 1 << bits), np.uint64)
    for row, base in zip(out, [b for base in _BASES for b in (base, pow(base, -1, PRIME))], strict=True):
        n = 1
        while n < len(row):
            row[n : 2 * n] = _reduced(row[:n] * np.uint64(pow(base, n, PRIME)))
            n *= 2
    return out


def powers(n: int) -> np.ndarray:
    """Four rows: the first n powers of each base and of its inverse."""
    return _powers(max(16, int(n).bit_length()))[:, :n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser; spreads weak low bits over the word."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Prefix sums, a row per base, whose differences fingerprint every substring of codes (see spans).

    Sums of terms below 2**33 are exact for 2**31 codes; they are reduced when they are used.
    """
    p = powers(len(codes))
    out = np.zeros((2, len(codes) + 1), np.uint64)
    np.cumsum(_fold((codes & _P) * p[0]), out=out[0, 1:])
    np.cumsum(_fold((codes >> np.uint64(33)) * p[2]), out=out[1, 1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of [start, end), the same wherever the same content stands."""
    p = powers(sums.shape[1])
    low, high = (_reduced(_reduced(sums[i][end] - sums[i][start]) * p[2 * i + 1][start]) for i in (0, 1))
    n = (end - start).astype(np.uint64)
    return mix((low | high << np.uint64(32)) + n * np.uint64(0xD6E8FEB86659FD93))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """run, giving freed memory back to the system when a task ends: workers stay for the next stage, their peak should not."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library keeps what it has
            pass

    return task


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODES[data]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over slices of a string column; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; a word never crosses rows."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, e
    word = ~_IS_SEP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    start = np.flatnonzero(word & (~before | edge[:-1]))
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return spans(prefix_sums(byte_codes(data)), start, end)


def majority_bits(hashes: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per row, the 64 bits that are set in over half of its run of hashes (SimHash)."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    # Runs follow each other, so their sums are one reduction.
    sums = np.add.reduceat(bits, first[full], axis=0, dtype=np.int32)
    packed = np.packbits(sums * 2 > counts[full][:, None], axis=1, bitorder="little")
    out[full] = packed.view(np.uint64).ravel()
    return out


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each i, the position of the (leftmost) smallest of values[i : i + width]."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, size = values, np.arange(len(values)), 1
    while size * 2 <= width:
        left = best[:-size] <= best[size:]
        best, at = np.where(left, best[:-size], best[size:]), np.where(left, at[:-size], at[size:])
        size *= 2
    if size < width:
        shift = width - size
        left = best[:n] <= best[shift : shift + n]
        at = np.where(left, at[:n], at[shift : shift + n])
    return at[:n]


def periodic(codes: np.ndarray, k: int) -> np.ndarray:
    """Whether each k-gram repeats itself with a period of k // 2 or less."""
    out = np.zeros(len(codes) - k + 1, bool)
    for p in range(1, k // 2 + 1):
        same = codes[:-p] == codes[p:]
        block = 1 << ((k - p + 1).bit_length() - 2)  # a run of k - p holds a whole aligned block of so many
        whole = same[: len(same) // block * block].reshape(-1, block)
        if not whole.all(axis=1).any() if block > 8 else not (whole.view(f"u{block}") == int.from_bytes(b"\1" * block, "little")).any():
            continue
        stops = np.concatenate([[-1], np.flatnonzero(~same), [len(same)]])
        long = np.flatnonzero(np.diff(stops) > k - p)
        for a, b in zip((stops[long] + 1).tolist(), stops[long + 1].tolist(), strict=True):
            out[a : b - (k - p) + 1] = True
    return out


def anchors(codes: np.ndarray, row: np.ndarray, window: int, k: int):
    """Winnowing anchors of every window of the given length.

    Each window is owned by the smallest k-gram fingerprint inside it, so that equal windows are owned by equal
    k-grams at equal distance. Periodic k-grams come last in the order: in a run like "of of of" each window would else
    have an anchor of its own, and all windows that begin in such runs, wherever, one gram. Returns arrays (row, first, last, anchor, gram, whole): windows first..last start in
    this row and are owned by the k-gram at anchor, whose fingerprint is gram; whole is the fingerprint of all the
    content they cover together with the anchor's place in it.
    """
    n = len(codes) - window + 1
    if n <= 0:
        e = np.zeros(0, np.int64)
        return e, e, e, e, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    sums = prefix_sums(codes)
    at = np.arange(len(codes) - k + 1)
    grams = spans(sums, at, at + k)
    last_ = periodic(codes, k).astype(np.uint64) << np.uint64(63)
    owner = sliding_argmin(grams >> np.uint64(1) | last_, window - k + 1)
    valid = row[:n] == row[window - 1 : window - 1 + n]
    new = np.ones(n, bool)
    new[1:] = (owner[1:] != owner[:-1]) | (row[1:n] != row[: n - 1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    stop = np.flatnonzero(new | ~valid)
    nxt = np.searchsorted(stop, first, "right")
    last = np.where(nxt < len(stop), stop[np.minimum(nxt, len(stop) - 1)], n) - 1
    anchor = owner[first]
    whole = mix(spans(sums, first, last + window) + (anchor - first).astype(np.uint64))
    return row[first], first, last, anchor, grams[anchor], whole
