"""Arrow text columns as flat numpy arrays: words, their hashes and word shingles, without a Python object per word."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Text is worked on in pieces of about this many bytes, so memory does not follow the batch.
PIECE_BYTES = 4 << 20
# Hashing passes many times over its bytes, so it takes as many as stay in the processor's cache.
_CACHED_BYTES = 128 << 10
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xA0761D6478BD642F)


def worker_memo(key: tuple, build: Callable):
    """``build()`` once per worker process. Kernels travel with the job, so module globals would start anew with each task."""
    home = sys.modules.setdefault("_cuelattice_worker_memo", types.ModuleType("_cuelattice_worker_memo"))
    kept = home.__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = build()
    return kept[key]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; a null is an empty text."""
    col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    blank = np.zeros(256, dtype=bool)
    blank[[32, 9, 10, 11, 12, 13]] = True
    return lower, blank


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True, blank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word ``[^\\x20\\x09-\\x0D]+`` of all rows in order, and the number of words of each row. A-Z count as a-z if ``lower``;
    ``blank`` (a flag per byte value) names other bytes that part words."""
    lower_of, blank_of = worker_memo(("byte tables",), _tables)
    blank_of = blank_of if blank is None else blank
    rows = len(offsets) - 1
    counts = np.zeros(rows, np.int64)
    hashes = []
    n = len(raw)
    pos = 0
    while pos < n:
        end = min(n, pos + _CACHED_BYTES)
        while end < n:  # cut at a blank or where a row starts
            window = blank_of[raw[end : end + 256]]
            step = int(window.argmax()) if window.any() else len(window)
            edge = offsets[min(np.searchsorted(offsets, end), rows)]
            end = min(end + step, int(edge))
            if end >= n or blank_of[raw[end]] or end == edge:
                break
        b = raw[pos:end]
        inside = ~blank_of[b]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        a, z = np.searchsorted(offsets, [pos, end])
        edges = offsets[a:z] - pos
        edges = edges[edges < len(b)]
        first[edges] = inside[edges]
        starts = np.flatnonzero(first)
        if len(starts):
            stops = np.flatnonzero(inside & ~np.append(inside[1:] & ~first[1:], False)) + 1
            lengths = stops - starts
            at = np.cumsum(lengths) - lengths
            place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
            powers = np.cumprod(np.full(int(lengths.max()), _BASE, dtype=np.uint64))
            h = np.add.reduceat((lower_of[b] if lower else b)[inside].astype(np.uint64) * powers[place], at)
            hashes.append(mix64(h ^ (lengths.astype(np.uint64) * _ODD)))
            row = np.searchsorted(offsets, starts + pos, side="right") - 1
            counts += np.bincount(row, minlength=rows)
        pos = end
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def shingle_sets(h: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the ``width``-word shingles of each row, flat, and their number per row.

    Fewer words than ``width`` make one shingle of the whole sequence; no words make none.
    """
    ends = np.cumsum(counts)
    out, sizes = [], np.zeros(len(counts), np.int64)
    acc = None
    if len(h) >= width:
        acc = np.zeros(len(h) - width + 1, np.uint64)
        for k in range(width):
            acc = mix64(acc + h[k : len(h) - width + 1 + k] * _ODD)
    for i, (e, c) in enumerate(zip(ends.tolist(), counts.tolist())):
        if c == 0:
            continue
        if c >= width:
            got = np.unique(acc[e - c : e - width + 1])
        else:
            one = np.full(1, np.uint64(c))
            for k in range(c):
                one = mix64(one + h[e - c + k : e - c + k + 1] * _ODD)
            got = one
        sizes[i] = len(got)
        out.append(got)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes
