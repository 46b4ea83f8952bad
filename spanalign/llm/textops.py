"""Small vector helpers that run inside tasks on Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``most`` bytes of text (a longer text is
    a piece of its own), so that work memory doesn't follow the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(size) // most
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts (null: empty) and the n + 1 offsets into them."""
    a = pc.fill_null(texts, "").cast(pa.large_binary())
    _, ends, data = a.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    every = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return every[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word."""
    on = ~SPACE[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = on
    before[offsets] = False
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = on
    after[offsets] = False
    starts = np.flatnonzero(on & ~before[:-1])
    ends = np.flatnonzero(on & ~after[1:]) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit hashes spread over all places."""
    h = h.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i < n."""
    if 0 not in _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            _POWERS[k] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, base, dtype=np.uint64))])
    return _POWERS[0][:n], _POWERS[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes that depends on its bytes only."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def runs(on: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every maximal run of marked bytes."""
    last = np.zeros(len(on) + 1, dtype=bool)  # the last byte of a text: a run ends there
    last[offsets[1:]] = True
    begin, end = on.copy(), on.copy()
    begin[1:] &= ~on[:-1] | last[1:-1]
    end[:-1] &= ~on[1:] | last[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """``span_hashes`` of ascending spans, worked on in windows of about
    ``most`` bytes, so that work memory doesn't follow a text."""
    out = np.zeros(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + most, side="right")))
        a, b = int(starts[at]), int(ends[to - 1])
        out[at:to] = span_hashes(data[a:b], starts[at:to] - a, ends[at:to] - a)
        at = to
    return out
