"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

Words are runs of bytes other than 0x20 and 0x09-0x0D, so the split is right for any UTF-8 text. A word's hash is a
prefix-sum polynomial over per-byte random 64-bit values (A-Z count as a-z), mixed at the end. Work goes in
segments that end at white space or at the end of a text, so the extra memory follows the segment size, not
the length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_EXACT_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    up = _powers(_R, 1024)
    down = _powers(_R_INV, 1024)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up))
            cls.up, cls.down = _powers(_R, size), _powers(_R_INV, size)
        return cls.up, cls.down


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, exact_case: bool = False) -> np.ndarray:
    """64-bit hashes of data[start:end] for ascending, disjoint spans."""
    table = _EXACT_BYTE if exact_case else _BYTE
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        first = int(starts[at])
        to = max(int(np.searchsorted(ends, first + SEGMENT, "right")), at + 1)
        last = int(ends[to - 1])
        up, down = _Powers.get(last - first + 1)
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum(table[data[first:last]] * up[: last - first], out=sums[1:])
        s, e = starts[at:to] - first, ends[at:to] - first
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = to
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): word i of text d is in bounds[d] <= i < bounds[d + 1]."""
    solid = ~SPACE[data]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begin[cuts] = solid[cuts]
    end[cuts - 1] = solid[cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word windows of a run of word hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = words[:m].copy()
    for k in range(1, n):
        h = mix(h + np.uint64(0x9E3779B97F4A7C15)) + words[k : k + m]
    return mix(h)


def batches(iterator, text: str, size: int = 4 << 20):
    """Record batches cut so that each holds about `size` bytes of text, or one row."""
    for batch in iterator:
        if batch.num_rows == 0:
            continue
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
        lengths = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        lengths = lengths - lengths[0]
        at = 0
        while at < batch.num_rows:
            to = max(int(np.searchsorted(lengths, lengths[at] + size, "right")) - 1, at + 1)
            yield batch.slice(at, to - at)
            at = to
