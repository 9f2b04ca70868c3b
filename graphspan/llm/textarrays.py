"""Words, word hashes and window hashes of many texts at once, as numpy arrays.

Texts come as one Arrow column; nothing here loops over words in Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes that separate words of kind "spaces": [\x20\x09-\x0D]
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BLOCK = 1 << 18  # values that are hashed at once, so that they stay in a cache
_BASE, _BASE2 = 0x9E3779B97F4A7C1B, 0xC2B2AE3D27D4EB4B  # both 3 mod 8
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each begins (n+1 offsets); a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def words(data: np.ndarray, bounds: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text its first word (n+1 offsets into the words)."""
    inside = ~gap[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    filled = bounds[:-1][bounds[:-1] < bounds[1:]]
    before[filled] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[bounds[1:][bounds[:-1] < bounds[1:]] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of x over all 64."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    held = _powers.get(base)
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 16, min(2 * n, _BLOCK + 1))
        out = []
        for x in (base, pow(base, -1, 1 << 64)):
            steps, have = np.ones(size, np.uint64), 1
            while have < size:  # the powers so far, times the next one
                more = min(have, size - have)
                np.multiply(steps[:more], np.uint64(pow(x, have, 1 << 64)), out=steps[have : have + more])
                have += more
            out.append(steps)
        held = (out[0], out[1])
        if size <= 2 * _BLOCK:
            _powers[base] = held
    return held


def _rolled(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[s:e] for each span, from one running sum."""
    up, down = _power(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; long inputs go through in blocks of whole words."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        h = _rolled(_TABLE[data[lo:hi]], starts[i:j] - lo, ends[i:j] - lo, _BASE)
        out[i:j] = mix(h + (ends[i:j] - starts[i:j]).astype(np.uint64) * np.uint64(_BASE2))
        i = j
    return out


def window_hashes(hashes: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of width word hashes (len - width + 1 of them)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if salt:
        hashes = mix(hashes + np.uint64(salt))
    out = np.empty(n, np.uint64)
    for i in range(0, n, _BLOCK):
        j = min(n, i + _BLOCK)
        at = np.arange(j - i)
        out[i:j] = mix(_rolled(hashes[i : j + width - 1], at, at + width, _BASE2))
    return out


def pack_rising(values: np.ndarray) -> bytes:
    """Rising unsigned integers as one width byte and fixed-width steps."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_rising(packed: bytes) -> np.ndarray:
    """What pack_rising() was given, as uint64."""
    width = packed[0]
    raw = np.frombuffer(packed, np.uint8, offset=1).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)
