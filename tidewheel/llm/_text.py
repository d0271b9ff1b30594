"""Vectorised word splitting and hashing over Arrow text columns.

Words are runs of bytes other than 0x20 and 0x09-0x0D, found on the UTF-8
buffer of a whole Arrow batch without making Python strings. A word's identity
is a 64-bit hash (polynomial over random byte codes, then a finaliser), so two
different words of one comparison are confused with a chance near 2**-64.
All arithmetic is modulo 2**64 and every buffer is walked in bounded blocks, so
the memory a batch needs does not depend on the length of its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18
SHINGLE_WORDS = 5

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its modular inverse, for i up to BLOCK_BYTES."""
    if not _POWERS:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(BLOCK_BYTES + 1, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def row_blocks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes at most, one row at least."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


class Words:
    """Word spans of some texts. first[i]:first[i + 1] are the words of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.data, self.offsets, self.lower = data, offsets, lower
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        starts, ends = [], []
        for at in range(0, len(data), BLOCK_BYTES):
            to = min(at + BLOCK_BYTES, len(data))
            inside = np.zeros(to - at + 2, bool)
            inside[1:-1] = ~_SPACE[data[at:to]]
            inside[0] = at > 0 and not _SPACE[data[at - 1]]
            inside[-1] = to < len(data) and not _SPACE[data[to]]
            starts.append(np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[at:to])) + at)
            ends.append(np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[at + 1 : to + 1])) + at + 1)
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.starts, offsets)
        self._hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = span_hashes(self.data, self.starts, self.ends, self.lower)
        return self._hashes


def _long_sum(data: np.ndarray, lower: bool) -> int:
    """The polynomial of one span longer than a block, block by block."""
    up, total = _powers()[0], 0
    for at in range(0, len(data), BLOCK_BYTES):
        block = data[at : at + BLOCK_BYTES]
        part = (_CODES[_LOWER[block] if lower else block] * up[: len(block)]).sum(dtype=np.uint64)
        total += int(part) * pow(_BASE, at, 2**64)
    return total


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each byte span; spans ascend and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    up, down = _powers()
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = int(np.searchsorted(ends, low + BLOCK_BYTES, "right"))
        if to <= at:  # one span over a block
            high = int(ends[at])
            out[at] = (_long_sum(data[low:high], lower) + high - low) % 2**64
            at += 1
            continue
        high = int(ends[to - 1])
        block = data[low:high]
        if lower:
            block = _LOWER[block]
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_CODES[block] * up[: high - low], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        at = to
    return mix(out)


def grams(hashes: np.ndarray, n: int = SHINGLE_WORDS) -> np.ndarray:
    """The hash of each window of n consecutive words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out += mix(hashes[k : len(hashes) - n + 1 + k], k + 1)
    return mix(out)


def shingle_set(hashes: np.ndarray, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct n-word shingles as ascending signed 64-bit hashes. A text of
    fewer words is one shingle, its whole sequence; one without words has none."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    found = grams(hashes, min(n, len(hashes)))
    if len(hashes) < n:
        found = mix(found, 100 + len(hashes))
    found = np.sort(found.view(np.int64))
    return found[np.concatenate(([True], found[1:] != found[:-1]))]
