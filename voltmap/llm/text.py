"""Word boundaries and word, shingle and set hashes of whole Arrow text columns.

Everything works on the UTF-8 bytes of a batch at once; no Python loop runs over words.
A word is a maximal run of bytes other than space, \\t, \\n, \\v, \\f and \\r; hashes see A-Z
in lower case.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once: keeps temporary arrays inside the caches.
PIECE_BYTES = 1 << 19

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_P, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**0..P**n and the inverses, modulo 2**64."""
    size = PIECE_BYTES if n <= PIECE_BYTES else n
    if size not in _POWERS:
        forth = np.full(size + 1, _P, dtype=np.uint64)
        back = np.full(size + 1, _INVERSE, dtype=np.uint64)
        forth[0] = back[0] = 1
        made = np.multiply.accumulate(forth), np.multiply.accumulate(back)
        if size > PIECE_BYTES:
            return made
        _POWERS[size] = made
    return _POWERS[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(x + np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % (1 << 64)))


@dataclass
class Words:
    """Words of a batch: byte ranges, and the range of words of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def texts(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word in lower case."""
        return self.prefix_hashes((None,))[0]

    def prefix_hashes(self, widths: tuple[int | None, ...]) -> list[np.ndarray]:
        """Hashes of the first bytes of each word in lower case; None: of the whole word."""
        outs = [np.empty(len(self.starts), dtype=np.uint64) for _ in widths]
        at = 0
        while at < len(self.starts):
            upto = max(int(np.searchsorted(self.ends, self.starts[at] + PIECE_BYTES, "right")), at + 1)
            low, high = int(self.starts[at]), int(self.ends[upto - 1])
            forth, back = _powers(high - low)
            sums = np.zeros(high - low + 1, dtype=np.uint64)
            codes = _LOWER[self.data[low:high]].astype(np.uint64) + np.uint64(1)
            np.cumsum(codes * forth[: high - low], out=sums[1:])
            s, e = self.starts[at:upto] - low, self.ends[at:upto] - low
            for width, out in zip(widths, outs):
                stop = e if width is None else np.minimum(e, s + width)
                out[at:upto] = (sums[stop] - sums[s]) * back[s]
            at = upto
        return [mix(out) for out in outs]


def words(texts: pa.Array) -> Words:
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    space = _SPACE[data]
    first, last = np.ones(len(data), dtype=bool), np.ones(len(data), dtype=bool)
    first[1:] = space[:-1]
    last[:-1] = space[1:]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(first & ~space), np.flatnonzero(last & ~space) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text each; one row at least."""
    column = batch.column(text).cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        upto = max(int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1, at + 1)
        yield batch.slice(at, upto - at)
        at = upto
    # Workers live on and share an executor's memory: give back what the batch has used.
    pa.default_memory_pool().release_unused()


@dataclass
class Shingles:
    """Hashes of runs of words, the word each begins at, and the range of each text."""

    values: np.ndarray
    at: np.ndarray
    bounds: np.ndarray


def shingles(found: Words, hashes: np.ndarray, width: int) -> Shingles:
    """Runs of `width` words; a shorter text that has words is one run of all of them."""
    n = len(hashes)
    factors = [np.uint64(pow(0xA24BAED4963EE407 | 1, j, 1 << 64)) for j in range(width)]
    rolled = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        rolled[: max(n - j, 0)] += hashes[j:] * factors[j]
    counts = found.counts
    short = np.flatnonzero((counts > 0) & (counts < width))
    begins = found.bounds[short]
    own = np.zeros(len(short), dtype=np.uint64)
    for j in range(width - 1):
        has = counts[short] > j
        own[has] += hashes[begins[has] + j] * factors[j]
    rolled[begins] = own
    keep = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(keep)])
    at = np.repeat(found.bounds[:-1] - bounds[:-1], keep) + np.arange(bounds[-1])
    return Shingles(mix(rolled[at] + np.uint64(width)), at, bounds)


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each range, and the new bounds."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    v, o = v[new], o[new]
    return v, np.searchsorted(o, np.arange(len(bounds)))


def reduce_ranges(ufunc: np.ufunc, values: np.ndarray, bounds: np.ndarray, empty) -> np.ndarray:
    """`ufunc` over each range of `values`; `empty` for empty ranges."""
    out = np.full(len(bounds) - 1, empty, dtype=values.dtype)
    full = np.diff(bounds) > 0
    if full.any():
        out[full] = ufunc.reduceat(values, bounds[:-1][full])
    return out


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column whose rows are ranges of `values`."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
