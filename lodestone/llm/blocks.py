"""Arrow text columns as flat NumPy arrays: blocks of documents, words, substring hashes.

Every document operator that walks bytes or words uses these. A block is a run of whole
documents (their UTF-8 bytes lie in one buffer), so NumPy works on a few hundred
documents at a time and a worker holds one block only. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Longest substring that the polynomial hash names; words and lines above it are named by XXH3.
#: Modulo 2^64, some long strings (Thue-Morse words from 1,024 letters on) collide for every multiplier.
LONG = 64
#: Bytes between words: space, and tab to carriage return.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_RNG = np.random.Generator(np.random.PCG64(20240229))
#: Odd multipliers of the two polynomial hashes, their inverses modulo 2^64, and a random word per byte value.
BASES = [int(x) | 1 for x in _RNG.integers(1 << 40, 1 << 63, 2)]
INVERSES = [pow(c, -1, 1 << 64) for c in BASES]
TABLES = [_RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in BASES]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of a multiplier and of its inverse, grown on demand."""

    def __init__(self, lane: int):
        self.base, self.inverse, self.n = BASES[lane], INVERSES[lane], 0
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            self.up, self.down = (self._run(c) for c in (self.base, self.inverse))
        return self.up, self.down

    def _run(self, c: int) -> np.ndarray:
        out, have, step = np.ones(self.n, np.uint64), 1, c
        while have < self.n:
            more = min(have, self.n - have)
            out[have : have + more] = out[:more] * np.uint64(step)
            have, step = have + more, step * step % (1 << 64)
        return out


_POWERS = [Powers(0), Powers(1)]


class Substrings:
    """64-bit hashes of any substrings of one array of units, each in constant time."""

    def __init__(self, units: np.ndarray, lane: int = 0):
        n = len(units) + 1
        up, self.down = _POWERS[lane].upto(n)
        values = TABLES[lane][units] if units.dtype == np.uint8 else units
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(values * up[: n - 1], out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def named(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit name of each substring's bytes and length."""
    out = Substrings(data, lane).at(start, end) + mix((end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), lane)
    return out


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and where each row starts; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


class Block:
    """Whole documents: ids, one buffer, and the start of each document in it."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        self.ids, self.data, self.offsets = ids, data, offsets

    def __len__(self) -> int:
        return len(self.ids)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self, fold: bool = False) -> Words:
        return Words(LOWER[self.data] if fold else self.data, self.offsets)


class Words:
    """Maximal runs of bytes that are no separators, in all documents of a block."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SEPARATORS):
        self.data = data
        inside = np.zeros(len(data) + 2, bool)
        np.logical_not(separators[data], out=inside[1:-1])
        cut = np.zeros(len(data) + 1, bool)  # a word also ends where its document does
        cut[offsets] = True
        edge_in = inside[1:] & (~inside[:-1] | cut)
        edge_out = inside[:-1] & (~inside[1:] | cut)
        self.start, self.end = np.flatnonzero(edge_in), np.flatnonzero(edge_out)
        #: Words of document i are first[i] to first[i + 1].
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes and length."""
        return named(self.data, self.start, self.end, lane)

    def bytes(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def blocks(batches: Iterator[pa.RecordBatch], key: str, text: str, limit: int = 1 << 20) -> Iterator[Block]:
    """Blocks of about limit bytes at most, unless a single document is longer."""
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        data, offsets = flat(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield Block(ids[at:to], data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            at = to


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each length, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)
