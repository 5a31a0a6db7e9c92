"""Word spans and word / n-gram hashes of whole Arrow string columns, vectorised over bytes.

A word is a maximal run of bytes outside space and \\t-\\r; those separators are single ASCII bytes, so the
split is exact on UTF-8. Hashes depend only on a word's bytes: equal words hash equally in every task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20          # bytes hashed at once; only limits scratch arrays, never what is read
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stream(seed: int, n: int) -> np.ndarray:
    i = np.arange(1, n + 1, dtype=np.uint64)
    return mix64(np.uint64(seed) + i * np.uint64(0x9E3779B97F4A7C15))


class _Rolling:
    """Sums of value * base^position modulo 2^64; base is odd, so a span's shift divides out exactly."""

    def __init__(self, seed: int):
        self.table = _stream(seed, 256)
        self.base = int(_stream(seed + 1, 1)[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
            have = 1
            while have < size:  # doubling: powers of the second half are the first half shifted
                take = min(have, size - have)
                up[have:have + take] = up[:take] * np.uint64(pow(self.base, have, 1 << 64))
                down[have:have + take] = down[:take] * np.uint64(pow(self.inverse, have, 1 << 64))
                have += take
            self.up, self.down = up, down
        return self.up, self.down

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = self._powers(len(values) + 1)
        total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[:len(values)], out=total[1:])
        return mix64((total[ends] - total[starts]) * down[starts])


_BYTES = {0: _Rolling(11), 1: _Rolling(23)}
_GRAMS = {0: _Rolling(37), 1: _Rolling(53)}


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null rows are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


class Words:
    """Words of several texts in reading order.

    ``first``: index of each text's first word (one more entry than texts); ``starts`` / ``ends``: byte
    positions in ``data``; ``hashes``: one uint64 per word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashed: bool = True, family: int = 0,
                 separators: np.ndarray = _SEP):
        starts, ends, hashes = [], [], []
        at, n = 0, len(data)
        bounds = offsets[:-1]
        while at < n:
            to = min(n, at + CHUNK)
            if to < n:
                to = self._cut(data, offsets, at, to, separators)
            piece = data[at:to]
            word = ~separators[piece]
            begin = word.copy()
            begin[1:] &= ~word[:-1]
            inner = bounds[np.searchsorted(bounds, at):np.searchsorted(bounds, to)] - at
            begin[inner] |= word[inner]
            end = word.copy()
            end[:-1] &= ~word[1:]
            last = inner[inner > 0] - 1
            end[last] |= word[last]
            s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
            if hashed:
                r = _BYTES[family]
                hashes.append(r.spans(r.table[piece], s, e))
            starts.append(s + at)
            ends.append(e + at)
            at = to
        empty = np.zeros(0, np.int64)
        self.data = data
        self.starts = np.concatenate(starts) if starts else empty
        self.ends = np.concatenate(ends) if ends else empty
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.starts, offsets)

    @staticmethod
    def _cut(data: np.ndarray, offsets: np.ndarray, at: int, to: int, sep: np.ndarray) -> int:
        """A place in or after (at, to] that splits no word: a text's start, else a separator."""
        k = int(np.searchsorted(offsets, to, "right")) - 1
        if offsets[k] > at:
            return int(offsets[k])
        seps = np.flatnonzero(sep[data[at:to]])
        if len(seps):
            return at + int(seps[-1]) + 1
        limit = int(offsets[k + 1])
        while to < limit:  # one word longer than a chunk
            seps = np.flatnonzero(sep[data[to:min(limit, to + CHUNK)]])
            if len(seps):
                return to + int(seps[0]) + 1
            to = min(limit, to + CHUNK)
        return limit

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def grams(word_hashes: np.ndarray, n: int, family: int = 0) -> np.ndarray:
    """Hash of the n-gram starting at each word; the last n - 1 words start none."""
    m = len(word_hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    i = np.arange(m)
    return _GRAMS[family].spans(word_hashes, i, i + n)


def slices(offsets: np.ndarray, most: int = 4 << 20):
    """Row ranges of about ``most`` bytes: (first row, one past the last); a longer text is a range alone."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(rows, max(to, at + 1))
        yield at, to
        at = to
