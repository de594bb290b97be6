"""Vectorised work on the UTF-8 bytes of a batch of texts.

Arrow hands Python the texts of a batch as one byte buffer with offsets. Words
are found, and hashed, for the whole buffer at once, so that no Python object is
made for a word. All functions take and return numpy arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

#: Bytes of text that are worked on at once; bounds the memory of a task.
CHUNK_BYTES = 1 << 20

_U64 = np.uint64
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32

#: The white space that ends a word: blank and the controls 09 to 0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string array into runs of whole texts.

    Yields (first row, row after the last, bytes, offsets); offsets has one
    number more than there are rows. A null text has no bytes. A run holds at
    most ``limit`` bytes unless one text alone is longer.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        last = min(last, n)
        yield row, last, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of every text, and the number of words before each text.

    A word is a maximal run of bytes other than the six of white space, within
    one text. The third array has one number more than there are texts.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    start[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(start)
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Bytes below the end of a span, by how many of a lane's eight are left.
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=_U64)
#: Spans of more bytes are hashed one by one.
_LANES = 8


def _lanes(data: np.ndarray):
    """A function that reads eight bytes of every span from any place on, those beyond its end as zero."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    return lambda at, ends: view[np.minimum(at, len(data))] & _LEFT[np.clip(ends - at, 0, 8)]


def _of_seed(seed: int) -> np.uint64:
    return _U64((2 * seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of every span; ``fold`` reads A-Z as a-z.

    Eight bytes at a time are joined to what came before and mixed, which is not
    linear in them; spans beyond 64 bytes have their xxHash. Hashes of different
    seeds are independent: spans that share one share another by chance only.
    """
    if len(starts) == 0:
        return np.zeros(0, _U64)
    if fold:
        data = FOLD[data]
    read = _lanes(data)
    size = ends - starts
    h = mix(mix(size.astype(_U64) + _of_seed(seed)) ^ read(starts, ends))
    rest = np.flatnonzero(size > 8)
    for k in range(1, _LANES):
        if not len(rest):
            break
        h[rest] = mix(h[rest] * _U64(5) ^ read(starts[rest] + 8 * k, ends[rest]))
        rest = rest[size[rest] > 8 * (k + 1)]
    for i in rest.tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return h


def sequence_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive numbers, mixed one after another; for short sequences."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, _U64)
    h = mix(words[:n] + _of_seed(seed))
    for k in range(1, size):
        h = mix(h * _U64(5) ^ words[k : k + n])
    return h


#: The prime 2**61 - 1, by which remainders are taken with shifts.
_PRIME = (1 << 61) - 1
_powers_cache: dict[tuple[int, int], np.ndarray] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _U64(_PRIME)) + (x >> _U64(61))
    return np.where(x >= _U64(_PRIME), x - _U64(_PRIME), x)


def _times(a: np.ndarray, b) -> np.ndarray:
    """Products modulo the prime; factors are remainders."""
    low = _U64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> _U64(31), a & low, b >> _U64(31), b & low
    middle = a1 * b0 + a0 * b1
    return _reduced((a1 * b1 << _U64(1)) + (middle >> _U64(30)) + ((middle & _U64((1 << 30) - 1)) << _U64(31)) + a0 * b0)


def _powers(base: int, n: int) -> np.ndarray:
    have = _powers_cache.get(base, np.ones(1, _U64))
    while len(have) < n:
        have = np.concatenate([have, _times(have, _U64(pow(base, len(have), _PRIME)))])
    _powers_cache[base] = have
    return have[:n]


def window_hashes(words: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Rabin-Karp hash, modulo 2**61 - 1, of every ``size`` consecutive numbers of ``words``.

    The array is shorter than ``words`` by size - 1; windows that cross from one
    text into the next are among them and are for the caller to leave out. Each
    seed has a base of its own, drawn at random.
    """
    n = len(words)
    if n < size:
        return np.zeros(0, _U64)
    base = int(np.random.Generator(np.random.PCG64(seed)).integers(1 << 59, _PRIME))
    terms = _times(_reduced(words), _powers(base, n))
    high, low = np.zeros(n + 1, _U64), np.zeros(n + 1, _U64)
    np.cumsum(terms >> _U64(31), out=high[1:])
    np.cumsum(terms & _U64((1 << 31) - 1), out=low[1:])
    high, low = _reduced(high[size:] - high[:-size]), _reduced(low[size:] - low[:-size])
    value = _reduced(_times(high, _U64(1 << 31)) + low)
    return mix(_times(value, _powers(pow(base, -1, _PRIME), n)[: n - size + 1]) + _U64(seed))


class Words:
    """Numbers spans of bytes in the order they are met, equal ones alike; exact, for it keeps their bytes.

    Spans of up to 24 bytes are looked up for a whole batch at once in an open
    table of three lanes, longer ones in a dictionary.
    """

    WIDTH = 3

    def __init__(self) -> None:
        self.long: dict[bytes, int] = {}
        self.long_bytes = 0
        self.count = 0
        self.keys = np.zeros((self.WIDTH + 1, 1024), _U64)  # the lanes and the size of every short one, by number
        self.table = np.full(4096, -1, np.int32)  # numbers by place

    def number(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every span's number, and for each number that is new, in ascending order, the place of a span that has it."""
        size = ends - starts
        out = np.full(len(starts), -1, np.int64)
        short = np.flatnonzero(size <= 8 * self.WIDTH)
        read = _lanes(data)
        key = np.stack([*[read(starts[short] + 8 * k, ends[short]) for k in range(self.WIDTH)], size[short].astype(_U64)])
        h = mix(key[self.WIDTH])
        for k in range(self.WIDTH):
            h = mix(h * _U64(5) ^ key[k])
        out[short] = self._find(key, h)
        new = []
        missing = np.flatnonzero(out[short] < 0)
        while len(missing):
            # equal hashes are one span but by an accident, which the next turn mends
            codes, _ = pd.factorize(h[missing])
            first = np.zeros(codes.max() + 1, np.int64)
            first[codes[::-1]] = missing[::-1]
            same = (key[:, missing] == key[:, first[codes]]).all(axis=0)
            self._insert(key[:, first], h[first])
            out[short[missing[same]]] = self.count - len(first) + codes[same]
            new.append(short[first])
            missing = missing[~same]
        if len(short) < len(starts):
            for i in np.flatnonzero(size > 8 * self.WIDTH).tolist():
                raw = data[starts[i] : ends[i]].tobytes()
                at = self.long.get(raw)
                if at is None:
                    at = self.long[raw] = self.count
                    self.count += 1
                    self.long_bytes += len(raw)
                    new.append(np.array([i]))
                out[i] = at
        return out, np.concatenate(new).astype(np.int64) if new else np.zeros(0, np.int64)

    def _find(self, key: np.ndarray, h: np.ndarray) -> np.ndarray:
        found = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        at = (h & _U64(len(self.table) - 1)).astype(np.int64)
        while len(left):
            held = self.table[at]
            here = held >= 0
            left, at, held = left[here], at[here], held[here]
            same = np.ones(len(left), bool)
            for lane, own in zip(key, self.keys, strict=True):
                same &= lane[left] == own[held]
            found[left[same]] = held[same]
            left, at = left[~same], at[~same] + 1 & len(self.table) - 1
        return found

    def _insert(self, key: np.ndarray, h: np.ndarray) -> None:
        n = key.shape[1]
        if self.count + n > self.keys.shape[1]:
            self.keys = np.concatenate([self.keys, np.zeros((self.WIDTH + 1, self.count + 2 * n), _U64)], axis=1)
        self.keys[:, self.count : self.count + n] = key
        numbers = np.arange(self.count, self.count + n)
        self.count += n
        if 2 * self.count > len(self.table):
            self.table = np.full(1 << (4 * self.count).bit_length(), -1, np.int32)
            numbers = np.setdiff1d(np.arange(self.count), np.fromiter(self.long.values(), np.int64, len(self.long)), assume_unique=True)
            h = mix(self.keys[self.WIDTH, numbers])
            for k in range(self.WIDTH):
                h = mix(h * _U64(5) ^ self.keys[k, numbers])
        at = (h & _U64(len(self.table) - 1)).astype(np.int64)
        while len(numbers):
            free = np.flatnonzero(self.table[at] < 0)
            self.table[at[free]] = numbers[free]  # of several for one place, the last stays
            left = self.table[at] != numbers
            numbers, at = numbers[left], at[left] + 1 & len(self.table) - 1


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Positions, in the array of all words, at which a whole window of one text starts.

    ``first``: the number of words before each text, as of word_spans().
    """
    counts = np.maximum(np.diff(first) - size + 1, 0)
    return ranges(first[:-1], counts)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every start, count of them, in one array."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, counts)
