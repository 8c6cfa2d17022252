"""Whole texts of an Arrow batch as numpy arrays of word and shingle hashes.

The bytes of a batch are scanned in blocks of about ``BLOCK_BYTES``, so memory
stays bounded whatever the number of rows; only a single longer text makes a
longer block. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 21
SHINGLE_WORDS = 5

_random = np.random.default_rng(20240130)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; kept for the next call only up to a block's length."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    tables = []
    for base in (_BASE, _INVERSE):
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        tables.append(np.multiply.accumulate(steps))
    if n <= BLOCK_BYTES + (1 << 16):
        _powers[:] = tables
    return tables[0][:n], tables[1][:n]


@dataclass
class Block:
    """Some consecutive texts of a batch: bytes, text offsets, and words in order."""

    first: int  # index of the first text in the batch
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray  # index of each word's text, from 0
    hashes: np.ndarray

    @property
    def count(self) -> int:
        return len(self.offsets) - 1

    @property
    def bounds(self) -> np.ndarray:
        """Words of text i are ``bounds[i]:bounds[i + 1]``."""
        return np.searchsorted(self.text, np.arange(self.count + 1))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of every text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pa.array(column).cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def split_words(
    data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = IS_SPACE,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of every run of bytes that are not ``breaks``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = breaks[data]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(after & ~space) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of byte spans in order, equal for equal bytes wherever they stand.

    Spans are hashed in slices of about ``BLOCK_BYTES``, so the tables stay that small
    whatever the length of the data; only a single longer span makes a longer slice.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, "right")), i + 1)
        base, stop = int(starts[i]), int(ends[j - 1])
        n = stop - base
        power, inverse = _power_tables(n + 1)
        values = (_BYTE[LOWER] if lower else _BYTE)[data[base:stop]]
        values *= power[:n]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values, out=total[1:])
        first, last = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64))
        i = j
    return out


def blocks(column: pa.Array, lower: bool = True) -> Iterator[Block]:
    """The texts of a column in blocks of bounded size."""
    data, offsets = buffers(column)
    first, last = 0, len(offsets) - 1
    while first < last:
        stop = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1
        stop = min(max(stop, first + 1), last)
        part = data[offsets[first]:offsets[stop]]
        local = offsets[first:stop + 1] - offsets[first]
        starts, ends, text = split_words(part, local)
        yield Block(first, part, local, starts, ends, text, span_hashes(part, starts, ends, lower))
        first = stop


@dataclass
class Parts:
    """Consecutive texts of a batch, or stretches of one long text: bytes, offsets, text indices."""

    data: np.ndarray
    offsets: np.ndarray
    text: np.ndarray  # index in the batch of the text of each part
    before: np.ndarray  # bytes of the same text before each part
    rest: np.ndarray  # bytes of the last text after the group
    prior: np.ndarray  # up to 16 bytes of the first part's text before the group


def parts(column: pa.Array, breaks: np.ndarray = IS_SPACE, limit: int = BLOCK_BYTES) -> Iterator[Parts]:
    """The texts of a column in groups of about ``limit`` bytes; a longer text is cut after a byte of ``breaks``.

    Every group is consecutive in the column's bytes, so memory is bounded by the limit
    whatever the length of a text; only a single longer word makes a longer group.
    """
    data, offsets = buffers(column)
    held: list[tuple[int, int]] = []
    first = 0

    def group(stop: int) -> Parts:
        texts = np.array([t for t, _ in held])
        starts = np.array([a for _, a in held])
        rest = data[stop:offsets[texts[-1] + 1]]
        prior = data[max(first - 16, offsets[texts[0]]):first]
        return Parts(data[first:stop], np.append(starts, stop) - first, texts, starts - offsets[texts], rest, prior)

    for text in range(len(offsets) - 1):
        at, end = int(offsets[text]), int(offsets[text + 1])
        while True:
            held.append((text, at))
            stop = end
            if end - first > limit:
                stop = min(max(first + limit, at), end)
                if stop - at <= limit // 2 and end - at <= limit:
                    stop = end  # a text that fits into a group is never cut
                while stop < end and not breaks[data[stop - 1]]:
                    hit = np.flatnonzero(breaks[data[stop:min(stop + 4096, end)]])
                    stop = stop + int(hit[0]) + 1 if len(hit) else min(stop + 4096, end)
            if stop - first >= limit:
                yield group(stop)
                held, first = [], stop
            if stop >= end:
                break
            at = stop
    if held:
        yield group(int(offsets[-1]))


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive values; shorter by ``size - 1``."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total *= _STEP
        total += hashes[i:i + n]
    return mix(total)


def shingle_sets(hashes: np.ndarray, owner: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``count`` word lists, sorted in each, and their bounds.

    A list with fewer words than a shingle gives its whole sequence as the only one.
    """
    bounds = np.searchsorted(owner, np.arange(count + 1))
    sizes = np.diff(bounds)
    all_runs = runs(hashes, SHINGLE_WORDS)
    inside = owner[:len(all_runs)] == owner[len(hashes) - len(all_runs):]
    long_values, long_owner = all_runs[inside], owner[:len(all_runs)][inside]
    values, owners = [long_values], [long_owner]
    for size in range(1, SHINGLE_WORDS):
        short = np.flatnonzero(sizes == size)
        if len(short):
            total = np.full(len(short), size, np.uint64)
            for i in range(size):
                total *= _STEP
                total += hashes[bounds[short] + i]
            values.append(mix(total ^ np.uint64(0xA5A5A5A5)))
            owners.append(short)
    values, owners = np.concatenate(values), np.concatenate(owners)
    if len(owners) > len(long_owner):
        order = np.argsort(owners, kind="stable")
        values, owners = values[order], owners[order]
    bounds = np.searchsorted(owners, np.arange(count + 1))
    for i in np.flatnonzero(np.diff(bounds) > 1):
        values[bounds[i]:bounds[i + 1]].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    values, owners = values[new], owners[new]
    return values, np.searchsorted(owners, np.arange(count + 1))
