"""SuperMinHash signatures of many sets at once, level by level.

Each element owns a random permutation of the slots. At level j it offers the
value j plus a fraction to the j-th slot of its permutation, and a slot keeps
the smallest offer. Values of a later level are always larger, so a set stops as
soon as all its slots hold a value: that is the early stop of the method, and a
large set stops after a few levels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from heliospan.llm.words import mix

_EMPTY = np.uint64((1 << 64) - 1)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
PIECE = 1 << 15


def _piece(values: np.ndarray, owner: np.ndarray, count: int, slots: int) -> np.ndarray:
    flat = np.full(count * slots, _EMPTY, np.uint64)
    permutation = None
    values, owner = values.copy(), owner.copy()
    for level in range(slots):
        draw = mix(values + np.multiply([_GOLDEN], np.uint64(level + 1)))
        pick = level + ((draw & np.uint64(0xFFFF)) % np.uint64(slots - level)).astype(np.int64)
        offer = (draw >> np.uint64(16)) | np.uint64(level << 48)
        if permutation is None:
            slot = pick
        else:
            rows = np.arange(len(values))
            slot = permutation[rows, pick].astype(np.int64)
            permutation[rows, pick] = permutation[:, level]
        np.minimum.at(flat, owner * slots + slot, offer)
        open_sets = (flat.reshape(count, slots) == _EMPTY).any(axis=1)
        keep = open_sets[owner]
        if not keep.any():
            break
        if permutation is None or keep.mean() < 0.7:
            if permutation is None:
                pick = pick[keep]
                permutation = np.tile(np.arange(slots, dtype=np.uint8), (len(pick), 1))
                permutation[np.arange(len(pick)), pick] = 0
            else:
                permutation = permutation[keep]
            values, owner = values[keep], owner[keep]
    return flat.reshape(count, slots)


def signatures(values: np.ndarray, bounds: np.ndarray, slots: int) -> np.ndarray:
    """One row of ``slots`` values per set; an empty set's row is all ones.

    ``slots`` is at most 256. Sets are taken in pieces of about ``PIECE`` elements.
    """
    count = len(bounds) - 1
    out = np.empty((count, slots), np.uint64)
    first = 0
    while first < count:
        stop = int(np.searchsorted(bounds, bounds[first] + PIECE, "right")) - 1
        stop = min(max(stop, first + 1), count)
        sizes = np.diff(bounds[first:stop + 1])
        owner = np.repeat(np.arange(stop - first), sizes)
        out[first:stop] = _piece(values[bounds[first]:bounds[stop]], owner, stop - first, slots)
        first = stop
    return out


@dataclass(frozen=True)
class Banding:
    """Bands of ``rows`` slots each, drawn from ``slots`` by a fixed seed.

    ``agree`` is the least number of equal last bits of two signatures to be
    compared at all: at a similarity of 0.75 a bit is equal with a chance of 0.875.
    ``parity`` is the width of the parity sketch in bits.
    """

    slots: int
    bands: int
    rows: int
    agree: int
    parity: int

    @property
    def words(self) -> int:
        return self.slots // 64

    def places(self) -> np.ndarray:
        random = np.random.default_rng(self.slots)
        return np.stack([random.permutation(self.slots)[:self.rows] for _ in range(self.bands)])

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """Hash of every band; the band's number is part of it."""
        total = np.tile(np.arange(1, self.bands + 1, dtype=np.uint64) * _GOLDEN, (len(signature), 1))
        for places in self.places().T:
            total = mix(total ^ signature[:, places])
        return total.view(np.int64)

    def bits(self, signature: np.ndarray) -> np.ndarray:
        """The last bit of every slot, packed into 64-bit words."""
        return np.packbits((signature & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)

    def parities(self, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Odd or even number of elements per hash cell of every set, packed into 64-bit words.

        A cell that differs between two sets holds at least one element of only one of
        them, so the differing bits never exceed the size of the symmetric difference.
        """
        words, count = self.parity // 64, len(bounds) - 1
        cell = mix(values + _GOLDEN) % np.uint64(self.parity)
        at = np.repeat(np.arange(count), np.diff(bounds)) * words + (cell >> np.uint64(6)).astype(np.int64)
        flat = np.zeros(count * words, np.uint64)
        np.bitwise_xor.at(flat, at, np.uint64(1) << (cell & np.uint64(63)))
        return flat.reshape(count, words).view(np.int64)
