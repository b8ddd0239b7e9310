"""A suffix sort whose comparisons are hash lookups: prefix polynomial hashes and binary search give common extensions."""

from __future__ import annotations

import numpy as np

#: Odd bases; a group that one of them fails on is sorted again under the next.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0xB564EF22EC7AECE5)


class Collision(Exception):
    """Hashes were equal and bytes were not."""


class PrefixHash:
    """Polynomial hash of any substring of a buffer (bytes, or hashes of words) in constant time, modulo 2**64."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]) -> None:
        n = len(data)
        power, inverse = (np.full(n + 1, x, dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64)))
        power[0] = inverse[0] = 1
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(inverse, out=inverse)
        # bytes are spread over the word first, so short texts differ in all bits
        value = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(value * power[:n], out=self.sums[1:])
        self.inverse = inverse

    def __call__(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]


def mixed(h: np.ndarray) -> np.ndarray:
    """The hash with every bit depending on all."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def extension(h: PrefixHash, a: np.ndarray, b: np.ndarray, most: np.ndarray, backwards: bool = False) -> np.ndarray:
    """Length up to most of the common extension at places a and b, by binary search."""
    low, high = np.zeros_like(most), most.copy()
    for _ in range(int(most.max(initial=0)).bit_length() + 1):
        mid = (low + high + 1) // 2
        same = h(a - mid, mid) == h(b - mid, mid) if backwards else h(a, mid) == h(b, mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def sort_suffixes(data: np.ndarray, h: PrefixHash, group: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Order of the suffixes data[start:start + length] within each group (groups are contiguous): a merge sort.

    All merges of a level run side by side; each suffix finds its rank in the sibling run by binary search.
    """
    n = len(start)
    order = np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.concatenate([first, [n]]))
    base, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
    width = 1
    while n and width < sizes.max():
        at = np.arange(n) - base
        run = at // width
        sibling = base + (run ^ 1) * width
        low = np.zeros(n, dtype=np.int64)
        high = np.clip(np.minimum(width, base + size - sibling), 0, None)
        is_left = run % 2 == 0
        while (busy := np.flatnonzero(low < high)).size:
            mid = (low[busy] + high[busy]) // 2
            x, y = order[busy], order[sibling[busy] + mid]
            shared = extension(h, start[x], start[y], np.minimum(length[x], length[y]))
            end_x, end_y = shared == length[x], shared == length[y]
            cx = data[np.minimum(start[x] + shared, len(data) - 1)].astype(np.int64)
            cy = data[np.minimum(start[y] + shared, len(data) - 1)].astype(np.int64)
            less = np.where(end_y, False, np.where(end_x, True, cy > cx))  # x before y
            equal = end_x & end_y
            # a suffix of the left run stands before equal ones of the right run
            beyond = ~(less | (equal & is_left[busy]))
            low[busy], high[busy] = np.where(beyond, mid + 1, low[busy]), np.where(beyond, high[busy], mid)
        pair = base + (run // 2) * 2 * width
        new = np.empty(n, dtype=np.int64)
        new[pair + (at - run * width) + low] = order
        order, width = new, 2 * width
    return order
