"""Bit-sliced Hamming comparison of fingerprints.

Fingerprints are stored vertically: plane p holds bit p of every fingerprint, 64 fingerprints to a
word.  The XOR of two planes gives one bit of 64 distances at once; carry-save counters (one word
per binary digit, held per block) add those bits up.  A block of comparisons is abandoned as soon as
every distance in it exceeds the radius.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
CHECK = 8  # planes between two looks at whether the block can be abandoned
SMALL = 48  # runs up to this size share one vertical layout
QUERIES = 64


def planes(fps: np.ndarray) -> np.ndarray:
    """(n, w) uint64 fingerprints as (64 w, ceil(n / 64)) planes; lane i is bit i % 64 of word i // 64."""
    n, w = fps.shape
    wide = -(-n // 64) * 64
    bits = np.zeros((w * 64, wide), np.uint8)
    raw = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(n, w * 8), axis=1, bitorder="little")
    bits[:, :n] = raw.T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def within(xor: Callable[[int], np.ndarray], depth: int, radius: int, valid: np.ndarray) -> np.ndarray:
    """Lanes of `valid` whose distance is at most radius; xor(p) gives the differing lanes of plane p."""
    digits = [np.zeros_like(valid) for _ in range(max(1, radius.bit_length()))]
    dead = ~valid
    for p in range(depth):
        carry = xor(p)
        for d in digits:
            up = d & carry
            d ^= carry
            carry = up
        dead |= carry  # the counter overflowed: beyond any radius it can hold
        if p % CHECK == CHECK - 1 or p == depth - 1:
            dead |= _more_than(digits, radius)
            if (dead == ONES).all():
                break
    return ~dead


def _more_than(digits: list[np.ndarray], radius: int) -> np.ndarray:
    more, equal = np.zeros_like(digits[0]), np.full_like(digits[0], ONES)
    for k in reversed(range(len(digits))):
        if radius >> k & 1:
            equal &= digits[k]
        else:
            more |= equal & digits[k]
            equal &= ~digits[k]
    return more


def lanes(word: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(word.view(np.uint8), bitorder="little"))


def connect(fps: np.ndarray, run: np.ndarray, radius: int) -> np.ndarray:
    """Label of each fingerprint: the least index that chains of links within its run reach.

    run: sorted group numbers; only members of one group are compared, all of them with each other.
    """
    n = len(run)
    label = np.arange(n)
    if n < 2:
        return label
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    size = np.diff(np.r_[first, n])
    small = np.repeat((size > 1) & (size <= SMALL), size)
    if small.any():
        idx = np.flatnonzero(small)
        label[idx] = idx[_shifted(fps[idx], run[idx], radius)]
    for a, m in zip(first[size > SMALL], size[size > SMALL], strict=True):
        label[a : a + m] = a + _blocked(fps[a : a + m], radius)
    return label


def _shifted(fps: np.ndarray, run: np.ndarray, radius: int) -> np.ndarray:
    """Every lane i against lane i + r of the same run, for r = 1, 2, ...: one vertical layout for all runs."""
    n, depth = len(run), fps.shape[1] * 64
    p = np.concatenate([planes(fps), np.zeros((depth, 2), np.uint64)], axis=1)
    width = p.shape[1] - 2
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    end = np.repeat(np.r_[first[1:], n], np.diff(np.r_[first, n]))
    parent = np.arange(n)
    for r in range(1, int((end - np.arange(n)).max())):
        ok = np.zeros(width * 64, np.uint8)
        ok[:n] = np.arange(n) + r < end
        valid = np.packbits(ok, bitorder="little").view(np.uint64)
        q, s = divmod(r, 64)

        def xor(k: int, q: int = q, s: int = s) -> np.ndarray:
            there = p[k, q : q + width]
            if s:
                there = (there >> np.uint64(s)) | (p[k, q + 1 : q + 1 + width] << np.uint64(64 - s))
            return p[k, :width] ^ there

        found = lanes(within(xor, depth, radius, valid))
        for i in found[parent[found] != parent[np.minimum(found + r, n - 1)]]:
            a, b = sorted((int(parent[i]), int(parent[i + r])))
            lo, hi = int(np.searchsorted(run, run[i])), int(end[i])
            parent[lo:hi][parent[lo:hi] == b] = a
    return parent


def _blocked(fps: np.ndarray, radius: int) -> np.ndarray:
    """One large run: QUERIES fingerprints at a time against all later lanes."""
    n, depth = len(fps), fps.shape[1] * 64
    p = planes(fps)
    label = np.arange(n)
    full = np.zeros(p.shape[1] * 64, np.uint8)
    full[:n] = 1
    full = np.packbits(full, bitorder="little").view(np.uint64)
    for lo in range(0, n, QUERIES):
        own = fps[lo : lo + QUERIES]
        bit = np.unpackbits(np.ascontiguousarray(own).view(np.uint8).reshape(len(own), -1), axis=1, bitorder="little").astype(bool)
        mask = np.where(bit, ONES, np.uint64(0))
        w = lo // 64
        ok = within(lambda k, w=w, mask=mask: p[k, w:][None, :] ^ mask[:, k][:, None], depth, radius, np.broadcast_to(full[w:], (len(own), p.shape[1] - w)).copy())
        for q in np.flatnonzero((ok != 0).any(1)):
            near = lanes(ok[q]) + w * 64
            seen = label[near]
            least = seen.min()
            if (seen != least).any():
                label[np.isin(label, np.unique(seen))] = least
    return label
