"""A minimal perfect hash over 64-bit keys, by levels of bit arrays (Limasset et al. 2017), in NumPy.

At each level every remaining key names one bit. Bits named once are set and
own their key; keys that collide go on to the next, smaller level. A key's
number is the count of set bits before its own, over all levels.
"""

from __future__ import annotations

import struct

import numpy as np

_LEVELS = 48


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser, seeded by the level."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class MinimalPerfectHash:
    """Maps n distinct keys to 0..n-1; another key gets any number, or -1 where it meets no set bit."""

    def __init__(self, sizes: list[int], words: list[np.ndarray], rest: np.ndarray):
        self.sizes, self.words, self.rest = sizes, words, rest
        self.ranks, total = [], 0
        for w in words:
            counts = np.bitwise_count(w).astype(np.int64)
            self.ranks.append(np.cumsum(counts) - counts + total)
            total += int(counts.sum())
        self.first_rest = total

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> "MinimalPerfectHash":
        left, sizes, words = np.unique(keys.astype(np.uint64)), [], []
        while len(left) and len(sizes) < _LEVELS:
            size = max(64, int(gamma * len(left)) // 64 * 64 + 64)
            at = (mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            once = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(once, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~once[at]]
        return cls(sizes, words, left)

    def __len__(self) -> int:
        return self.first_rest + len(self.rest)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        found, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, words, ranks) in enumerate(zip(self.sizes, self.words, self.ranks)):
            at = mix(keys[open_], level) % np.uint64(size)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            w = words[word]
            hit = (w >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(w & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            found[open_[hit]] = (ranks[word] + below)[hit]
            open_ = open_[~hit]
            if not len(open_):
                return found
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            ok = self.rest[at] == keys[open_]
            found[open_[ok]] = self.first_rest + at[ok]
        return found

    def to_bytes(self) -> bytes:
        head = struct.pack(f"<II{len(self.sizes)}Q", len(self.sizes), len(self.rest), *self.sizes)
        return head + b"".join(w.tobytes() for w in self.words) + self.rest.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> "MinimalPerfectHash":
        levels, rest = struct.unpack_from("<II", blob)
        sizes, at, words = list(struct.unpack_from(f"<{levels}Q", blob, 8)), 8 + 8 * levels, []
        for size in sizes:
            words.append(np.frombuffer(blob, np.uint64, size // 64, at))
            at += size // 8
        return cls(sizes, words, np.frombuffer(blob, np.uint64, rest, at))
