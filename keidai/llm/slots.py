"""A minimal perfect hash of 64-bit keys, with the keys stored for verification; built and read by whole numpy arrays."""

from __future__ import annotations

import numpy as np

#: Bits a key at each level of the hash: more of them, fewer levels.
SPREAD = 2.0


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """Well spread 64-bit values of keys; different for each seed."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Slots:
    """Gives each of n distinct keys a slot of its own in 0..n-1, and any other key -1.

    Keys that are alone at their place of a level's bits stay there; the others try the next level. A key's slot is the
    number of set bits before its own. As other keys meet set bits too, each slot keeps its key.
    """

    def __init__(self, keys: np.ndarray) -> None:
        left = keys.astype(np.uint64)
        self.sizes: list[int] = []
        levels = []
        while len(left):
            size = max(64, int(len(left) * SPREAD) + 63 & ~63)
            at = (mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, bool)
            bits[at[alone]] = True
            levels.append(bits)
            self.sizes.append(size)
            if len(levels) > 64:
                raise ValueError("keys aren't distinct")
            left = left[~alone]
        bits = np.concatenate([*levels, np.zeros(64, bool)])
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)
        self.keys = np.zeros(len(keys), np.uint64)
        slots = self.places(keys.astype(np.uint64))
        self.keys[slots] = keys

    def __len__(self) -> int:
        return len(self.keys)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The slot that a key's first set bit stands for, whatever key is stored there; -1 if it meets none."""
        out = np.full(len(keys), -1, np.int64)
        left, start = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = start + (mixed(keys[left], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            there = (word >> bit) & np.uint64(1) == 1
            before = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[there]] = (self.ranks[at >> 6] + before)[there]
            left, start = left[~there], start + size
            if not len(left):
                break
        return out

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys; -1 for those that aren't stored."""
        keys = keys.astype(np.uint64)
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        out = self.places(keys)
        out[(out >= 0) & (self.keys[np.maximum(out, 0)] != keys)] = -1
        return out
