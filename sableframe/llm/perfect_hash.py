"""A minimal perfect hash of 64-bit keys in numpy, with the keys stored by slot.

Each level has twice as many bits as keys are left; keys alone on their bit stay
there, the others go on to the next level. A key's slot is the rank of its bit,
so slots number the keys without a gap. A lookup compares the stored key, so
keys that weren't given have no slot.
"""

from __future__ import annotations

import numpy as np

GOLDEN = 0x9E3779B97F4A7C15


def spread(keys: np.ndarray, level: int = 0) -> np.ndarray:
    """Well mixed 64-bit numbers, other ones on each level."""
    x = keys.astype(np.uint64) + np.uint64(GOLDEN * (level + 1) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    def __init__(self, sizes: list[int], bits: np.ndarray, keys: np.ndarray | None = None):
        self.sizes, self.bits = sizes, bits
        self.rank = np.cumsum(bits, dtype=np.int64) - 1
        self.keys = keys

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """Of distinct int64 keys."""
        left, sizes, levels = np.unique(keys), [], []
        distinct = left
        while len(left):
            size = max(64, 2 * len(left))
            at = (spread(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        made = cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))
        made.keys = np.zeros(len(distinct), np.int64)
        made.keys[made._slots(distinct)] = distinct
        return made

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        slots, asked, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = start + (spread(keys[asked], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            slots[asked[hit]] = self.rank[at[hit]]
            asked, start = asked[~hit], start + size
        return slots

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for a key that isn't stored."""
        slots = self._slots(keys)
        if len(self.keys):
            slots[self.keys[slots] != keys] = -1
        return slots

    def to_columns(self) -> dict[str, object]:
        return {"sizes": list(self.sizes), "bits": np.packbits(self.bits).tobytes(), "keys": self.keys.tobytes()}

    @classmethod
    def from_columns(cls, row: dict) -> PerfectHash:
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(row["sizes"])).astype(bool)
        return cls(list(row["sizes"]), bits, np.frombuffer(row["keys"], np.int64))
