"""A cuckoo filter: a compact set that forgets as well as it learns. One filter serves one shard of keys."""

from __future__ import annotations

import numpy as np

SLOTS, KICKS = 4, 400


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four. Keys are 16-byte digests.

    No key that was added, and not removed since, is ever denied. Equal fingerprints are kept once for each key, so removing
    one key leaves the others. A filter that overflows doubles from the keys it is given by `grow`.
    """

    def __init__(self, buckets: int, cells: np.ndarray | None = None):
        self.buckets = buckets
        self.cells = np.zeros((buckets, SLOTS), dtype=np.uint16) if cells is None else cells

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, len(keys)) / (SLOTS * 0.8)))))
        while True:
            made = cls(buckets)
            if all(made.add(k) for k in keys):
                return made
            buckets *= 2

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        cells = np.frombuffer(data, dtype="<u2").reshape(-1, SLOTS).copy()
        return cls(len(cells), cells)

    def dump(self) -> bytes:
        return self.cells.astype("<u2").tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets of keys, an array of shape (n, 2) of 64-bit words."""
        prints = ((keys[:, 1] >> np.uint64(40)) & np.uint64(0xFFFF)).astype(np.uint16)
        prints[prints == 0] = 1
        mask = np.uint64(self.buckets - 1)
        one = keys[:, 1] & mask
        return prints, one, one ^ self._jump(prints)

    def _jump(self, prints: np.ndarray) -> np.ndarray:
        return (prints.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(self.buckets - 1)

    @staticmethod
    def words(keys: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 2)

    def has(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, dtype=bool)
        prints, one, two = self._places(self.words(keys))
        return ((self.cells[one] == prints[:, None]) | (self.cells[two] == prints[:, None])).any(axis=1)

    def add(self, key: bytes) -> bool:
        prints, one, two = self._places(self.words([key]))
        mark, at = int(prints[0]), [int(one[0]), int(two[0])]
        for b in at:
            free = np.flatnonzero(self.cells[b] == 0)
            if len(free):
                self.cells[b, free[0]] = mark
                return True
        b = at[mark & 1]
        for i in range(KICKS):
            slot = (i * 3 + mark) % SLOTS
            mark, self.cells[b, slot] = int(self.cells[b, slot]), mark
            b ^= int(self._jump(np.array([mark], dtype=np.uint16))[0])
            free = np.flatnonzero(self.cells[b] == 0)
            if len(free):
                self.cells[b, free[0]] = mark
                return True
        return False

    def remove(self, key: bytes) -> bool:
        prints, one, two = self._places(self.words([key]))
        for b in (int(one[0]), int(two[0])):
            found = np.flatnonzero(self.cells[b] == prints[0])
            if len(found):
                self.cells[b, found[0]] = 0
                return True
        return False
