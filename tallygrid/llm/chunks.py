"""A worker's memory of token ids: each distinct chunk of text is encoded once and looked up afterwards."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Chunks(dict):
    """chunk -> number; the chunks not seen before wait in ``new`` until ``encode`` has given their ids."""

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], keep: int, dtype=np.int32):
        super().__init__()
        self.encode, self.keep = encode, keep
        self.new: list = []
        self.ids, self.ends = np.zeros(0, dtype), np.zeros(1, np.int64)

    def __missing__(self, chunk) -> int:
        n = self[chunk] = len(self)
        self.new.append(chunk)
        return n

    def numbers(self, chunks: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, chunks), np.int32, len(chunks))

    def learn(self) -> None:
        """Encode what waits: ``encode(chunks) -> (ids one after the other, ids per chunk)``."""
        if self.new:
            ids, lengths = self.encode(self.new)
            self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
            self.new = []

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """Ids of a sequence of chunks."""
        a = self.ends[numbers]
        n = (self.ends[1:][numbers] - a).astype(np.int64)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(a - (ends - n), n) + np.arange(total)] if total else self.ids[:0]

    def trim(self) -> None:
        """Between batches: forget the chunks that came after the first ``keep`` (common ones come early)."""
        if len(self) > self.keep:
            kept = list(self)[:self.keep // 2]
            self.clear()
            self.update(zip(kept, range(len(kept))))
            self.ends = self.ends[:len(kept) + 1].copy()
            self.ids = self.ids[:self.ends[-1]].copy()
