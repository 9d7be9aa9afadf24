"""Two-stage suffix sorting of a piece of text, as far as a given number of bytes decides."""

from __future__ import annotations

import numpy as np


class Suffixes:
    """`order`: the wanted suffixes and those that place them, sorted by their first `depth` bytes;
    `common`: bytes that each has in common with the one before it, counted in steps of 8 up to
    `depth`, which is a multiple of 8.

    Suffixes smaller than their successor are sorted directly. One that is greater than its
    successor is placed by it: going through the buckets of first bytes from the left, every suffix
    met puts the one that starts a byte earlier at the next free place of that one's bucket, where
    the greater suffixes come first. As the text is only sorted where it is wanted, a wanted suffix
    brings with it the successors up to the first that is sorted directly.
    """

    def __init__(self, text: bytes, wanted: np.ndarray, depth: int):
        # a smaller suffix behind the text ends every run of greater ones
        self.text = text + b"\x00\xff" + bytes(depth + 8)
        n = len(text) + 2
        byte = np.frombuffer(self.text, dtype=np.uint8)[:n]
        # within a run of one byte, the byte behind the run decides
        ends = np.flatnonzero(np.append(byte[1:] != byte[:-1], True))
        behind = np.append(byte[np.minimum(ends[:-1] + 1, n - 1)], 0)
        greater = np.repeat(behind < byte[ends], np.diff(ends, prepend=-1))
        smaller_at = np.flatnonzero(~greater)
        needed = np.zeros(n + 1, dtype=np.int32)
        first = np.flatnonzero(wanted & ~np.append(False, wanted[:-1]))
        last = np.flatnonzero(wanted & ~np.append(wanted[1:], False))
        np.add.at(needed, first, 1)
        np.add.at(needed, smaller_at[np.searchsorted(smaller_at, last)] + 1, -1)
        needed = np.cumsum(needed[:n]) > 0
        self.order = self._induced(byte, greater & needed, self._sorted(np.flatnonzero(~greater & needed), depth))
        self.common = self._common(depth)

    def _sorted(self, starts: np.ndarray, depth: int) -> np.ndarray:
        text = self.text
        return np.array(sorted(starts.tolist(), key=lambda i: text[i:i + depth]), dtype=np.int64)

    @staticmethod
    def _induced(byte: np.ndarray, greater: np.ndarray, smaller: np.ndarray) -> np.ndarray:
        waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
        bounds = np.searchsorted(byte[smaller], np.arange(257))
        out = []

        def earlier(met: np.ndarray) -> np.ndarray:
            before = met[met > 0] - 1
            return before[greater[before]]

        def put(found: np.ndarray) -> None:
            key = byte[found]
            place = np.argsort(key, kind="stable")
            found, key = found[place], key[place]
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            for part in np.split(found, cuts) if len(found) else []:
                waiting[byte[part[0]]].append(part)

        for c in range(256):
            met = np.concatenate(waiting[c]) if waiting[c] else smaller[:0]
            while len(met):  # a longer run of the same byte comes behind the shorter ones
                out.append(met)
                found = earlier(met)
                same = byte[found] == c
                put(found[~same])
                met = found[same]
            met = smaller[bounds[c]:bounds[c + 1]]
            out.append(met)
            put(earlier(met))
        return np.concatenate(out) if out else smaller

    def _common(self, depth: int) -> np.ndarray:
        words = np.ndarray((len(self.text) - 7,), dtype="<u8", buffer=self.text, strides=(1,))
        common = np.zeros(len(self.order), dtype=np.int32)
        alive = np.arange(1, len(self.order))
        for at in range(0, depth, 8):
            equal = words[self.order[alive] + at] == words[self.order[alive - 1] + at]
            alive = alive[equal]
            common[alive] = at + 8
            if not len(alive):
                break
        return common
