"""Statistics of one whole text: words, characters by class, repeated lines and word windows.

Words are runs of anything but ASCII white space, taken from the UTF-8 bytes; ``bytes.split`` has exactly that rule.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SYMBOL_BYTES = np.frombuffer(b"#*$%&|<>", np.uint8)
CONTINUATION = slice(0x80, 0xC0)
WINDOW = 3
#: Odd multipliers that mix the hashes of the words of a window.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@dataclass
class Stats:
    bytes_: np.ndarray  # count of each byte value
    words: list[bytes]
    hashes: np.ndarray  # 64-bit hash of each word
    n_lines: int
    n_dup_lines: int
    n_repeat_words: int
    n_distinct_windows: int

    @property
    def n_words(self) -> int:
        return len(self.words)

    @property
    def word_chars(self) -> int:
        return int(self.bytes_.sum() - self.bytes_[CONTINUATION].sum() - self.bytes_[SPACE].sum())

    @property
    def n_symbols(self) -> int:
        return int(self.bytes_[SYMBOL_BYTES].sum())


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each window of n words."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    mixed = hashes[:size] * MIX[0]
    for i in range(1, n):
        mixed = (mixed ^ (mixed >> np.uint64(29))) + hashes[i : size + i] * MIX[i]
    return mixed


def stats(text: str) -> Stats:
    raw = text.encode()
    words = raw.split()
    hashes = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    of_window = windows(hashes, WINDOW)
    repeat, distinct = 0, len(of_window)
    if len(of_window):
        _, index, counts = np.unique(of_window, return_inverse=True, return_counts=True)
        distinct = len(counts)
        if distinct < len(of_window):
            twice = counts[index] > 1
            covered = np.zeros(len(words), bool)
            for i in range(WINDOW):
                covered[i : i + len(twice)] |= twice
            repeat = int(covered.sum())
    return Stats(np.bincount(np.frombuffer(raw, np.uint8), minlength=256), words, hashes, len(lines), len(lines) - len(set(lines)), repeat, distinct)
