"""Words of many texts at once as numpy arrays, with hashes of any run of words."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class WordRuns:
    """``texts`` (UTF-8) cut at ASCII white space.

    ``letters``: all words, each followed by one blank. Word ``i`` lies at
    ``bounds[i]:bounds[i + 1] - 1``; text ``t`` has words ``first[t]`` up to ``first[t + 1]``.
    """

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        space = _SPACE[raw]
        keep = ~space
        keep[1:] |= ~space[:-1]  # a word's first blank; others go
        ends = np.flatnonzero(space & keep)
        stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.first = np.concatenate([[0], np.searchsorted(ends, stops)])
        self.letters = raw[keep]
        blanks = np.flatnonzero(space[keep])
        self.letters[blanks] = 0x20
        self.bounds = np.concatenate([[0], blanks + 1])

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def run_starts(self, length: int) -> np.ndarray:
        """First words of all runs of ``length`` words that lie in one text."""
        counts = np.maximum(np.diff(self.first) - length + 1, 0)
        ends = np.cumsum(counts)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[:-1] - (ends - counts), counts)


class WordDigests(dict):
    """128-bit digests of words, each distinct word hashed once; beyond ``limit`` words it starts anew."""

    def __init__(self, limit: int = 1 << 18):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> bytes:
        self[word] = digest = blake2b(word, digest_size=16).digest()
        return digest

    def of(self, words: WordRuns) -> np.ndarray:
        """Two rows of 64-bit numbers, a column per word."""
        if len(self) > self.limit:
            self.clear()
        found = b"".join(map(self.__getitem__, words.letters.tobytes().split(b" ")[:-1]))
        return np.ascontiguousarray(np.frombuffer(found, np.uint64).reshape(-1, 2).T)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(a * np.uint64(0x9E3779B97F4A7C15) + b)


def run_hashes(words: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """Per size the hash of ``words[i : i + size]`` for every ``i``; sizes rise.

    Hashes of halves are hashed again, by doubling. Every level is mixed, so
    texts built to meet in sums or polynomials do not meet here.
    """
    have, out, found = 1, words, []
    for size in sizes:
        while have * 2 <= size:
            out = _joined(out[: max(0, len(out) - have)], out[have:])
            have *= 2
        rest = size - have
        found.append(_joined(out[: max(0, len(out) - rest)], out[rest:]) if rest else out)
    return found


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread a hash over all 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``x[i : i + width]`` for every ``i``, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def least_labels(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For 0..size-1 the least number that links ``a[i] - b[i]`` connect it with."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label[a] == label[b]).all():
            return label
