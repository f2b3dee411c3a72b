"""Hashed word shingles of texts, vectorised."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

SHINGLE = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FACTORS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                     0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits, one to one."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class WordHasher:
    """64-bit hashes of the words in byte strings: a polynomial by prefix sums, then mixed."""

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            for name, factor in (("powers", _BASE), ("inverses", inverse)):
                steps = np.full(n, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(hash, start) of every word of ``data``."""
        bytes_ = np.frombuffer(data, np.uint8)
        inside = ~_SPACE[bytes_]
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        starts, ends = edges[::2], edges[1::2]
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((bytes_.astype(np.uint64) + np.uint64(1)) * self.powers[:len(data)],
                  out=sums[1:])
        values = (sums[ends] - sums[starts]) * self.inverses[starts]
        return mixed(values + (ends - starts).astype(np.uint64) * np.uint64(_BASE)), starts


def _pieces(texts: list[str | None], limit: int) -> Iterator[tuple[int, bytes]]:
    """(index, bytes) of every text, long ones cut between words."""
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: only A to Z change
        start = 0
        while len(data) - start > limit:
            cut = _GAP.search(data, start + limit)
            if cut is None:
                break
            yield i, data[start:cut.start()]
            start = cut.end()
        yield i, data[start:]


def word_hashes(texts: list[str | None], hasher: WordHasher,
                limit: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of every text) of whole texts, in order."""
    hashes, counts = [np.empty(0, np.uint64)], np.zeros(len(texts), np.int64)
    group: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if group:
            values, starts = hasher(b" ".join(data for _, data in group))
            begins = np.cumsum([0] + [len(data) + 1 for _, data in group])
            owner = np.searchsorted(begins, starts, "right") - 1
            ids = np.asarray([i for i, _ in group])
            np.add.at(counts, ids, np.bincount(owner, minlength=len(group)))
            hashes.append(values)
        group.clear()
        size = 0

    for piece in _pieces(texts, limit):
        if size + len(piece[1]) > limit:
            flush()
        group.append(piece)
        size += len(piece[1])
    flush()
    return np.concatenate(hashes), counts


def shingle_sets(texts: list[str | None], hasher: WordHasher) -> list[np.ndarray]:
    """For every text its distinct shingles as sorted 64-bit hashes: of five words each, of
    all words if there are fewer, none without words."""
    words, counts = word_hashes(texts, hasher)
    n = len(words) - SHINGLE + 1
    if n > 0:
        rolled = sum(words[k:n + k] * _FACTORS[k] for k in range(SHINGLE))
        rolled = mixed(rolled)
    sets, at = [], 0
    for count in counts.tolist():
        if count >= SHINGLE:
            sets.append(np.unique(rolled[at:at + count - SHINGLE + 1]))
        elif count:
            short = (words[at:at + count] * _FACTORS[:count]).sum(dtype=np.uint64)
            sets.append(mixed(np.array([short + np.uint64(count)], np.uint64)))
        else:
            sets.append(np.empty(0, np.uint64))
        at += count
    return sets
