"""Word and shingle hashes of many texts at once, worked out with whole-array arithmetic."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Words of a shingle.
WIDTH = 5
#: Bytes of text that are worked on together.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over the whole range; one-to-one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_UP = np.zeros(0, np.uint64)
_DOWN = np.zeros(0, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < n:
        size = max(n, BLOCK + 4096)
        _UP, _DOWN = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        _UP[0] = _DOWN[0] = 1
        _UP, _DOWN = np.multiply.accumulate(_UP), np.multiply.accumulate(_DOWN)
    return _UP, _DOWN


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text where its words begin, with the end added."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
    starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    stops = stops[stops > 0] if len(starts) else stops[:0]
    up, down = _powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    hashes = mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.concatenate([[0], np.searchsorted(starts, ends)])


def shingle_hashes(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hashes of all runs of ``width`` words; a shorter text is one run as a whole, an empty one none."""
    n = len(words)
    if n == 0:
        return words
    width = min(width, n)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out = mix(out + words[k : n - width + 1 + k])
    return out


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``BLOCK`` bytes; a longer text is a range of its own."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BLOCK:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, letters A-Z in lower case."""
    for a, b in blocks(texts):
        words, at = word_hashes(texts[a:b])
        for i in range(b - a):
            yield np.unique(shingle_hashes(words[at[i] : at[i + 1]], width))


def as_bytes(column) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8; null is the empty text."""
    return [x or b"" for x in column.cast("binary").to_pylist()]
