"""Word shingles as 64-bit hashes, computed over whole blocks of texts with numpy.

A block is a few megabytes of UTF-8; a longer single text is a block of its own, so no text is ever cut.
Words are the runs of bytes other than the six ASCII white-space characters; A-Z are lower-cased.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def give_back() -> None:
    """Returns freed memory of a worker to the system after a batch. Workers outlive their tasks, and what they keep would count against the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, BLOCK_BYTES + 1024)
            cls.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _P, dtype=np.uint64)], dtype=np.uint64)
            cls.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _P_INV, dtype=np.uint64)], dtype=np.uint64)
            if size > 4 * BLOCK_BYTES:  # of one very long text; not kept
                up, down = cls.up, cls.down
                cls.up, cls.down = up[:1].copy(), down[:1].copy()
                return up[:n], down[:n]
        return cls.up[:n], cls.down[:n]


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column that hold about ``size`` bytes each."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > size:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def hash_spans(joined: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from each begin up to its end."""
    up, down = _Powers.of(len(joined) + 1)
    total = np.empty(len(joined) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * up[: len(joined)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def word_places(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a block, per text the position of its first word (one more entry at the end), the words' first and
    past-the-last bytes in the joined block, and that block."""
    joined = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    if lower:
        joined = _LOWER[joined]
    space = _SPACE[joined]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
    begin, end = edge[0::2], edge[1::2]
    words = hash_spans(joined, begin, end)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.r_[0, np.cumsum(lengths + 1)]
    return words, np.searchsorted(begin, starts), begin, end, joined


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The first two of ``word_places``."""
    return word_places(texts, lower)[:2]


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of k words; fewer words make one shingle, no words none."""
    n = len(words)
    run = np.zeros(max(n - k + 1, 0), dtype=np.uint64)
    for i in range(k):
        run = run * _P + words[i : i + len(run)]
    run = mix(run)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            s = np.sort(run[a : b - k + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif b > a:
            h = np.uint64(0)
            for w in words[a:b]:
                h = np.multiply(h, _P) + w
            out.append(mix(np.array([h + np.uint64(b - a)], dtype=np.uint64)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def text_shingles(texts: pa.Array, k: int) -> Iterator[tuple[int, int, list[np.ndarray], list[bytes]]]:
    """Per block of rows (from, to, shingle sets, texts); a null text has an empty set."""
    with np.errstate(over="ignore"):
        for a, b in blocks(texts):
            part = [x or b"" for x in texts[a:b].cast(pa.binary()).to_pylist()]
            yield a, b, shingle_hashes(*word_hashes(part), k), part
    give_back()
