"""Hashes of words and of runs of words, inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

# Odd 64-bit multipliers.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _WordHashes(dict):
    """word -> 64-bit hash; emptied when it is full."""

    MOST = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_HASHES = _WordHashes()


def split_words(text: str | None, lower: bool = True) -> list[bytes]:
    """The runs of ``[^\\x20\\x09-\\x0D]`` as UTF-8, with A-Z in lower case."""
    data = (text or "").encode(errors="surrogatepass")
    return (data.lower() if lower else data).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_PLACES = 64
_TABLE = mix(mix((np.arange(_PLACES * 256, dtype=np.uint64) + np.uint64(1)) * _STEP))
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BLOCK = 1 << 18  # bytes hashed together
_NUMBERS = np.arange(_BLOCK)


def bytes_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of each word of UTF-8 text, made from all its bytes at once.

    Every byte adds a number drawn from a table by its place in the word and its value. From place
    64 on the table is used again, times an odd number for each time round.
    """
    raw = np.frombuffer(data, np.uint8)
    blank = _BLANK[raw]
    changes = np.ones(len(raw) + 1, bool)
    changes[1:-1] = blank[1:] != blank[:-1]
    changes[[0, -1]] = ~blank[[0, -1]] if len(raw) else False
    edges = np.flatnonzero(changes)
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    sizes = ends - starts
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _BLOCK, side="right")))
        low, high = int(starts[at]), int(ends[to - 1])
        own = edges[2 * at:2 * to] - low
        place = _NUMBERS[:high - low] if high - low <= _BLOCK else np.arange(high - low)
        place = place - np.repeat(own[::2], np.diff(own[::2], append=high - low))
        drawn = _TABLE[((place & (_PLACES - 1)) << 8) | raw[low:high]]
        if sizes[at:to].max() > _PLACES:
            drawn *= mix((place // _PLACES).astype(np.uint64) * _STEP) | np.uint64(1)
        # The sums of the words, and between them those of the blanks.
        out[at:to] = np.add.reduceat(drawn, own[:-1])[::2]
        at = to
    return starts, mix(out + sizes.astype(np.uint64) * _STEP)


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for every k words in a row; one for all words if there are fewer; none for none."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    total = hashes[:n - k + 1].copy()
    for d in range(1, k):
        total = mix(total + _STEP) ^ hashes[d:n - k + 1 + d]
    return mix(total + np.uint64(k))


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The distinct shingles of k words of each text, as ascending hashes."""
    out: list[np.ndarray] = []
    held, n = [], 0
    for text in texts:
        held.append((text or "").encode(errors="surrogatepass").lower())
        n += len(held[-1])
        if n >= _BLOCK:
            out += _sets_of(held, k)
            held, n = [], 0
    return out + _sets_of(held, k)


def _sets_of(texts: list[bytes], k: int) -> list[np.ndarray]:
    starts, hashes = bytes_hashes(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    stops = np.searchsorted(starts, ends).tolist()
    # Runs over all texts; those that reach into the next text are not taken.
    runs = run_hashes(hashes, k)
    return [np.unique(runs[a:b - k + 1] if b - a >= k else run_hashes(hashes[a:b], k))
            for a, b in zip([0, *stops], stops)]
