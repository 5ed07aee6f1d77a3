"""Word and n-gram hashes of many texts at once, in numpy.

Words are runs of anything but the ASCII white-space characters. A word's hash is a polynomial
over its bytes, with a random value for each byte, modulo 2**64, taken from prefix sums, then
mixed; an n-gram's hash mixes its words' hashes in order. Texts are handled in chunks of a
bounded number of bytes; nothing here holds a Python object for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_random = np.random.default_rng(20240229)
_BYTE_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z alone.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 or more."""
    key = str(base)
    if len(_powers.get(key, ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = np.full(size, base, np.uint64)
        out[0] = 1
        _powers[key] = np.multiply.accumulate(out)
    return _powers[key][:n]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts) with at most limit bytes, or one longer text."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, texts[start:]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the offset of each text's first word, with the end."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate(([0], edges))
    starts, ends = edges[0::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _power(_BASE, len(data)), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(starts, first)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on (those across texts too), as far as there are n."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:size].copy()
    for i in range(1, n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        out += hashes[i : i + size]
    return mix(out)


def window_sums(hashes: np.ndarray, n: int) -> np.ndarray:
    """Like grams() for long n: at a cost that doesn't depend on n."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _power(_BASE, len(hashes)), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * _power(_INVERSE, len(hashes))[:size])


def words_and_prefixes(texts: list[bytes], lengths: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Like words(), and for each length the hash of every word's first bytes (0 for shorter words)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate(([0], edges))
    starts, ends = edges[0::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _power(_BASE, len(data)), out=sums[1:])
    scale = _power(_INVERSE, len(data) + 1)[starts]
    whole = mix((sums[ends] - sums[starts]) * scale + (ends - starts).astype(np.uint64))
    parts = []
    for n in lengths:
        cut = np.minimum(starts + n, len(data))
        parts.append(np.where(ends - starts > n, mix((sums[cut] - sums[starts]) * scale + np.uint64(n << 32)), np.uint64(0)))
    return whole, parts, np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
