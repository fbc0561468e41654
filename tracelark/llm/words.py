"""Vectorised word hashing for whole batches of texts."""

from __future__ import annotations

import numpy as np

_GENERATOR = np.random.Generator(np.random.PCG64(20240607))
#: A fixed random 64-bit value for each byte, and powers of an odd multiplier and of its inverse.
_BYTE = _GENERATOR.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Space and 0x09 to 0x0D part words.
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(size: int) -> tuple[np.ndarray, np.ndarray]:
    for k, base in enumerate((_BASE, _INVERSE)):
        while len(_powers[k]) < size:
            n = len(_powers[k])
            _powers[k] = np.concatenate([_powers[k], _powers[k] * np.uint64(pow(base, n, 2**64))])
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes, chunk: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash for each word of a UTF-8 text (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased), in order.

    Works through the text in chunks that end at white space, so the buffers stay small.
    """
    if len(text) > chunk:
        parts, at = [], 0
        while at < len(text):
            end = min(len(text), at + chunk)
            while end < len(text) and not _IS_SPACE[text[end]]:
                end += 1
            parts.append(word_hashes(text[at:end], chunk=len(text)))
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    raw = np.frombuffer(text.translate(_ASCII_LOWER), np.uint8)
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = _IS_SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Distinct hashes of ``size`` consecutive words, sorted; fewer words count as one shingle, none as nothing."""
    if not len(words):
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
    return np.unique(mix(out + np.uint64(size)))
