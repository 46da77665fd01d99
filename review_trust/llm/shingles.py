"""Word shingles of many texts at once, as arrays of hashes."""

from __future__ import annotations

import numpy as np

from review_trust.llm.common import BLANKS

# Bytes hashed at once: eight arrays of eight bytes each stay below 64 MB.
CHUNK_BYTES = 1 << 20
# Shingle hashes have 62 bits; the bit above them is free for an order.
HASH_BITS = 62

_RANDOM = np.random.default_rng(20_240_601)  # fixed seed: every worker hashes alike
_SYMBOLS = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACES = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS.encode())] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of all bits over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words_of(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of a piece of text that ends between words."""
    letter = ~_BLANK[data]
    before = np.concatenate(([False], letter[:-1]))
    starts = np.flatnonzero(letter & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64)
    chars = _LOWER[data[letter]]
    first = np.cumsum(letter)[starts] - 1
    lengths = np.diff(np.append(first, len(chars)))
    place = np.arange(len(chars)) - np.repeat(first, lengths)
    powers = np.full(int(lengths.max()) + 1, _BASE)
    powers[0] = 1
    powers = np.cumprod(powers)
    sums = np.add.reduceat(_SYMBOLS[chars] * powers[place], first)
    return _mix(sums + lengths.astype(np.uint64) * _SYMBOLS[0])


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of every word: runs of bytes that are no white space, A-Z lower-cased."""
    if len(text) <= CHUNK_BYTES:
        return _words_of(np.frombuffer(text, np.uint8))
    data, parts, start = np.frombuffer(text, np.uint8), [], 0
    while start < len(data):
        end = start + CHUNK_BYTES
        while end < len(data) and not _BLANK[data[end]]:
            end += 1
        parts.append(_words_of(data[start:end]))
        start = end
    return np.concatenate(parts)


def texts_words(texts: list[bytes | None]) -> list[np.ndarray]:
    """``word_hashes`` of every text, small ones hashed together."""
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        group, size = [], 0
        while i < len(texts) and (not group or size + len(texts[i] or b"") <= CHUNK_BYTES):
            group.append(texts[i] or b"")
            size += len(group[-1])
            i += 1
        if len(group) == 1:
            out.append(word_hashes(group[0]))
            continue
        data = np.frombuffer(b"\n".join(group), np.uint8)
        hashes = _words_of(data)
        letter = ~_BLANK[data]
        first = letter & ~np.concatenate(([False], letter[:-1]))
        ends = np.cumsum([len(g) + 1 for g in group])
        counts = np.cumsum(first)[np.minimum(ends - 1, len(data) - 1)] if len(data) else np.zeros(len(group), int)
        out += np.split(hashes, counts[:-1])
    return out


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingles of a text in ascending order; with fewer words than ``size`` all of them are one."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    if n < size:
        sums = np.sum(words * _PLACES[:n], keepdims=True) + np.full(1, n, np.uint64) * _PLACES[-1]
    else:
        sums = np.zeros(n - size + 1, np.uint64)
        for i in range(size):
            sums += words[i : n - size + 1 + i] * _PLACES[i]
    return np.unique((_mix(sums) >> np.uint64(64 - HASH_BITS)).astype(np.int64))
