"""Vectorised 64-bit hashes of byte stretches, shared by the operators on words, shingles and substrings.

A stretch is read as little-endian words of 8 bytes, counted from its own start, the last one cut to the stretch.
Every word is mixed together with its place, without regard to the others, and the mixed words are added: unlike a
polynomial modulo 2^64 this has no letters that cancel each other. Equal stretches have equal hashes wherever they
lie; different ones collide with a chance of about 2^-64 a pair, and callers that must be exact compare the words.
"""

from __future__ import annotations

import numpy as np

_DRAW = np.random.default_rng(0x5EED)
BYTE = _DRAW.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX_1, MIX_2, PLACE = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
S29, S32 = np.uint64(29), np.uint64(32)
#: What a word that ends after 1 .. 8 bytes keeps.
KEEP = np.array([0, *((1 << 8 * n) - 1 for n in range(1, 9))], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> S32)) * MIX_1
    h = (h ^ (h >> S29)) * MIX_2
    return h ^ (h >> S32)


def stretch_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 8-byte words of all stretches data[start:end], one after another, and how many each has (one at least)."""
    lengths = ends - starts
    counts = np.maximum((lengths + 7) >> 3, 1)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    every = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))
    last = np.cumsum(counts) - 1
    if counts.max(initial=1) == 1:
        at = starts
    else:
        at = np.full(int(last[-1]) + 1, 8, np.int64)
        at[0], at[last[:-1] + 1] = starts[0], starts[1:] - starts[:-1] - 8 * (counts[:-1] - 1)
        at = np.cumsum(at)
    words = every[at]
    words[last] &= KEEP[lengths - 8 * (counts - 1)]
    return words, counts


def word_hashes(words: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each stretch from its words and its length in bytes."""
    first = np.cumsum(counts) - counts
    if len(words) == len(counts):
        h = mix(words + PLACE)
    else:
        place = np.arange(1, len(words) + 1, dtype=np.uint64) - np.repeat(first.astype(np.uint64), counts)
        h = np.add.reduceat(mix(mix(words + place * PLACE) ^ place), first)
        one = counts == 1
        h[one] = mix(words[first[one]] + PLACE)
    return mix(h + lengths.astype(np.uint64) * MIX_1)


def stretch_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of data[start:end] (bytes) for each pair."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return word_hashes(*stretch_words(data, starts, ends), ends - starts)


def chunks(texts: list[bytes], size: int = 1 << 20):
    """Ranges (i, j) of neighbouring texts of about `size` bytes; a longer text is a chunk of its own."""
    i = total = 0
    for j, t in enumerate(texts):
        if j > i and total + len(t) > size:
            yield i, j
            i, total = j, 0
        total += len(t)
    if i < len(texts):
        yield i, len(texts)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all stretches, one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
