"""Hashes of runs of words, whole texts at a time."""

from __future__ import annotations

import numpy as np

from codeloom.llm.common import SOME_CHARS, WORD_BYTES

WIDTH = 5
_rng = np.random.default_rng(20240229)
SALT = _rng.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose results look independent."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of each word raw[first:stop]: the sum of salt[byte] * odd ** place in the word, mixed."""
    size = stop - first
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(begin, size)
    powers = np.full(int(size.max()), ODD, np.uint64)
    powers[0] = 1
    return mix(np.add.reduceat(SALT[raw[place + np.repeat(first, size)]] * np.cumprod(powers)[place], begin))


def shingle_hashes(texts: list[str | None], bytes_to: bytes = WORD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of all texts, one after another, and the number of each text's (repeats included). bytes_to
    lowers letters and makes a space of what parts words."""
    parts = [(t or "").encode("utf-8", "replace").translate(bytes_to) + b" " for t in texts]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    inside = raw != 32
    edge = np.diff(inside.astype(np.int8), prepend=0)
    first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum([len(p) for p in parts])
    n_words = np.diff(np.searchsorted(first, ends), prepend=0)
    if not len(first):
        return np.zeros(0, np.uint64), n_words * 0
    cuts = np.unique(np.searchsorted(first, np.arange(0, len(raw) + SOME_CHARS, SOME_CHARS)))
    words = np.concatenate([word_hashes(raw, first[a:b], stop[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    counts = np.where(n_words >= WIDTH, n_words - WIDTH + 1, np.minimum(n_words, 1))
    starts = np.cumsum(n_words) - n_words
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    width = np.repeat(np.minimum(n_words, WIDTH), counts)
    total = width.astype(np.uint64)
    for k in range(WIDTH):
        on = width > k
        total[on] = total[on] * ODD + words[at[on] + k]
    return mix(total), counts
