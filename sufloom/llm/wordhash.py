"""Hashes of words and word shingles of many texts at once, with numpy over their UTF-8 bytes."""

from __future__ import annotations

import re

import numpy as np

# A-Z become a-z; the six white-space bytes end a word.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE_RUN = re.compile(r"[\x20\x09-\x0D]+")
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    raw = [(t or "").encode() for t in texts]
    sizes = np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw))
    data = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)] if raw else np.zeros(0, np.uint8)
    solid = np.flatnonzero(~_SPACE[data])
    if not len(solid):
        return np.zeros(0, np.uint64), np.zeros(len(raw), np.int64)
    head = np.flatnonzero(np.diff(solid, prepend=-2) > 1)  # index into solid of each word's first byte
    begin = solid[head]
    lengths = np.diff(head, append=len(solid))
    within = (np.arange(len(solid), dtype=np.int64) - np.repeat(head, lengths)).astype(np.uint64)
    with np.errstate(over="ignore"):
        v = data[solid].astype(np.uint64) + within * np.uint64(256) + np.uint64(1)
        v *= np.uint64(0x9E3779B97F4A7C15)
        v ^= v >> np.uint64(32)
        v *= np.uint64(0xD6E8FEB86659FD93)
        v ^= v >> np.uint64(29)
        words = mix(np.add.reduceat(v, head))
    ends = np.cumsum(sizes)
    per_text = np.diff(np.searchsorted(begin, ends), prepend=0)
    return words, per_text


def pieces_at_spaces(text: str, size: int) -> list[str]:
    """text in pieces of about size characters, each but the last ending in white space; a longer word stays whole."""
    out, start = [], 0
    while len(text) - start > size:
        m = _SPACE_RUN.search(text, start + size)
        if not m:
            break
        out.append(text[start : m.end()])
        start = m.end()
    return [*out, text[start:]]


def shingle_sets(texts: list[str | None], width: int = 2, block: int = 2_000_000):
    """Yield for each text the sorted distinct hashes of its word shingles: of all its words as one if there are fewer
    than width, none without words. Works through texts in blocks of about `block` bytes."""
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size < block):
            size += len(texts[end] or "")
            end += 1
        if end - start == 1 and size > block:  # a very long text: its bytes are hashed in pieces
            words = np.concatenate([word_hashes([p])[0] for p in pieces_at_spaces(texts[start], block)])
            counts = np.array([len(words)])
        else:
            words, counts = word_hashes(texts[start:end])
        offsets = np.concatenate([[0], np.cumsum(counts)])
        with np.errstate(over="ignore"):
            joined = np.zeros(len(words), np.uint64)
            full = max(0, len(words) - width + 1)
            for k in range(width):
                joined[:full] = mix(joined[:full] + words[k : k + full], 7)
        for i in range(end - start):
            a, b = offsets[i], offsets[i + 1]
            if b - a >= width:
                yield np.unique(joined[a : b - width + 1])
            elif b > a:
                with np.errstate(over="ignore"):
                    h = np.zeros(1, np.uint64)
                    for k in range(a, b):
                        h = mix(h + words[k : k + 1], 11)
                yield h
            else:
                yield np.zeros(0, np.uint64)
        start = end
