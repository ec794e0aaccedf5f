"""Order of the suffixes of one text of ordinary size, for use inside tasks.

Letters A, C, G, T are packed, two bits each, so the first 32 characters of a suffix are one number; other alphabets
begin with single characters. Deeper orders come from prefix doubling: ranks by h characters give ranks by up to 2h.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CODES = np.full(256, 255, np.uint8)
CODES[[ord(c) for c in "ACGT"]] = [0, 1, 2, 3]


def first_ranks(text: str, depth: int) -> tuple[int, np.ndarray]:
    """How many characters are compared, at most depth, and the ranks of all suffixes by them; 0 the empty suffix."""
    n = len(text)
    codes = CODES[np.frombuffer(text.encode(), np.uint8)] if text.isascii() else None
    if codes is None or (codes == 255).any():
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) + 1
        return 1, np.unique(np.append(points, 0), return_inverse=True)[1]
    size = min(depth, 32)
    key, width = np.zeros(n + 65, np.uint64), 1
    key[:n] = codes
    while width < 32:  # 1, 2, 4, ... characters a number
        key[:-width] = (key[:-width] << np.uint64(2 * width)) | key[width:]
        width *= 2
    key = key[: n + 1] & ~np.uint64((1 << (64 - 2 * size)) - 1)
    has = np.minimum(n - np.arange(n + 1), size)  # shorter suffixes come before longer ones that go on with A
    order = np.lexsort((has, key))
    new = np.ones(n + 1, bool)
    new[1:] = (key[order[1:]] != key[order[:-1]]) | (has[order[1:]] != has[order[:-1]])
    ranks = np.empty(n + 1, np.int64)
    ranks[order] = np.cumsum(new) - 1
    return size, ranks


def text_order(text: str, k: int | None) -> np.ndarray:
    """Positions 0 to n in the order of their suffixes' first k characters, ties by position; of all characters with k=None."""
    n = len(text)
    depth = n + 1 if k is None else k
    h, ranks = first_ranks(text, depth)
    while h < depth and ranks.max() < n:
        step = min(h, depth - h)
        behind = np.full(n + 1, 0, np.int64)
        behind[: n + 1 - step] = ranks[step:] + 1 if step <= n else 0
        key = ranks * (n + 2) + behind
        ranks = np.unique(key, return_inverse=True)[1]
        h += step
    return np.argsort(ranks, kind="stable")


def strings(data: np.ndarray, lens: np.ndarray, nulls: np.ndarray | None = None) -> pa.Array:
    """ASCII strings from their joined bytes and lengths."""
    ends = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
    valid = None if nulls is None else pa.py_buffer(np.packbits(~nulls, bitorder="little").tobytes())
    return pa.StringArray.from_buffers(len(lens), pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes()), valid)


def columns_of(text: str, k: int | None, carry: int, size: int = 1 << 62) -> Iterator[list[pa.Array]]:
    """r, pos, p (the first `carry` characters) and bwt of all suffixes of a text, in order, in slices of `size` rows."""
    whole, n = text_order(text, k), len(text)
    raw = np.frombuffer(text.encode() + bytes(carry + 1), np.uint8) if text.isascii() else None
    for at in range(0, n + 1, size):
        order = whole[at : at + size]
        if raw is not None:
            inner = order > 0
            bwt = strings(raw[order[inner] - 1], inner.astype(np.int64), ~inner)
            lens = np.minimum(n - order, carry)
            rows = np.lib.stride_tricks.sliding_window_view(raw, carry)[order] if carry else np.zeros((len(order), 0), np.uint8)
            p = strings(rows[np.arange(carry)[None, :] < lens[:, None]], lens)
        else:
            bwt = pa.array([text[i - 1] if i else None for i in order.tolist()], pa.string())
            p = pa.array([text[i : i + carry] for i in order.tolist()], pa.string())
        yield [pa.array(np.arange(at, at + len(order), dtype=np.int64)), pa.array(order.astype(np.int64)), p, bwt]
