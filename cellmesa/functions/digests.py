"""MD5 digests of many numbered names at once, as numpy arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Digests that are held at once.
RUN = 1 << 15
#: Bytes of a text that fit one block with its length.
SHORT = 55

_SHIFTS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, 0).reshape(64)
_SINES = np.floor(2.0**32 * np.abs(np.sin(np.arange(1, 65)))).astype(np.uint32)
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _blocks(words: np.ndarray) -> np.ndarray:
    """The digests (n, 16) of padded blocks of 16 words, given as (16, n)."""
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in _START)
    for i in range(64):
        if i < 16:
            f, at = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, at = c ^ (b | ~d), 7 * i % 16
        f += a
        f += words[at]
        f += _SINES[i]
        shift = np.uint32(_SHIFTS[i])
        turned = f << shift
        f >>= np.uint32(32) - shift
        turned |= f
        turned += b
        a, b, c, d = d, turned, b, c
    out = np.stack([x + np.uint32(s) for x, s in zip((a, b, c, d), _START, strict=True)], 1)
    return out.astype("<u4").view(np.uint8)


def numbered(names: list[bytes], counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each name followed by 1, 2, ... up to its count, in order and in runs: (which name, the digests' first and last 8 bytes)."""
    told = np.array(names or [b""])
    width = told.dtype.itemsize
    text, size = told.view(np.uint8).reshape(len(told), width), np.char.str_len(told)
    ends = np.cumsum(counts, dtype=np.int64)
    for at in range(0, int(ends[-1]) if len(ends) else 0, RUN):
        slot = np.arange(at, min(at + RUN, int(ends[-1])))
        own = np.searchsorted(ends, slot, side="right")
        number = slot - (ends[own] - counts[own]) + 1
        digits = np.searchsorted(10 ** np.arange(1, 19), number, side="right") + 1
        out = np.empty((len(slot), 16), np.uint8)
        kind = size[own] * 32 + digits
        for k in np.unique(kind):
            pick = np.flatnonzero(kind == k)
            n, m = int(k) // 32, int(k) % 32
            if n + m > SHORT:
                out[pick] = [list(hashlib.md5(names[i] + b"%d" % j).digest()) for i, j in zip(own[pick].tolist(), number[pick].tolist(), strict=True)]
                continue
            block = np.zeros((len(pick), 64), np.uint8)
            block[:, :n] = text[own[pick], :n]
            for p in range(m):
                block[:, n + m - 1 - p] = 48 + number[pick] // 10**p % 10
            block[:, n + m] = 0x80
            words = np.ascontiguousarray(block.view("<u4").T.astype(np.uint32))
            words[14] = 8 * (n + m)
            out[pick] = _blocks(words)
        halves = out.view(">u8").astype(np.uint64)
        yield own, halves[:, 0], halves[:, 1]
